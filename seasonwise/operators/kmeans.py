"""Repeatable k-means of integer points, for several k in one pass per iteration.

Points and centres lie on an integer grid, so sums and squared distances are exact: neither the
layout of the data nor the order of summation can change a centre, a tie or a label. Seeds are
drawn by the hash of each point's key instead of a generator. Every point meets every centre, so
tasks find the nearest ones with numpy.
"""

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasonwise.functions.blocks import matrix, nearest_rows

# Grid steps per unit.
SCALE = 1_000_000

# Tasks get this module's functions with their code, so they need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def grid_points(df: DataFrame, key: str, columns: list[str], scale: int = SCALE) -> DataFrame:
    """``id, x array<long>`` of the given columns, rounded to the grid."""
    return df.select(F.col(key).alias("id"), F.array(*[
        F.round(F.col(c) * scale).cast("long") for c in columns]).alias("x"))


@dataclass
class Fit:
    """Centres per k on the grid, and what is known of each cluster."""

    centres: dict[int, list[list[int]]]
    sizes: dict[int, list[int]]
    numbers: dict[int, list[int | None]]
    n: int

    def labels(self, points: DataFrame, k: int) -> DataFrame:
        """``id, cluster``: the nearest centre, clusters numbered by their smallest id."""
        number = "array(" + ", ".join("0" if i is None else str(i) for i in self.numbers[k]) + ")"
        return points.select("id", F.get(F.expr(number), nearest("x", self.centres[k]))
                             .alias("cluster"))

    def all_labels(self, points: DataFrame) -> DataFrame:
        """``id, cluster, k`` of every k that was fitted, in one pass over the points."""
        ks = sorted(self.centres)
        if not ks:
            return points.selectExpr("id", "0 AS cluster", "0 AS k").limit(0)
        # Every cluster of a nearest centre has a number: the fit has seen its points.
        numbers = "array(" + ", ".join("array(" + ", ".join(
            "0" if i is None else str(i) for i in self.numbers[k]) + ")" for k in ks) + ")"
        return (labelled(points, {k: self.centres[k] for k in ks})
                .selectExpr("id", "posexplode(ls) AS (at, c)")
                .selectExpr("id", f"get(get({numbers}, at), c) AS cluster",
                            f"get(array({', '.join(map(str, ks))}), at) AS k"))


def literal(vectors: list[list[int]]) -> str:
    """Numbered vectors as one constant of SQL."""
    return "array(" + ", ".join(
        f"struct({i} AS c, array({', '.join(f'{v}L' for v in vector)}) AS v)"
        for i, vector in enumerate(vectors)) + ")"


def squared_distance(a: str, b: str) -> str:
    """SQL for two arrays of longs."""
    return (f"aggregate(zip_with({a}, {b}, (p, q) -> (p - q) * (p - q)), 0L, (t, v) -> t + v)")


def nearest(x: str, vectors: list[list[int]]) -> Column:
    """Number of the nearest vector, the first one on ties."""
    return F.expr(f"array_min(transform({literal(vectors)}, s -> "
                  f"struct({squared_distance(x, 's.v')} AS d, s.c AS c))).c")


def drawn(key: str, step: int) -> Column:
    """Evenly spread in (0, 1]: 52 bits of a hash of the key and the step."""
    digits = F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"/{step}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + 1) / F.lit(float(1 << 52))


def seeds(points: DataFrame, most: int) -> list[list[int]]:
    """Up to ``most`` different points, each drawn by its squared distance to those before.

    The smallest -ln(u) / weight of all points is such a draw, so each seed is one minimum. There
    are fewer seeds than asked for if there are fewer different points.
    """
    found = []
    for step in range(1, most + 1):
        u = drawn("id", step)
        rated = points.withColumn("key", u)
        if found:
            gap = F.expr(f"array_min(transform({literal(found)}, s -> "
                         f"{squared_distance('x', 's.v')}))")
            rated = points.withColumn("gap", gap).filter("gap > 0").withColumn(
                "key", -F.ln(u) / F.col("gap"))
        row = rated.agg(F.min(F.struct("key", "id", "x")).alias("s")).first()
        if row["s"] is None:
            break
        found.append([int(v) for v in row["s"]["x"]])
    return found


def fit(points: DataFrame, k_range, max_iterations: int) -> Fit:
    """Fit every k of ``k_range`` that is below the number of points and has enough different ones.

    All k share the seeds in their order and each pass over the points; a pass returns one row per
    cluster from every task. A cluster that loses all points keeps its centre. ``points (id, x)`` are read once per
    seed and iteration: persist them.
    """
    n = points.count()
    wanted = [k for k in k_range if k < n]
    starts = seeds(points, max(wanted)) if wanted else []
    centres = {k: starts[:k] for k in wanted if k <= len(starts)}
    for _ in range(max_iterations if centres else 0):
        moved = _moved(centres, _sums(points, centres))
        if moved == centres:
            break
        centres = moved
    sizes = {k: [0] * k for k in centres}
    firsts = {k: [None] * k for k in centres}
    ks = list(centres)
    for row in labelled(points, centres).selectExpr("id", "posexplode(ls) AS (at, c)").groupBy(
            "at", "c").agg(F.count(F.lit(1)).alias("n"),
                           F.min("id").alias("id")).collect() if centres else []:
        sizes[ks[row["at"]]][row["c"]] = row["n"]
        firsts[ks[row["at"]]][row["c"]] = row["id"]
    numbers = {}
    for k, ids in firsts.items():
        order = sorted((i for i in range(k) if ids[i] is not None), key=lambda i: ids[i])
        numbers[k] = [order.index(i) + 1 if i in order else None for i in range(k)]
    return Fit(centres, sizes, numbers, n)


def _sent(points: DataFrame, centres: dict):
    return points.sparkSession.sparkContext.broadcast(
        [np.array(vectors, np.int64) for vectors in centres.values()])


def labelled(points: DataFrame, centres: dict) -> DataFrame:
    """``id, x, ls``: number of the nearest centre for every k, in the order of ``centres``."""
    sent = _sent(points, centres)

    def label(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1), np.int64)
                ls = np.stack([nearest_rows(x, vectors) for vectors in sent.value], axis=1)
                ends = np.arange(0, ls.size + 1, ls.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.ListArray.from_arrays(ends, ls.ravel().astype(np.int32))],
                    names=["id", "x", "ls"])

    points = points.select("id", "x")
    return points.mapInArrow(label, T.StructType(
        [*points.schema.fields, T.StructField("ls", T.ArrayType(T.IntegerType()))]))


def _sums(points: DataFrame, centres: dict) -> dict:
    """``(k, c) -> [n, *sums]`` of the points nearest to each centre, summed per task before."""
    sent = _sent(points, centres)

    def add(batches):
        totals = None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), np.int64)
                rows = np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1)
                found = [nearest_rows(x, vectors) for vectors in sent.value]
                more = np.array([rows[cs == c].sum(axis=0)
                                 for cs, vectors in zip(found, sent.value)
                                 for c in range(len(vectors))])
                totals = more if totals is None else totals + more
        if totals is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(totals)), pa.int32()),
                 pa.array(totals.tolist(), pa.list_(pa.int64()))], names=["at", "s"])

    places = [(k, c) for k, vectors in centres.items() for c in range(len(vectors))]
    sums = {}
    for row in points.select("x").mapInArrow(add, "at int, s array<bigint>").collect():
        total = sums.get(places[row["at"]])
        sums[places[row["at"]]] = (row["s"] if total is None
                                   else [a + b for a, b in zip(total, row["s"])])
    return sums


def _moved(centres: dict, sums: dict) -> dict:
    """Means of the assigned points, rounded to the grid (halves up)."""
    moved = {k: list(vectors) for k, vectors in centres.items()}
    for (k, c), (n, *s) in sums.items():
        if n:
            moved[k][c] = [(2 * v + n) // (2 * n) for v in s]
    return moved
