"""Mean Euclidean silhouette of clusterings of many points: between bounds, then of all pairs.

The silhouette needs the mean distance of each point to all points of each cluster. Instead of all
pairs, a point meets cells: points that are near one of a number of sub-centres and share their
cluster for every k. With d the distance to the mean of a cell and v the mean squared distance of
the cell's points to it, the mean distance to the cell lies between d (a norm is convex) and
sqrt(d*d + v). Sub-centres are multiplied until the bounds tell which k is best. Where they leave
several k, ``settled`` compares all pairs of points for those, so the best k is that of the plain
silhouette for any number of points. Tasks compute these distances with numpy, some points at a
time.
"""

import sys
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonwise.functions.blocks import (BLOCK, blocks, exact_as_doubles, matrix, nearest_rows,
                                         squared)
from seasonwise.operators.kmeans import SCALE, Fit, labelled

# Sub-centres of the levels. A level is read by every task: the last one is a few megabytes.
LEVELS = (64, 512, 4096)
# Cells of one level; each sub-centre has as many as it has combinations of clusters.
MOST_CELLS = 16_384
SAME = 1e-9
TILE = 256  # of cells
# Points that one task compares with all points.
STRIP = 32_768
# A level has fewer sub-centres than this part of the points: pairs cost no more than finer ones.
WORTH = 16

# Tasks get this module's functions with their code, so they need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def rate(points: DataFrame, fit: Fit, levels=LEVELS, most_cells: int = MOST_CELLS) -> dict:
    """Per k ``(low, high)`` of its mean silhouette, refined until the best k is certain.

    A k with fewer than two clusters that have points is missing. When the levels end before the
    best k is certain, the bounds of the last level stand: ``settled`` decides. Where points of the
    first sub-centres have more combinations of clusters than cells are allowed, every k gets cells
    of its own.
    """
    usable = _usable(fit)
    bounds = {}
    if not usable or not levels:
        return bounds
    # Labels are found once; every level reads them twice.
    rows = labelled(points, {k: fit.centres[k] for k in usable}).persist(
        StorageLevel.MEMORY_AND_DISK)
    try:
        first = _first_points(rows, levels[-1])
        apart = False
        for level in levels:
            centres = _by_id(first[:level])
            found = None if apart else _bounds(rows, fit, usable, centres, most_cells)
            if found is None and (apart or not bounds):
                apart, found = True, _bounds_of_each(rows, fit, usable, centres, most_cells)
            if found is None:
                break
            bounds = found
            if certain(bounds):
                break
    finally:
        rows.unpersist()
    return bounds


def worthwhile(n: int, levels=LEVELS) -> tuple:
    """The levels that are less work than all pairs of ``n`` points."""
    return tuple(level for level in levels if level * WORTH <= n)


def settled(points: DataFrame, fit: Fit, bounds: dict) -> dict:
    """``bounds``, with the silhouette of all pairs for every k that they do not rule out.

    Nothing runs if they rule out all but one. Otherwise every point meets every other one, once for
    all these k: work grows with the square of the points, memory of a task does not.
    """
    usable = _usable(fit)
    if certain(bounds) and len(bounds) == len(usable):
        return bounds
    return bounds | pairs(points, fit, [k for k in usable if not _ruled_out(bounds, k)])


def best(bounds: dict) -> int | None:
    """The k with the highest silhouette by the middle of its bounds, the smallest on ties."""
    middle = {k: (low + high) / 2 for k, (low, high) in bounds.items()}
    top = max(middle.values(), default=None)
    return min((k for k, s in middle.items() if s >= top - SAME), default=None)


def certain(bounds: dict) -> bool:
    """Whether the bounds rule out every other k than the best one."""
    k = best(bounds)
    return all(other == k or _ruled_out(bounds, other)
               or all(high - low < SAME for low, high in (bounds[k], bounds[other]))
               for other in bounds)


def _usable(fit: Fit) -> list[int]:
    return [k for k, sizes in fit.sizes.items() if sum(s > 0 for s in sizes) > 1]


def _ruled_out(bounds: dict, k: int) -> bool:
    """Whether some k is better for certain, or as good and smaller."""
    return k in bounds and any(
        bounds[k][1] < low - SAME or (bounds[k][1] <= low and other < k)
        for other, (low, _) in bounds.items())


@dataclass
class Cells:
    """Size, mean and spread of every cell; per k its clusters' sizes and the cells of each."""

    m: np.ndarray
    g: np.ndarray
    v: np.ndarray
    ls: np.ndarray  # cell, k -> cluster
    sizes: list[dict[int, int]]

    def sums(self, ls: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Per k the sums of the low and high silhouettes of points ``x``, labelled ``ls``."""
        groups = [(at, c) for at, sizes in enumerate(self.sizes) for c in sizes]
        # Sums over the cells of a cluster as a product.
        inside = np.stack([self.m * (self.ls[:, at] == c) for at, c in groups], axis=1)
        total = np.zeros((len(self.sizes), 2))
        for part in blocks(len(x), TILE):
            low = high = 0
            for cells in blocks(len(self.m), BLOCK // TILE):
                far = squared(x[part] / SCALE, self.g[cells])
                low = low + np.sqrt(far) @ inside[cells]
                high = high + np.sqrt(far + self.v[cells]) @ inside[cells]
            end = 0
            for at, sizes in enumerate(self.sizes):
                own, start, end = ls[part, at], end, end + len(sizes)
                several, a_low, b_low = _means(low[:, start:end], own, sizes)
                _, a_high, b_high = _means(high[:, start:end], own, sizes)
                total[at] += [_silhouette(a_high, b_low)[several].sum(),
                              _silhouette(a_low, b_high)[several].sum()]
        return total


class Strip:
    """Some points, and the sums of their distances to the points of each cluster met so far."""

    def __init__(self, x: np.ndarray, ls: np.ndarray, sizes: list[dict[int, int]]):
        self.x, self.ls, self.sizes, self.met = x, ls, sizes, 0
        self.groups = [(at, c) for at, clusters in enumerate(sizes) for c in clusters]
        self.far = np.zeros((len(x), len(self.groups)))

    def meet(self, x: np.ndarray, ls: np.ndarray) -> None:
        """Adds the distances to points ``x``, labelled ``ls``."""
        self.met += len(x)
        inside = np.stack([ls[:, at] == c for at, c in self.groups], axis=1).astype(np.float64)
        exact = exact_as_doubles(self.x, x)
        mine, others = self.x.astype(np.float64), x.astype(np.float64)
        if exact:  # squares of grid steps are whole numbers, also as a product of three terms
            mine = np.column_stack([mine, (mine * mine).sum(axis=1), np.ones(len(mine))])
            others = np.column_stack([-2 * others, np.ones(len(x)), (others * others).sum(axis=1)])
        for part in blocks(len(mine), TILE):
            for other in blocks(len(others), BLOCK // TILE):
                far = (mine[part] @ others[other].T if exact
                       else squared(mine[part], others[other]))
                self.far[part] += np.sqrt(far, out=far) @ inside[other]

    def sums(self) -> np.ndarray:
        """Per k the sum of the silhouettes, once all points were met."""
        total, end = np.zeros(len(self.sizes)), 0
        for at, sizes in enumerate(self.sizes):
            start, end = end, end + len(sizes)
            several, a, b = _means(self.far[:, start:end], self.ls[:, at], sizes)
            total[at] = _silhouette(a, b)[several].sum()
        return total


def _means(far: np.ndarray, own: np.ndarray, sizes: dict[int, int]) -> tuple:
    """Of sums of distances: whether a point has others in its cluster ``own``, the mean distance to
    them, and the least mean distance to another cluster."""
    n = np.array(list(sizes.values()))
    mine = own[:, None] == np.array(list(sizes))
    n_own = (mine * n).sum(axis=1)
    return (n_own > 1, (far * mine).sum(axis=1) / np.maximum(n_own - 1, 1),
            np.where(mine, np.inf, far / n).min(axis=1))


def _silhouette(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    most = np.maximum(a, b)
    return np.divide(b - a, most, out=np.zeros_like(most), where=most != 0)


def _first_points(rows: DataFrame, most: int) -> list:
    """The first ``most`` points by the hash of their key, which come back as one row."""
    return (rows.select(F.md5(F.col("id").cast("string")).alias("h"), "id", "x")
            .orderBy("h", "id").limit(most)
            .agg(F.sort_array(F.collect_list(F.struct("h", "id", "x"))).alias("r"))).first()["r"]


def _by_id(points: list) -> np.ndarray:
    ordered = sorted(points, key=lambda p: (p["id"] is not None, p["id"] or 0, p["x"]))
    return np.array([p["x"] for p in ordered], np.int64)


def _bounds_of_each(rows: DataFrame, fit: Fit, ks: list[int], centres: np.ndarray,
                    most_cells: int) -> dict | None:
    """As ``_bounds``, with cells by the labels of one k only: at most k for each sub-centre."""
    bounds = {}
    # The largest k first: it tells soonest that cells are too many.
    for at, k in reversed([*enumerate(ks, start=1)]):
        found = _bounds(rows.withColumn("ls", F.slice("ls", at, 1)), fit, [k], centres, most_cells)
        if found is None:
            return None
        bounds.update(found)
    return bounds


def _bounds(rows: DataFrame, fit: Fit, ks: list[int], centres: np.ndarray,
            most_cells: int) -> dict | None:
    """Bounds with the sub-centres ``centres``, of points with their labels."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                cell = nearest_rows(matrix(batch.column(0), np.int64), sent.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)],
                                                 names=["x", "ls", "cell"])

    width = len(next(iter(fit.centres.values()))[0])
    square = F.aggregate("x", F.lit(0.0), lambda t, v: t + v.cast("double") * v / SCALE / SCALE)
    cells = (rows.select("x", "ls")
             .mapInArrow(assign, "x array<bigint>, ls array<int>, cell bigint")
             .groupBy("cell", "ls").agg(
                 F.count(F.lit(1)).alias("m"), F.sum(square).alias("q"),
                 F.array(*[F.sum(F.col("x")[j]) for j in range(width)]).alias("s")))
    cells = cells.select("ls", "m", F.transform("s", lambda v: v / F.col("m") / SCALE).alias("g"),
                         (F.col("q") / F.col("m")).alias("q"))
    cells = cells.select("ls", "m", "g", F.when(F.col("m") == 1, 0.0).otherwise(F.greatest(
        F.lit(0.0), F.col("q") - F.aggregate("g", F.lit(0.0), lambda t, v: t + v * v))).alias("v"))
    table = cells.limit(most_cells + 1).collect()
    if len(table) > most_cells:
        return None
    # Sent to every task; its size has just been checked.
    table = spark.sparkContext.broadcast((
        *[np.array([r[name] for r in table], np.float64) for name in ("m", "g", "v")],
        np.array([r["ls"] for r in table], np.int64),
        _filled(fit, ks)))

    def rate_points(batches):
        near = Cells(*table.value)
        for batch in batches:
            if batch.num_rows:
                sums = near.sums(matrix(batch.column(0), np.int64),
                                 matrix(batch.column(1), np.float64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(sums)), pa.int32()), pa.array(sums[:, 0].copy()),
                     pa.array(sums[:, 1].copy())], names=["at", "low", "high"])

    sums = (rows.select("ls", "x").mapInArrow(rate_points, "at int, low double, high double")
            .groupBy("at").agg(F.sum("low").alias("low"), F.sum("high").alias("high")).collect())
    return {ks[r["at"]]: (r["low"] / fit.n, r["high"] / fit.n) for r in sums}


def _filled(fit: Fit, ks: list[int]) -> list[dict[int, int]]:
    return [{c: n for c, n in enumerate(fit.sizes[k]) if n} for k in ks]


def pairs(points: DataFrame, fit: Fit, ks: list[int]) -> dict:
    """Per k its mean silhouette over all pairs of points, twice, as its bounds.

    Points are dealt to strips by a hash of what they hold, so a recomputed task deals them alike.
    A task has one strip: it keeps these points, and all points pass it by.
    """
    cores = points.sparkSession.sparkContext.defaultParallelism
    strips = cores * max(1, -(-fit.n // (STRIP * cores)))
    sizes, n = _filled(fit, ks), fit.n
    rows = labelled(points, {k: fit.centres[k] for k in ks}).select(
        "x", "ls", F.pmod(F.xxhash64("id", "x"), F.lit(strips)).cast("int").alias("own"),
        F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("strip"))
    rows = (rows.repartitionById(strips, "strip")
            .select("x", "ls", (F.col("own") == F.col("strip")).alias("mine"))
            .sortWithinPartitions(F.desc("mine")))

    def rate_strip(batches):
        parts = ((matrix(batch.column(0), np.int64), matrix(batch.column(1), np.int64),
                  batch.column(2).to_numpy(zero_copy_only=False))
                 for batch in batches if batch.num_rows)
        first = []
        for part in parts:
            first.append(part)
            if not part[2].all():
                break  # the strip's own points came first
        if not first:
            return
        strip = Strip(*(np.concatenate([part[at][part[2]] for part in first]) for at in (0, 1)),
                      sizes)
        for x, ls, _ in chain(first, parts):
            strip.meet(x, ls)
        if strip.met != n:
            raise RuntimeError(f"a strip met {strip.met} points instead of {n}")
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(sizes)), pa.int32()), pa.array([len(strip.x)] * len(sizes)),
             pa.array(strip.sums())], names=["at", "n", "s"])

    sums = (rows.mapInArrow(rate_strip, "at int, n bigint, s double")
            .groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect())
    if any(r["n"] != n for r in sums):
        raise RuntimeError("strips do not hold every point once")
    return {ks[r["at"]]: (r["s"] / n, r["s"] / n) for r in sums}
