"""Near-duplicate embeddings by a forest of random-projection trees.

Every tree splits at the median along random directions; vectors near a split go to both
sides, so that a pair above the threshold seldom parts in one tree and practically never in
all. Vectors are compared within leaves only. A pair counts in the first leaf that both
share, so nothing has to be emitted per pair: a leaf gives each vector its number of links
and its local component, and those are added up and united.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonwise.llm.common import cut_lineage, map_rows, written
from seasonwise.llm.components import components
from seasonwise.llm.minhash import _groups
from seasonwise.llm.vectors import usable, vectors

TREES = 8
# Expected vectors of a label in a leaf, and most that one task compares at a time.
LEAF = 1024
BLOCK = 2048
# Vectors that the driver looks at to place the splits; every vector is then routed by them.
SAMPLE = 20_000
DEEPEST = 10
# Spill on either side of a split, in deviations of the projected gap of a pair at the threshold.
SPILL = 0.5


@dataclass
class Forest:
    directions: np.ndarray  # trees x splits x dimensions
    thresholds: np.ndarray  # trees x splits
    depth: int
    gap: float  # largest distance of a pair of unit vectors at the threshold

    def leaves(self, vector: np.ndarray) -> list[int]:
        """Codes of all leaves a unit vector belongs to, ascending, tree by tree."""
        size = len(vector)
        planes = self.directions[:, :, :size]
        lengths = np.linalg.norm(planes, axis=2)
        away = planes @ vector - self.thresholds
        spill = SPILL * self.gap / np.sqrt(size) * lengths
        out = []
        for tree in range(len(planes)):
            nodes = [0]
            for _ in range(self.depth):
                nodes = [child for node in nodes for child in (
                    ([2 * node + 1] if away[tree, node] <= spill[tree, node] else [])
                    + ([2 * node + 2] if away[tree, node] >= -spill[tree, node] else []))]
            first = (1 << self.depth) - 1
            out += [(tree << self.depth) + node - first for node in nodes]
        return out


def plant(sample: np.ndarray, depth: int, trees: int, gap: float, seed: int = 3) -> Forest:
    """Trees whose splits halve the sample (unit vectors, padded with zeros)."""
    rng, splits = np.random.default_rng(seed), (1 << depth) - 1
    directions = rng.standard_normal((trees, splits, sample.shape[1]))
    directions /= np.maximum(np.linalg.norm(directions, axis=2, keepdims=True), 1e-300)
    thresholds = np.zeros((trees, splits))
    for tree in range(trees):
        members = {0: np.arange(len(sample))}
        for node in range(splits):
            own = members.pop(node)
            projected = sample[own] @ directions[tree, node]
            if len(own):
                thresholds[tree, node] = np.median(projected)
            left = projected <= thresholds[tree, node]
            members[2 * node + 1], members[2 * node + 2] = own[left], own[~left]
    return Forest(directions, thresholds, depth, gap)


def _leaf_links(code, reps, copies, points, leaves, own, i, j, least):
    """Links within a leaf, or between two blocks of it: rows ``rep, links, low``."""
    left = np.flatnonzero(own == i)
    right = left if i == j else np.flatnonzero(own == j)
    if not len(left) or not len(right):
        return
    near = points[left] @ points[right].T >= least
    if i == j:
        np.fill_diagonal(near, False)
    x, y = np.nonzero(near)
    if not len(x):
        return
    involved = np.unique(np.concatenate([left[x], right[y]]))
    # Leaves before this one that two vectors share: there the pair has been counted.
    codes = sorted({c for k in involved for c in leaves[k] if c < code})
    column = {c: n for n, c in enumerate(codes)}
    member = np.zeros((len(points), len(codes)), dtype=np.float32)
    for k in involved:
        member[k, [column[c] for c in leaves[k] if c < code]] = 1
    fresh = (member[left] @ member[right].T == 0)[x, y]
    weight = np.zeros(len(points), dtype=np.int64)
    np.add.at(weight, left[x], np.where(fresh, copies[right[y]], 0))
    if i != j:
        np.add.at(weight, right[y], np.where(fresh, copies[left[x]], 0))
    low = reps.copy()
    a, b = left[x], right[y]
    while True:
        before = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        if (before == low).all():
            break
    for k in involved:
        yield int(reps[k]), int(weight[k]), int(low[k])


def near_duplicates(table: DataFrame, least: float = 0.98, vec_id: str = "vec_id",
                    embedding: str = "embedding", label: str | None = "label",
                    trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors of equal, non-null ``label`` (all, if that is None) are linked if their cosine in
    double precision is at least ``least``. ``component_id`` is the smallest ``vec_id`` that
    links reach, itself included. Vectors that are null, zero or hold null or non-finite
    components, and those without label or id, link with nothing (component: their own id).
    Vectors of different length are not linked. Repeated rows count as vectors of their own;
    other columns are not looked at; an empty table gives no rows.
    """
    spark = table.sparkSession
    group = F.col(f"`{label}`").cast("string") if label else F.lit("")
    named = table.withColumn("_label", group).select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").alias("embedding"), "_label")
    points = vectors(named.filter("_label IS NOT NULL"), "vec_id", "embedding", "_label")
    # Copies of a vector act as one.
    classes = cut_lineage(points.groupBy("_label", "embedding").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    largest = classes.groupBy("_label").agg(
        F.count("*").alias("n"), F.max(F.size("embedding")).alias("widest")).agg(
        F.max("n"), F.sum("n"), F.max("widest")).first()
    most, n, widest = (value or 0 for value in largest)
    depth = min(DEEPEST, max(0, int(np.ceil(np.log2(max(1, most) / leaf)))))
    gap = float(np.sqrt(max(0.0, 2 - 2 * least)))
    if depth:
        share = min(1.0, SAMPLE / n)
        rows = classes.filter(F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < share * 1_000_000
                              ).select("rep", "embedding").collect()
        rows.sort()
        # As wide as the longest vector of the table, which need not be in the sample.
        sample = np.zeros((len(rows), widest))
        for k, row in enumerate(rows):
            sample[k, :len(row.embedding)] = row.embedding / np.linalg.norm(row.embedding)
        forest = plant(sample, depth, trees, gap)
    else:
        forest = Forest(np.zeros((1, 0, 1 << 16)), np.zeros((1, 0)), 0, gap)
    shared = spark.sparkContext.broadcast(forest)  # at most trees * 2**DEEPEST directions

    def route(batches):
        for labels, embeddings, reps, copies in batches:
            for name, vector, rep, n_copies in zip(labels, embeddings, reps, copies):
                unit = np.array(vector) / np.linalg.norm(vector)
                codes = shared.value.leaves(unit)
                for code in codes:
                    yield name, len(vector), code, rep, n_copies, unit, codes

    routed = map_rows(classes.select("_label", "embedding", "rep", "copies"), route,
                      "label string, size int, leaf long, rep long, copies long, "
                      "unit array<double>, leaves array<long>", batch_rows=1024)
    routed = written(routed, "leaves")
    blocks = routed.groupBy("label", "size", "leaf").agg(
        F.expr(f"(count(*) + {BLOCK - 1}) div {BLOCK}").alias("blocks"))
    dealt = routed.join(blocks, ["label", "size", "leaf"]).withColumn(
        "own", F.expr("pmod(xxhash64(rep), blocks)")).select(
        "label", "size", "leaf", F.explode(F.expr(
            "transform(sequence(0, blocks - 1), j -> named_struct('i', least(own, j), "
            "'j', greatest(own, j)))")).alias("p"), "own", "rep", "copies", "unit", "leaves")
    keys = ["label", "size", "leaf", "i", "j"]
    dealt = dealt.select("label", "size", "leaf", F.col("p.i").alias("i"), F.col("p.j").alias("j"),
                         "own", "rep", "copies", "unit", "leaves")
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "rep")

    def compare(batches):
        for (_, _, code, i, j), rows in _groups(batches, 5):
            own, reps, copies, units, leaves = zip(*rows)
            yield from _leaf_links(code, np.array(reps), np.array(copies), np.array(units),
                                   leaves, np.array(own), i, j, least)

    found = cut_lineage(map_rows(dealt, compare, "rep long, links long, low long"))
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.filter("rep <> low").select(
        F.col("rep").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "rep")
    described = (classes.join(sums, "rep", "left").join(joined, "rep", "left").select(
        "_label", "embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
        F.coalesce("component", "rep").alias("component")))
    described = described.withColumnRenamed("embedding", "_point")
    alone = ~(F.col("vec_id").isNotNull() & F.col("_label").isNotNull() & usable("embedding"))
    linked = named.filter(~alone).withColumn("_point", F.col("embedding").cast("array<double>"))
    result = (linked.join(described, ["_label", "_point"], "left")
              .select("vec_id", "links", "component")
              .unionByName(named.filter(alone).select("vec_id"), allowMissingColumns=True))
    component = F.coalesce("component", "vec_id")
    return result.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                         component.alias("component_id"),
                         F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
