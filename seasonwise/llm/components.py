"""Connected components of a graph given by its edges, for any size of component."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonwise.llm.common import cut_lineage


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``node, component`` (its smallest node) of every node of ``edges`` (``a, b`` longs).

    Alternates large-star and small-star steps, a number of rounds that grows with the
    logarithm of the size; each is a pre-aggregated minimum and a join that the adaptive
    planner can split on a hot node. Nothing is collected. Loops and repeated edges do not
    matter; an empty table gives none.
    """
    nodes = edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a"))
    stars = cut_lineage(nodes.filter("a <> b").distinct().select("a", "b"))
    for _ in range(max_rounds):
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("low"))
        large = (both.join(lowest, "a").filter("b > a")
                 .select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (large.join(lowest, "a").filter("b <> low")
                 .select(F.col("b").alias("a"), F.col("low").alias("b"))
                 .union(lowest.select("a", F.col("low").alias("b")))).distinct()
        after = cut_lineage(small)
        if _same(stars, after):
            break
        stars = after
    else:
        raise RuntimeError("components did not settle")
    # Settled: every node hangs on its smallest one.
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _same(before: DataFrame, after: DataFrame) -> bool:
    def state(df):
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")),
                            F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first())
    return state(before) == state(after)
