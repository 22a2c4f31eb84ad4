"""Positions in sorted groups of any size."""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of the bounded sample that stand behind each block.
SAMPLED_PER_BLOCK = 32


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                  name: str = "position", blocks: int | None = None) -> DataFrame:
    """``df`` with the place of each row among those of equal ``keys``, from 1, in ascending order.

    A window per key would sort a whole group in one task. Here all rows are cut by range into
    blocks; a row's place is its place among the rows of its key in its block, and the number of
    rows of the key in the blocks before. A window so holds one block of one key, or one count per
    block. The cuts come from the rows with the smallest hashes, a fixed number per block, and only
    decide how even the blocks are; rows that are equal in keys and order stay in one. Rows with
    null keys are a group, nulls sort first, and equal rows have distinct places. ``order`` holds
    expressions that sort ascending, such as ``-F.col("n")``.
    """
    blocks = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = [F.col(f"`{k}`") for k in keys] + list(order)
    placed = df.withColumn("_s", F.struct(*[c.alias(f"c{i}") for i, c in enumerate(whole)]))
    cuts = _cuts(placed.select("_s"), blocks)
    placed = placed.withColumn("_cuts", cuts.scalar()).withColumn("_block", _block(blocks)).drop(
        "_cuts")
    groups = ["_block", *keys]
    totals = placed.groupBy(*groups).agg(F.count(F.lit(1)).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(f"`{g}`").alias(f"_b{i}") for i, g in enumerate(groups)],
                           F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    same = [F.col(f"`{g}`").eqNullSafe(F.col(f"_b{i}")) for i, g in enumerate(groups)]
    local = Window.partitionBy(*groups).orderBy("_s")
    return placed.withColumn("_local", F.row_number().over(local)).join(before, same).select(
        *[f"`{c}`" for c in df.columns],
        (F.col("_local") + F.col("_before")).cast("int").alias(name))


def _cuts(rows: DataFrame, blocks: int) -> DataFrame:
    """One row: sorted starts of at most ``blocks`` ranges of about equal size."""
    sample = rows.select("_s", F.xxhash64("_s").alias("_h")).orderBy("_h").limit(
        blocks * SAMPLED_PER_BLOCK)
    return sample.agg(F.sort_array(F.collect_list("_s")).alias("a")).select(F.expr(
        f"transform(filter(sequence(0, greatest(size(a) - 1, 0)), i -> i > 0 AND "
        f"i % {SAMPLED_PER_BLOCK} = 0), i -> a[i])").alias("cuts"))


def _block(blocks: int) -> Column:
    """Number of cuts up to a row: first among every ``step``-th, then in one stretch."""
    step = max(1, math.isqrt(blocks))
    coarse = (f"size(filter(transform(sequence(0, (size(_cuts) - 1) div {step}), i -> "
              f"_cuts[i * {step}]), v -> v <= _s))")
    fine = (f"aggregate(array({coarse}), 0, (t, c) -> IF(c = 0, 0, (c - 1) * {step} + "
            f"size(filter(slice(_cuts, (c - 1) * {step} + 1, {step}), v -> v <= _s))))")
    return F.expr(f"IF(size(_cuts) = 0, 0, {fine})")
