"""Joins of large tables whose keys may be heavily skewed."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest side that is sent to every executor, by the planner's estimate.
BROADCAST_BYTES = 16 << 20


def salts_for(df: DataFrame) -> int:
    """Shares of a hot key: they grow with the cluster, as do the copies of the other side."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, math.isqrt(partitions))


def salted_join(large: DataFrame, small: DataFrame, on: list[str], salt_by: list[str],
                how: str = "inner", salts: int | None = None) -> DataFrame:
    """Equi-join that spreads each key of ``large`` over ``salts`` partitions.

    By default their number follows the shuffle partitions.

    The salt is a hash of row content, so a recomputed task sends every row to the same
    place; each row of ``small`` is repeated once per salt. When ``small`` turns out to be
    below the broadcast limit at run time, the adaptive planner broadcasts it instead.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type: {how}")
    salts = salts or salts_for(large)
    left = large.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def checked_join(facts: DataFrame, small: DataFrame, on: list[str], salt_by: list[str],
                 how: str = "inner", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join that spares facts their shuffle if the other side is small enough.

    The planner's estimate of the other side decides, without running anything: up to
    ``broadcast_bytes`` it is broadcast and the facts stay where they are, beyond that both
    sides are shuffled with salt.
    """
    if planned_bytes(small) <= broadcast_bytes:
        return facts.join(F.broadcast(small), on, how)
    return salted_join(facts, small, on, salt_by, how)


def planned_bytes(df: DataFrame) -> int:
    """Estimated size of the result, from the optimized plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
