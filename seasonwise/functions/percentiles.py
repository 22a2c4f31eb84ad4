"""Exact percentiles of groups of any size."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonwise.functions.joins import salted_join

SKETCH_ACCURACY = 10_000
# Equal parts of a bracket.
BINS = 4096


def exact_percentiles(df: DataFrame, keys: list[str], value: str,
                      percents: dict[str, float], accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """Linearly interpolated percentiles, one row per key, one column per ``percents`` name.

    ``percentile`` would keep all values of a key in one buffer. Here a mergeable sketch of
    bounded size first gives, per key and percentile, two values that enclose the wanted
    ranks. Everything below the lower one is only counted, everything above the upper one
    is dropped, and the few values in between are counted in ``BINS`` bins; just the values of
    the bins with a wanted rank are sorted, so that no task sorts all values of a key. The
    result is exact: the sketch is off by at most n/accuracy ranks and the bracket reaches
    three times as far.
    Keys with no more than ``accuracy`` values are ranked without a bracket.
    """
    values = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    names, reach = list(percents), 3.0 / accuracy
    shares = [percents[name] / 100.0 for name in names]
    bounds = [b for s in shares for b in (max(s - reach, 0.0), min(s + reach, 1.0))]

    sketch = values.groupBy(*keys).agg(
        F.count("_v").alias("_n"),
        F.percentile_approx("_v", bounds, accuracy).alias("_b"),
    )
    small = F.col("_n") <= accuracy
    targets = sketch.select(*keys, F.explode(F.array(*[
        F.struct(
            F.lit(name).alias("_name"),
            F.when(~small, F.col("_b")[2 * i]).alias("_low"),
            F.when(~small, F.col("_b")[2 * i + 1]).alias("_high"),
            ((F.col("_n") - 1) * F.lit(share)).alias("_pos"),
        ) for i, (name, share) in enumerate(zip(names, shares))
    ])).alias("_t")).select(*keys, "_t.*")

    bracketed = salted_join(values, targets, keys, [*keys, "_v"]).filter(
        F.col("_high").isNull() | (F.col("_v") <= F.col("_high")))
    # NULL stands for all values below the bracket and sorts first.
    counted = bracketed.groupBy(*keys, "_name", "_pos", _bin().alias("_bin"), F.when(
        F.col("_low").isNull() | (F.col("_v") >= F.col("_low")), F.col("_v")).alias("_v")
    ).agg(F.count(F.lit(1)).alias("_c"))

    position, fraction = F.floor("_pos"), F.col("_pos") - F.floor("_pos")
    def holds(rank):
        return (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_c") < rank)

    # The bins that hold a wanted rank, by their counts: at most two per percentile.
    bins = counted.groupBy(*keys, "_name", "_bin").agg(F.sum("_c").alias("_c"),
                                                       F.max("_pos").alias("_pos"))
    upto = Window.partitionBy(*keys, "_name").orderBy("_bin").rowsBetween(
        Window.unboundedPreceding, 0)
    wanted = (bins.withColumn("_upto", F.sum("_c").over(upto))
              .filter(holds(position + 1) | holds(position + 2))
              .select(*keys, "_name", "_bin", (F.col("_upto") - F.col("_c")).alias("_before")))
    inside = Window.partitionBy(*keys, "_name", "_bin").orderBy(
        F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.join(wanted, [*keys, "_name", "_bin"]).withColumn(
        "_upto", F.col("_before") + F.sum("_c").over(inside))
    picked = ranked.groupBy(*keys, "_name").agg(
        F.max(F.when(holds(position + 1), F.col("_v"))).alias("_lower"),
        F.max(F.when(holds(position + 2), F.col("_v"))).alias("_upper"),
        F.max(fraction).alias("_f"),
    ).select(*keys, "_name", F.coalesce(
        F.when(F.col("_f") == 0, F.col("_lower")),
        F.col("_lower") + (F.col("_upper") - F.col("_lower")) * F.col("_f"),
        F.raise_error(F.lit("percentile outside its bracket")).cast("double"),
    ).alias("_p"))
    return picked.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_name") == name, F.col("_p"))).alias(name) for name in names])


def _bin() -> Column:
    """Bin of a value in its bracket: never falls as the value grows; -1 below the bracket.

    A bracket with an infinite end has its infinite values, or all, in the last bin.
    """
    low, high, v = F.col("_low"), F.col("_high"), F.col("_v")
    # Also defined above the bracket, as the planner may compute it before such values are dropped;
    # NaN counts as the greatest value.
    share = F.when(high > low, F.least((v - low) / (high - low), F.lit(1.0))).otherwise(0.0)
    return F.when(low.isNull(), 0).when(v < low, -1).otherwise(
        F.floor(share * BINS)).cast("int")
