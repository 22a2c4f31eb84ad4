"""Descriptive statistics of monthly series."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonwise.functions.dates import month_name
from seasonwise.functions.numeric import ratio, round_half_even, truncate
from seasonwise.operators.series import expand_levels
from seasonwise.schemas import ENTITY, LEVELS


def entity_cards(hierarchy: DataFrame, levels=LEVELS) -> DataFrame:
    """Names above each entity and the numbers of products, subgroups and groups below it.

    ``hierarchy`` holds the distinct products that were sold.
    """
    level = F.col("level")
    rows = expand_levels(hierarchy, levels)
    counted = rows.groupBy(*ENTITY).agg(
        F.min("subgroup").alias("subgroup"), F.min("group").alias("group"),
        F.min("category").alias("category"),
        F.count_distinct("product_code").alias("n_products"),
        F.count_distinct("subgroup").alias("n_subgroups"),
        F.count_distinct("group").alias("n_groups"))
    return counted.select(
        *ENTITY,
        F.when(level.isin("product", "subgroup"), F.col("subgroup")).alias("subgroup"),
        F.when(level != "category", F.col("group")).alias("group"),
        "category",
        F.when(level != "product", F.col("n_products")).alias("n_products"),
        F.when(level.isin("group", "category"), F.col("n_subgroups")).alias("n_subgroups"),
        F.when(level == "category", F.col("n_groups")).alias("n_groups"))


def monthly_statistics(series: DataFrame) -> DataFrame:
    """Mean (rounded), spread, extremes, quartiles and variation (all truncated)."""
    y = F.col("turnover")
    raw = series.groupBy(*ENTITY).agg(
        F.avg(y).alias("_mean"), F.stddev_samp(y).alias("_std"),
        F.min(y).alias("_min"), F.max(y).alias("_max"),
        F.percentile(y, [0.25, 0.5, 0.75]).alias("_q"))
    return raw.select(
        *ENTITY,
        truncate(round_half_even(F.col("_mean"))).alias("mean"),
        truncate(F.col("_std")).alias("std"),
        truncate(F.col("_min")).alias("min"),
        truncate(F.col("_max")).alias("max"),
        truncate(F.col("_q")[1]).alias("median"),
        truncate(F.col("_q")[0]).alias("q1"),
        truncate(F.col("_q")[2]).alias("q3"),
        truncate(ratio(F.col("_std"), F.col("_mean")) * 100).alias("cv_pct"))


def boxplot_numbers(series: DataFrame) -> DataFrame:
    """Fences, quartiles and mean of the box plot of monthly turnover.

    The lower fence is the minimum; the upper one is the largest value below
    q3 + 1.5 * (q3 - q1). An entity has one value per month, so its list stays small.
    """
    y = F.col("turnover")
    raw = series.groupBy(*ENTITY).agg(
        F.avg(y).alias("_mean"), F.min(y).alias("lower_fence"),
        F.percentile(y, [0.25, 0.5, 0.75]).alias("_q"), F.collect_list(y).alias("_y"))
    limit = F.col("_q")[2] + (F.col("_q")[2] - F.col("_q")[0]) * 1.5
    return raw.select(
        *ENTITY, "lower_fence",
        truncate(round_half_even(F.col("_q")[0])).alias("q1"),
        truncate(round_half_even(F.col("_q")[1])).alias("median"),
        truncate(round_half_even(F.col("_mean"))).alias("mean"),
        truncate(round_half_even(F.col("_q")[2])).alias("q3"),
        F.array_max(F.filter("_y", lambda v: v < limit)).alias("upper_fence"))


def line_chart(series: DataFrame) -> DataFrame:
    """Month name and turnover, one point per month."""
    return series.select(*ENTITY, "month_start",
                         month_name(F.col("month_start")).alias("month_name"), "turnover")
