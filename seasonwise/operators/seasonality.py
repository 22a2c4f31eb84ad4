"""Seasonal thresholds, months of high and low demand, and their peak days."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonwise.functions.dates import months_spanned
from seasonwise.functions.joins import salted_join
from seasonwise.functions.numeric import ratio, round_half_even
from seasonwise.functions.percentiles import exact_percentiles
from seasonwise.functions.text import display_number
from seasonwise.functions.windows import by_product
from seasonwise.operators.clean import attach_hierarchy
from seasonwise.operators.select import entity_products, per_request
from seasonwise.operators.series import calendar_product_totals, expand_levels
from seasonwise.schemas import (ENTITY, PROMO_DAY, SEASON_THRESHOLD, THRESHOLD_PERCENT,
                                THRESHOLD_PERCENT_BY_CATEGORY)

def product_month_coefficients(sales: DataFrame,
                               products: DataFrame | None = None) -> DataFrame:
    """Month total of each product divided by the mean of its existing month totals."""
    totals = calendar_product_totals(sales)
    mean = F.avg("turnover").over(by_product())
    coefficients = totals.withColumn("coefficient", ratio(F.col("turnover"), mean))
    return coefficients if products is None else attach_hierarchy(coefficients, products)


def category_thresholds(coefficients: DataFrame, percent: float = THRESHOLD_PERCENT,
                        by_category: dict[str, float] | None = None) -> DataFrame:
    """Percentile of all coefficients of each category, two decimals."""
    special = THRESHOLD_PERCENT_BY_CATEGORY if by_category is None else by_category
    percents = {f"_p{i}": p for i, p in enumerate(sorted({percent, *special.values()}))}
    column = {p: F.col(name) for name, p in percents.items()}
    found = exact_percentiles(coefficients.filter(F.col("category").isNotNull()),
                              ["category"], "coefficient", percents)
    chosen = column[percent]
    for category, p in special.items():
        chosen = F.when(F.col("category") == category, column[p]).otherwise(chosen)
    return found.select("category", round_half_even(chosen, 2).alias("threshold"))


def request_categories(resolved: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Category each resolved request belongs to; the first by name if there are several."""
    by_entity = (entity_products(resolved, hierarchy).groupBy("level", "entity")
                 .agg(F.min("category").alias("category")))
    return per_request(by_entity, resolved).select("request_id", "level", "entity", "category")


def coefficient_histogram(coefficients: DataFrame, limit: float = 5.0,
                          bins_per_unit: int = 10) -> DataFrame:
    """Share in percent of the coefficients below ``limit`` in each bin of a category."""
    counted = (coefficients.filter(F.col("category").isNotNull())
               .filter(F.col("coefficient") < limit)
               .groupBy("category",
                        F.floor(F.col("coefficient") * bins_per_unit).alias("bin"))
               .agg(F.count(F.lit(1)).alias("n")))
    total = F.sum("n").over(Window.partitionBy("category"))
    return counted.select("category", (F.col("bin") / float(bins_per_unit)).alias("bin_start"),
                          "n", (F.col("n") * 100.0 / total).alias("share_pct"))


def _month_class(coefficient: Column, threshold: Column) -> Column:
    return (F.when(coefficient > threshold, "high")
            .when(coefficient < 1 - (threshold - 1), "low")
            .when(coefficient.isNotNull() & threshold.isNotNull(), "normal"))


def _threshold(threshold: float | None) -> Column:
    return F.col("threshold") if threshold is None else F.lit(float(threshold))


def month_classes(spans: DataFrame, threshold: float | None = SEASON_THRESHOLD) -> DataFrame:
    """Month coefficient of each entity and its class: high, low or normal.

    ``spans`` is the gap-filled monthly frame. With ``threshold`` None its own column
    ``threshold`` is used.
    """
    coefficient = ratio(F.col("turnover"), F.col("mean"))
    limit = _threshold(threshold)
    return spans.select(*ENTITY, "month_start", "turnover", coefficient.alias("coefficient"),
                        limit.alias("threshold"),
                        _month_class(coefficient, limit).alias("month_class"))


def with_category_threshold(spans: DataFrame, thresholds: DataFrame,
                            hierarchy: DataFrame) -> DataFrame:
    """Give every entity the threshold of its category (the first by name if several).

    Entities without a category, or of one without a threshold, stay with a NULL threshold.
    """
    categories = (expand_levels(hierarchy).groupBy(*ENTITY)
                  .agg(F.min("category").alias("category"))
                  .filter(F.col("category").isNotNull()))
    per_entity = salted_join(categories, thresholds, ["category"], salt_by=ENTITY)
    return spans.join(per_entity.select(*ENTITY, "threshold"), ENTITY, "left")


def deviation_table(classes: DataFrame) -> DataFrame:
    """Month, turnover, deviation from the mean in percent, and their display texts."""
    deviation = F.col("coefficient") * 100 - 100
    return classes.select(
        *ENTITY, "month_start", "turnover", deviation.alias("deviation_pct"),
        display_number(F.col("turnover"), 0).alias("turnover_text"),
        display_number(deviation, 2, signed=True).alias("deviation_text"),
        "month_class")


def deviation_bars(classes: DataFrame) -> DataFrame:
    """Bar height, whether it passes the threshold, and a signed label."""
    deviation = F.col("coefficient") - 1
    beyond = F.abs(deviation) * 100 > (F.col("threshold") - 1) * 100
    return classes.select(
        *ENTITY, "month_start",
        (round_half_even(deviation, 4) * 100).alias("bar_pct"),
        F.when(beyond & (deviation < 0), "low").when(beyond, "high")
        .when(beyond.isNotNull(), "within").alias("bar_class"),
        display_number(deviation * 100, 2, signed=True, decimal_mark=".").alias("label"))


def season_markers(classes: DataFrame) -> DataFrame:
    """High and low months with their turnover."""
    return (classes.filter(F.col("month_class").isin("high", "low"))
            .select(*ENTITY, "month_start", "month_class", "turnover"))


def _month_days(days: DataFrame, threshold: float) -> DataFrame:
    """Months of high and low demand with the days of each that are known.

    ``days`` holds sold days; gap-filled ones do as well. Months without any between the first
    and the last count too. A month is one row: ``sold`` maps its known days to their turnover,
    ``since`` and ``until`` bound those of its days that lie within the entity's life.
    """
    months = (days.groupBy(*ENTITY, F.trunc("day", "MM").alias("seen"))
              .agg(F.sum("turnover").alias("turnover"), F.min("day").alias("_first"),
                   F.max("day").alias("_last"),
                   F.map_from_entries(F.collect_list(F.struct("day", "turnover"))).alias("sold")))
    over = "OVER (PARTITION BY level, entity)"
    spanned = months.selectExpr(
        *ENTITY, "seen", "turnover", "sold",
        "lead(seen) OVER (PARTITION BY level, entity ORDER BY seen) AS after",
        f"min(_first) {over} AS first", f"max(_last) {over} AS last", f"sum(turnover) {over} AS total")
    filled = spanned.selectExpr(
        "*", "explode(sequence(seen, coalesce(add_months(after, -1), seen), INTERVAL 1 MONTH)) "
        "AS month_start")
    known = F.col("month_start") == F.col("seen")
    turnover = F.when(known, F.col("turnover")).otherwise(0.0)
    coefficient = ratio(turnover, F.col("total") / months_spanned(F.col("first"), F.col("last")))
    rated = filled.select(
        *ENTITY, "month_start", coefficient.alias("coefficient"),
        F.when(known, F.col("sold")).alias("sold"),
        F.greatest("month_start", "first").alias("since"),
        F.least(F.last_day("month_start"), F.col("last")).alias("until"))
    return rated.withColumn("month_class", _month_class(
        F.col("coefficient"), F.lit(float(threshold)))).filter(
        F.col("month_class").isin("high", "low"))


# Days as (day, turnover): those that are known, or all of the month with zeros.
_SOLD = "coalesce(map_entries(sold), array())"
_EVERY = ("transform(sequence(since, until), d -> struct(d AS key, "
          "coalesce(element_at(sold, d), 0.0D) AS value))")


def peak_days(days: DataFrame, threshold: float = SEASON_THRESHOLD,
              promo_day: int = PROMO_DAY) -> DataFrame:
    """Day with most sales of each high month and with least of each low one.

    The promo day does not count and the earlier day wins a tie. The deviation is positive
    for low months too. Only low months, and high ones that sold on the promo day alone, are
    looked at day by day.
    """
    ordinary = f"e -> dayofmonth(e.key) <> {int(promo_day)}"
    high = F.col("month_class") == "high"
    chosen = _month_days(days, threshold).withColumn("_sold", F.expr(
        f"filter({_SOLD}, {ordinary})")).withColumn("_days", F.expr(
            f"CASE WHEN month_class = 'high' AND exists(_sold, e -> e.value > 0) THEN _sold "
            f"ELSE filter({_EVERY}, {ordinary}) END"))
    most = F.expr("array_max(transform(_days, e -> struct(e.value AS v, "
                  "-dayofmonth(e.key) AS n, e.key AS day))).day")
    least = F.expr("array_min(transform(_days, e -> struct(e.value AS v, "
                   "dayofmonth(e.key) AS n, e.key AS day))).day")
    c = F.col("coefficient")
    return chosen.select(
        *ENTITY, "month_start", "month_class", F.when(high, most).otherwise(least).alias("day"),
        round_half_even(F.when(high, c - 1).otherwise(1 - c) * 100, 2).alias("deviation_pct"))


def extreme_days(days: DataFrame, threshold: float = SEASON_THRESHOLD) -> DataFrame:
    """All days that equal the maximum of a high month or the minimum of a low one."""
    listed = _month_days(days, threshold).withColumn("_days", F.expr(
        f"CASE WHEN month_class = 'high' THEN {_SOLD} ELSE {_EVERY} END"))
    wanted = ("CASE WHEN month_class = 'high' THEN array_max(transform(_days, e -> e.value)) "
              "ELSE array_min(transform(_days, e -> e.value)) END")
    return (listed.withColumn("_wanted", F.expr(wanted))
            .selectExpr(*ENTITY, "month_start", "month_class",
                        "inline(filter(_days, e -> e.value = _wanted))")
            .withColumnsRenamed({"key": "day", "value": "turnover"}))
