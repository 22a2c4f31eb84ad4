"""Neutralising the regular promo day of each month."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seasonwise.functions.joins import checked_join
from seasonwise.functions.numeric import ratio, round_half_even
from seasonwise.functions.windows import by_product
from seasonwise.operators.series import period_column
from seasonwise.schemas import HIERARCHY, MIN_MONTHS, PROMO_DAY


def promo_baseline(sales: DataFrame, promo_day: int = PROMO_DAY) -> DataFrame:
    """Mean quantity per row outside the promo day, per product and calendar month."""
    return (sales.filter(F.dayofmonth("date") != promo_day)
            .groupBy("product_code", F.month("date").alias("month"))
            .agg(round_half_even(F.avg("turnover_qty")).alias("baseline")))


def promo_rules(sales: DataFrame, promo_day: int = PROMO_DAY,
                min_months: int = MIN_MONTHS) -> DataFrame:
    """Baseline of every product and calendar month, with both completeness gates.

    Columns: product_code, month, baseline (NULL where only promo days were sold),
    base_months, all_months, keep.
    """
    ordinary = F.dayofmonth("date") != promo_day
    months = (sales.groupBy("product_code", F.month("date").alias("month"))
              .agg(round_half_even(F.avg(F.when(ordinary, F.col("turnover_qty"))))
                   .alias("baseline")))
    counted = months.select(
        "product_code", "month", "baseline",
        F.count("baseline").over(by_product()).alias("base_months"),
        F.count(F.lit(1)).over(by_product()).alias("all_months"))
    return counted.withColumn("keep", _complete(min_months))


def _complete(min_months: int):
    """Ordinary sales in every month, or promo-day sales only and those in every month."""
    return ((F.col("base_months") == min_months)
            | ((F.col("base_months") == 0) & (F.col("all_months") == min_months)))


def incomplete_products(sales: DataFrame, promo_day: int = PROMO_DAY,
                        min_months: int = MIN_MONTHS) -> DataFrame:
    """First gate: products with ordinary sales, but not in every calendar month."""
    return (promo_baseline(sales, promo_day).groupBy("product_code")
            .agg(F.count(F.lit(1)).alias("months"))
            .filter(F.col("months") != min_months))


def complete_products(sales: DataFrame, promo_day: int = PROMO_DAY,
                      min_months: int = MIN_MONTHS) -> DataFrame:
    """Products that pass both gates."""
    return (promo_rules(sales, promo_day, min_months).filter("keep")
            .groupBy("product_code").agg(F.max("all_months").alias("months")))


def neutralise_promo(sales: DataFrame, promo_day: int = PROMO_DAY,
                     min_months: int = MIN_MONTHS) -> DataFrame:
    """Facts of complete products with promo-day quantities replaced by the baseline.

    Facts are read twice but joined once, against a table of at most twelve rows per
    product. Series do not need this: ``promo_free_totals`` gives their sums without a join.
    """
    rules = (promo_rules(sales, promo_day, min_months).filter("keep")
             .select("product_code", "month", "baseline"))
    facts = sales.withColumn("month", F.month("date"))
    joined = checked_join(facts, rules, ["product_code", "month"],
                          salt_by=["date", "turnover_qty"])
    replaced = F.when(F.dayofmonth("date") == promo_day,
                      F.coalesce("baseline", "turnover_qty")).otherwise(F.col("turnover_qty"))
    return joined.withColumn("turnover_qty", replaced).select(*sales.columns, "month")


def promo_free_totals(sales: DataFrame, period: str = "month", promo_day: int = PROMO_DAY,
                      min_months: int = MIN_MONTHS) -> DataFrame:
    """Product totals per month or day of ``neutralise_promo`` in one pass over the facts.

    A promo-day row contributes either its month's baseline or its own quantity, so sums
    and row counts per product and period are enough; the facts need no join at all.
    """
    ordinary = F.dayofmonth("date") != promo_day
    quantity = F.col("turnover_qty")
    keys = ["product_code", *[c for c in HIERARCHY if c in sales.columns]]
    name, start = period_column(period)
    sums = sales.groupBy(*keys, start.alias(name)).agg(
        F.sum(F.when(ordinary, quantity)).alias("_ordinary"),
        F.count(F.when(ordinary, quantity)).alias("_ordinary_rows"),
        F.sum(F.when(~ordinary, quantity)).alias("_promo"),
        F.count(F.when(~ordinary, quantity)).alias("_promo_rows"))
    # Calendar months as bits: which ones were sold at all, and which on ordinary days.
    bit = F.expr(f"shiftleft(1, month({name}))")
    gated = sums.select(
        "*", F.month(name).alias("_month"),
        F.bit_count(F.bit_or(bit).over(by_product())).alias("all_months"),
        F.bit_count(F.coalesce(F.bit_or(F.when(F.col("_ordinary_rows") > 0, bit))
                               .over(by_product()), F.lit(0))).alias("base_months")
    ).filter(_complete(min_months))
    # These windows need no new shuffle: a product is in one partition already.
    pooled = Window.partitionBy("product_code", "_month")
    gated = gated.withColumn("baseline", round_half_even(ratio(
        F.sum("_ordinary").over(pooled), F.sum("_ordinary_rows").over(pooled))))
    promo = F.coalesce(F.col("baseline") * F.col("_promo_rows"), F.col("_promo"), F.lit(0.0))
    return gated.select(*keys, name,
                        (F.coalesce("_ordinary", F.lit(0.0)) + promo).alias("turnover"))
