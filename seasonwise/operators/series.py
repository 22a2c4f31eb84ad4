"""Monthly and daily series of every entity of the hierarchy.

Facts are summed per product and period first. The hierarchy is joined to those sums, and
only then are they expanded to the other levels, so the facts themselves are shuffled once.
Gaps are filled from each period to the next one with a window, without a calendar join.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonwise.functions.dates import month_start, months_spanned
from seasonwise.operators.clean import attach_hierarchy
from seasonwise.schemas import ENTITY, HIERARCHY, LEVEL_COLUMNS, LEVELS

MODEL_MONTHS = 24


def period_column(period: str):
    """Name and expression of the start of each fact's period, ``month`` or ``day``."""
    if period == "month":
        return "month_start", month_start(F.col("date"))
    if period == "day":
        return "day", F.col("date")
    raise ValueError(f"unknown period: {period}")


def product_totals(sales: DataFrame, period: str = "month") -> DataFrame:
    """Sum per product and month (or day), keeping hierarchy columns that are present.

    Totals that are there already, such as promo-free ones, pass through; so every operator
    that starts here takes either facts or totals.
    """
    name, start = period_column(period)
    if name in sales.columns:
        return sales
    keys = ["product_code", *[c for c in HIERARCHY if c in sales.columns]]
    return sales.groupBy(*keys, start.alias(name)).agg(F.sum("turnover_qty").alias("turnover"))


def level_totals(totals: DataFrame, products: DataFrame | None = None,
                 levels=LEVELS) -> DataFrame:
    """Product totals summed for every entity of ``levels``; unnamed entities are left out."""
    time = "month_start" if "month_start" in totals.columns else "day"
    if products is not None and tuple(levels) != ("product",):
        totals = attach_hierarchy(totals.select("product_code", time, "turnover"), products)
    return (expand_levels(totals, levels).groupBy(*ENTITY, time)
            .agg(F.sum("turnover").alias("turnover")))


def expand_levels(rows: DataFrame, levels=LEVELS) -> DataFrame:
    """Repeat every row once per level with its ``level`` and ``entity``."""
    pairs = ", ".join(f"struct('{level}' AS level, CAST(`{LEVEL_COLUMNS[level]}` AS STRING) "
                      "AS entity)" for level in levels)
    return rows.selectExpr("*", f"inline(array({pairs}))").filter("entity IS NOT NULL")


def fill_gaps(totals: DataFrame, time: str, keys=ENTITY) -> DataFrame:
    """Add the missing periods between the first and last one of each entity as zeros.

    Also adds, per entity, the first and last period, their number, the total and the mean.
    """
    by = ", ".join(keys)
    over = f"OVER (PARTITION BY {by})"
    spanned = totals.selectExpr(
        *keys, f"{time} AS seen", "turnover",
        f"lead({time}) OVER (PARTITION BY {by} ORDER BY {time}) AS after",
        f"min({time}) {over} AS first", f"max({time}) {over} AS last",
        f"sum(turnover) {over} AS total")
    if time == "month_start":
        until, step, periods = ("add_months(after, -1)", "INTERVAL 1 MONTH",
                                "(year(last) - year(first)) * 12 + month(last) - month(first) + 1")
    else:
        until, step, periods = "date_sub(after, 1)", "INTERVAL 1 DAY", "datediff(last, first) + 1"
    filled = spanned.selectExpr(
        "*", f"{periods} AS periods",
        f"explode(sequence(seen, coalesce({until}, seen), {step})) AS {time}")
    return filled.selectExpr(
        *keys, time, f"CASE WHEN {time} = seen THEN turnover ELSE 0.0D END AS turnover",
        "first", "last", "periods", "total", "total / periods AS mean")


def _spans(sales: DataFrame, products: DataFrame | None, levels, period: str) -> DataFrame:
    name, _ = period_column(period)
    if tuple(levels) == ("product",):
        totals = product_totals(sales.drop(*HIERARCHY), period)
        return fill_gaps(totals, name, ["product_code"]).selectExpr(
            "'product' AS level", "CAST(product_code AS STRING) AS entity", name, "turnover",
            "first", "last", "periods", "total", "mean")
    return fill_gaps(level_totals(product_totals(sales, period), products, levels), name)


def monthly_spans(sales: DataFrame, products: DataFrame | None = None,
                  levels=LEVELS) -> DataFrame:
    """Gap-filled months of every entity with its span and mean."""
    return _spans(sales, products, levels, "month")


def daily_spans(sales: DataFrame, products: DataFrame | None = None,
                levels=LEVELS) -> DataFrame:
    """Gap-filled days of every entity with its span and mean."""
    return _spans(sales, products, levels, "day")


def monthly_series(sales: DataFrame, products: DataFrame | None = None,
                   levels=LEVELS) -> DataFrame:
    """(level, entity, month_start, turnover), missing months as 0."""
    return monthly_spans(sales, products, levels).select(*ENTITY, "month_start", "turnover")


def daily_series(sales: DataFrame, products: DataFrame | None = None,
                 levels=LEVELS) -> DataFrame:
    """(level, entity, day, turnover), missing days as 0."""
    return daily_spans(sales, products, levels).select(*ENTITY, "day", "turnover")


def model_window(spans: DataFrame) -> DataFrame:
    """First twelve months and those from the 25th on, numbered t = 1..24.

    The twelve months in between are a skipped year. Only entities that give exactly 24
    points, that is 36 months from first to last, can be modelled.
    """
    number = months_spanned(F.col("first"), F.col("month_start"))
    return (spans.filter(F.col("periods") == MODEL_MONTHS + 12)
            .withColumn("_n", number).filter((F.col("_n") <= 12) | (F.col("_n") > 24))
            .select(*ENTITY,
                    F.when(F.col("_n") <= 12, F.col("_n")).otherwise(F.col("_n") - 12)
                    .cast("int").alias("t"),
                    "month_start", "turnover"))


def without_window(spans: DataFrame) -> DataFrame:
    """Entities that ``model_window`` leaves out, with their first and last month and span."""
    return (spans.filter(F.col("periods") != MODEL_MONTHS + 12)
            .select(*ENTITY, "first", "last", "periods").distinct())


def calendar_totals(totals: DataFrame, key: list[str]) -> DataFrame:
    """Sums per key and calendar month 1..12 with the years pooled, without gap filling."""
    return (totals.groupBy(*key, F.month("month_start").alias("month"))
            .agg(F.sum("turnover").alias("turnover")))


def calendar_product_totals(sales: DataFrame) -> DataFrame:
    """``calendar_totals`` per product from facts or month totals, with hierarchy if present."""
    keys = ["product_code", *[c for c in HIERARCHY if c in sales.columns]]
    if "month_start" in sales.columns:
        return calendar_totals(sales, keys)
    return (sales.groupBy(*keys, F.month("date").alias("month"))
            .agg(F.sum("turnover_qty").alias("turnover")))
