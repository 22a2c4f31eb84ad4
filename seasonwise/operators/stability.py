"""X/Y/Z classes: how evenly products and groups sell over the months of a year."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seasonwise.functions.joins import salted_join
from seasonwise.functions.numeric import ratio, round_half_even
from seasonwise.functions.percentiles import exact_percentiles
from seasonwise.functions.ranks import with_position
from seasonwise.functions.text import display_number
from seasonwise.functions.windows import by_product
from seasonwise.operators.clean import attach_hierarchy, keep_year
from seasonwise.operators.series import calendar_product_totals
from seasonwise.schemas import HIERARCHY, MIN_MONTHS, XYZ_PERCENTS

SECTORS = ("X", "Y", "Z")


def complete_year_totals(sales: DataFrame, year: int | None,
                         products: DataFrame | None = None,
                         min_months: int = MIN_MONTHS) -> DataFrame:
    """Month totals of products sold in all twelve months of the year, with hierarchy."""
    totals = calendar_product_totals(keep_year(sales, year))
    months = F.count(F.lit(1)).over(by_product())
    complete = totals.withColumn("_months", months).filter(
        F.col("_months") == min_months).drop("_months")
    if products is not None:
        complete = attach_hierarchy(complete.drop(*HIERARCHY), products)
    return complete


def _variation(totals: DataFrame, keys: list[str]) -> DataFrame:
    """Sample deviation over mean of the month totals of each key, in percent.

    The windows add up in calendar order, so equal series give equal values however their
    rows arrive; the values are compared with limits that may equal them exactly.
    """
    months = Window.partitionBy(*keys).orderBy("month")
    whole = months.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    centred = totals.select(
        *keys, "month", F.avg("turnover").over(whole).alias("_mean"),
        (F.col("turnover") - F.avg("turnover").over(whole)).alias("_d"))
    rated = centred.select(
        *keys, "_mean", F.row_number().over(months).alias("_rn"),
        F.sum(F.col("_d") * F.col("_d")).over(whole).alias("_squares"),
        F.count("_d").over(whole).alias("_n"))
    deviation = F.sqrt(ratio(F.col("_squares"), (F.col("_n") - 1).cast("double")))
    return rated.filter("_rn = 1").select(
        *keys, (ratio(deviation, F.col("_mean")) * 100).alias("variation"))


def product_variation(complete: DataFrame) -> DataFrame:
    """Variation of the month totals of each product with a category.

    The limits take all of them; classes are for ``named_products``.
    """
    return _variation(complete.filter("category IS NOT NULL"), ["product_code", *HIERARCHY])


def named_products(variation: DataFrame) -> DataFrame:
    """Products with a full hierarchy."""
    return variation.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in HIERARCHY))


def group_variation(complete: DataFrame) -> DataFrame:
    """Variation of whole groups, built from their complete products.

    A group is known by its name alone. One that occurs under several categories has one
    variation and a row for each of them, to be compared with the limits of each.
    """
    named = complete.filter("category IS NOT NULL AND `group` IS NOT NULL")
    totals = named.groupBy("group", "category", "month").agg(F.sum("turnover").alias("turnover"))
    categories = totals.select("group", "category").distinct()
    whole = totals.groupBy("group", "month").agg(F.sum("turnover").alias("turnover"))
    return _variation(whole, ["group"]).join(categories, "group").select(
        "category", "group", "variation")


def category_limits(variation: DataFrame, percents=XYZ_PERCENTS) -> DataFrame:
    """Percentiles of the variation of all complete products of each category."""
    x, y = percents
    return exact_percentiles(variation, ["category"], "variation",
                             {"x_limit": x, "y_limit": y})


def classify(variation: DataFrame, limits: DataFrame) -> DataFrame:
    """Add the category's limits and the sector: X up to the first, Y up to the second.

    Every row stays: without a variation, or in a category without limits, the sector is NULL.
    """
    salt_by = [c for c in ("product_code", "group") if c in variation.columns]
    v = F.col("variation")
    return salted_join(variation, limits, ["category"], salt_by=salt_by, how="left").withColumn(
        "sector", F.when(v <= F.col("x_limit"), "X").when(v <= F.col("y_limit"), "Y")
        .when(v > F.col("y_limit"), "Z"))


def sector_summary(classified: DataFrame) -> DataFrame:
    """Three rows per category: number of products and the limits as text."""
    x, y = (display_number(F.col(c), 0) for c in ("x_limit", "y_limit"))
    texts = {"X": F.concat(F.lit("V<="), x), "Y": F.concat(x, F.lit("<V<="), y),
             "Z": F.concat(F.lit("V>"), y)}
    counts = classified.groupBy("category", "x_limit", "y_limit").agg(
        *[F.count_if(F.col("sector") == s).alias(s) for s in SECTORS])
    rows = [F.struct(F.lit(s).alias("sector"), F.col(s).alias("n_products"),
                     texts[s].alias("limits")) for s in SECTORS]
    return counts.select("category", F.explode(F.array(*rows)).alias("_r")).select(
        "category", "_r.*")


def product_table(classified: DataFrame, rows: int | None = None) -> DataFrame:
    """Products with their variation as text and sector: all, or the first ``rows``."""
    table = classified.select(
        "category", "group", "subgroup", "product_code",
        display_number(F.col("variation"), 2).alias("variation"), "sector"
    ).orderBy("category", "group", "subgroup", "product_code")
    return table if rows is None else table.limit(rows)


def sector_groups(classified: DataFrame) -> DataFrame:
    """Number of products per group inside each sector, most first, with their position."""
    counted = (classified.filter(F.col("sector").isNotNull())
               .groupBy("category", "sector", "group")
               .agg(F.count_distinct("product_code").alias("n_products")))
    return with_position(counted, ["category", "sector"],
                         [-F.col("n_products"), F.col("group")]).orderBy(
        "category", "sector", "position")


def group_curve(classified_groups: DataFrame, exclude_groups=()) -> DataFrame:
    """Groups of each category by variation, with limit lines and label anchors.

    The lines stand at the first group at or above each limit; a label stands at the
    middle, round(n/2) from the start, of its part of the curve.
    """
    rows = classified_groups
    if exclude_groups:
        rows = rows.filter(~F.col("group").isin(*exclude_groups))
    v, x, y = F.col("variation"), F.col("x_limit"), F.col("y_limit")
    placed = with_position(rows, ["category"], [v.isNull(), v, F.col("group")])
    parts = rows.groupBy(F.col("category").alias("_category")).agg(
        F.count_if(v <= x).alias("_upto_x"), F.count_if(v < x).alias("_below_x"),
        F.count_if(v < y).alias("_below_y"), F.count("variation").alias("_all"))
    ranked = placed.join(parts, F.col("category").eqNullSafe(F.col("_category")))
    def middle(start, size):
        return F.col("position") == start + 1 + round_half_even(size / 2)
    y_size, z_size = (F.col("_below_y") - F.col("_below_x"), F.col("_all") - F.col("_below_y"))
    return ranked.select(
        "category", "position", "group", round_half_even(v, 2).alias("variation"),
        ((F.col("position") == F.col("_below_x") + 1) & (F.col("_all") > F.col("_below_x")))
        .alias("x_line"),
        ((F.col("position") == F.col("_below_y") + 1) & (z_size > 0)).alias("y_line"),
        middle(F.lit(0), F.col("_upto_x")).alias("x_label"),
        (middle(F.col("_below_x"), y_size) & (y_size > 0)).alias("y_label"),
        (middle(F.col("_below_y"), z_size) & (z_size > 0)).alias("z_label"))


def only_applicable(rows: DataFrame, entities: DataFrame, level: str = "category") -> DataFrame:
    """Rows of entities for which an analysis of several products makes sense.

    ``entities`` comes from ``multi_product_entities``; an entity with a single product has
    no stability classes and no clusters.
    """
    wanted = (entities.filter((F.col("level") == level) & F.col("applicable"))
              .select(F.col("entity").alias(level)).distinct())
    salt_by = [c for c in ("product_code", "group", "month") if c in rows.columns]
    return salted_join(rows, wanted, [level], salt_by=salt_by or rows.columns)
