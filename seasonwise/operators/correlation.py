"""How closely a product follows its subgroup, group and category."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonwise.functions.joins import salted_join
from seasonwise.functions.numeric import ratio, round_half_even
from seasonwise.functions.windows import by_entity
from seasonwise.operators.models import model_points
from seasonwise.schemas import ENTITY, MIN_PARENT_CORRELATION

# Preferred parent on equal correlation: the narrower one.
PARENTS = ("subgroup", "group", "category")


def _ordered(points: DataFrame, columns: list[str]) -> DataFrame:
    """The 24 points of each entity as one array ordered by t."""
    return (points.groupBy(*ENTITY)
            .agg(F.sort_array(F.collect_list(F.struct("t", *columns))).alias("points")))


def unit_profiles(window: DataFrame) -> DataFrame:
    """Centred and scaled 24 points per entity, so that a dot product is a correlation."""
    centred = window.withColumn("_d", F.col("turnover") - F.avg("turnover").over(by_entity()))
    norm = F.sqrt(F.sum(F.col("_d") * F.col("_d")).over(by_entity()))
    return _ordered(centred.withColumn("z", ratio(F.col("_d"), norm)), ["z"]).select(
        *ENTITY, F.transform("points", lambda p: p["z"]).alias("profile"))


def product_parents(hierarchy: DataFrame) -> DataFrame:
    """(product_code, ord, level, entity): three parents per product."""
    parents = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(level).alias("level"),
                                 F.col(level).alias("entity"))
                        for i, level in enumerate(PARENTS)])
    return (hierarchy.select("product_code", F.explode(parents).alias("_p"))
            .select("product_code", "_p.*").filter(F.col("entity").isNotNull()))


def parent_correlations(window: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Correlation of every product with each of its parents, three decimals.

    NULL where the parent has no two-year window or either series is constant. Each
    product meets three parent profiles; a parent of many products is spread by salt.
    """
    profiles = unit_profiles(window)
    products = (profiles.filter(F.col("level") == "product")
                .select(F.col("entity").cast("bigint").alias("product_code"), "profile"))
    children = products.join(product_parents(hierarchy), "product_code")
    parents = (profiles.filter(F.col("level") != "product")
               .withColumnRenamed("profile", "parent_profile"))
    both = salted_join(children, parents, ENTITY, salt_by=["product_code"], how="left")
    dot = F.aggregate(F.zip_with("profile", "parent_profile", lambda a, b: a * b),
                      F.lit(0.0), lambda total, x: total + x)
    return both.select("product_code", F.col("ord").alias("parent_ord"),
                       F.col("level").alias("parent_level"), F.col("entity").alias("parent"),
                       # Adding zero turns a negative zero into a plain one.
                       (round_half_even(dot, 3) + 0.0).alias("correlation"))


def best_parents(correlations: DataFrame,
                 minimum: float = MIN_PARENT_CORRELATION) -> DataFrame:
    """Parent with the highest correlation, if that reaches ``minimum``."""
    return (correlations.filter(F.col("correlation").isNotNull()).groupBy("product_code")
            .agg(F.max_by(F.struct("parent_level", "parent", "correlation"),
                          F.struct(F.col("correlation"), -F.col("parent_ord"))).alias("_b"))
            .select("product_code", "_b.*").filter(F.col("correlation") >= minimum))


def correlation_table(correlations: DataFrame) -> DataFrame:
    """One row per product, one column per parent level."""
    return correlations.groupBy("product_code").agg(*[
        F.max(F.when(F.col("parent_level") == level, F.col("correlation"))).alias(level)
        for level in PARENTS])


def parent_models(window: DataFrame, best: DataFrame) -> DataFrame:
    """Linear additive model of each product's best parent beside both actual series."""
    pairs = model_points(window.filter(F.col("level") != "product"),
                         models=(("linear", "add"),), index_rows=12)
    years = F.array(*[F.struct((F.col("pos") + 1 + 12 * (i - 1)).alias("t"),
                               F.col(f"y{i}").alias("parent_turnover"),
                               F.col(f"fit{i}").alias("parent_fit")) for i in (1, 2)])
    fits = _ordered(pairs.select(*ENTITY, F.explode(years).alias("_y"))
                    .select(*ENTITY, "_y.*"), ["parent_turnover", "parent_fit"])
    parents = fits.select(F.col("level").alias("parent_level"),
                          F.col("entity").alias("parent"), "points")
    chosen = salted_join(best, parents, ["parent_level", "parent"], salt_by=["product_code"])
    modelled = chosen.select("product_code", "parent_level", "parent", "correlation",
                             F.explode("points").alias("_p")).select(
        "product_code", "parent_level", "parent", "correlation",
        F.col("_p.t").cast("int").alias("t"), "_p.parent_turnover", "_p.parent_fit")
    own = (window.filter(F.col("level") == "product")
           .select(F.col("entity").cast("bigint").alias("product_code"), "t",
                   "month_start", F.col("turnover").alias("product_turnover")))
    return modelled.join(own, ["product_code", "t"])
