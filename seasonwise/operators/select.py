"""Choosing rows and entities."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seasonwise.functions.joins import checked_join, salted_join
from seasonwise.functions.ranks import with_position
from seasonwise.operators.series import expand_levels
from seasonwise.schemas import HIERARCHY, LEVEL_COLUMNS
from seasonwise.sources.requests import read_requests

# Order in which a text request is tried; a numeric one can only be a product.
LEVEL_PRIORITY = {"product": 0, "category": 1, "group": 2, "subgroup": 3}


def sold_products(sales: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Distinct products that occur in the facts, with their hierarchy."""
    if products is None:
        return sales.select("product_code", *HIERARCHY).distinct()
    return (sales.select("product_code").distinct()
            .join(products.select("product_code", *HIERARCHY), "product_code", "left"))


def resolve_requests(requests: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Level and entity of each request: the first level that knows the name wins.

    Requests nothing matches stay, with NULL level and ``found`` false.
    """
    names = expand_levels(hierarchy).select("level", "entity").distinct()
    asked = read_requests(requests).withColumn(
        "_key", F.coalesce(F.col("product_code").cast("string"), F.col("name")))
    is_code = F.col("product_code").isNotNull()
    names = names.withColumn("_key", F.col("entity"))
    best = (salted_join(asked, names, ["_key"], salt_by=["request_id"])  # many may ask for one name
            .filter(is_code == (F.col("level") == "product"))
            .withColumn("_rank", F.element_at(F.create_map(
                *[F.lit(x) for pair in LEVEL_PRIORITY.items() for x in pair]), F.col("level")))
            .groupBy("request_id")
            .agg(F.min_by("level", "_rank").alias("level"),
                 F.min_by("entity", "_rank").alias("entity")))
    return (asked.select("request_id", "request").join(best, "request_id", "left")
            .withColumn("found", F.col("level").isNotNull()))


def requested_entities(resolved: DataFrame) -> DataFrame:
    """Distinct entities behind all requests; ``resolved`` itself maps requests to them."""
    return resolved.filter("found").select("level", "entity").distinct()


def entity_products(resolved: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Products of each distinct entity that is asked for, however many requests do."""
    return salted_join(expand_levels(hierarchy), requested_entities(resolved),
                       ["level", "entity"], salt_by=["product_code"])


def per_request(by_entity: DataFrame, resolved: DataFrame) -> DataFrame:
    """Results of entities (``level, entity, ...``) for each request: the last step."""
    asked = resolved.filter("found").select("request_id", "level", "entity")
    return salted_join(asked, by_entity, ["level", "entity"], salt_by=["request_id"])


def request_levels(resolved: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """``request_id, level, entity`` of the narrowest level with a single value per request.

    All requests for one entity select the same products, so entities are looked at, not requests.
    """
    found = selection_level(entity_products(resolved, hierarchy).withColumnsRenamed(
        {"level": "_level", "entity": "_entity"}), ["_level", "_entity"])
    found = found.select(F.col("_level").alias("level"), F.col("_entity").alias("entity"),
                         F.col("level").alias("_l"), F.col("entity").alias("_e"))
    return per_request(found, resolved).select(
        "request_id", F.col("_l").alias("level"), F.col("_e").alias("entity"))


def numbered_requests(resolved: DataFrame) -> DataFrame:
    """Resolved requests that were found, with ``number`` from 1 in the order of their ids."""
    found = resolved.filter("found").select("request_id", "level", "entity")
    ranked = with_position(found, [], [F.col("request_id"), F.col("level"), F.col("entity")])
    return ranked.select("request_id", "level", "entity",
                         F.col("position").cast("long").alias("number"))


def product_requests(numbered: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Which requests want each product, as bitmaps: ``product_code, bucket, bitmap``.

    Bit i of bucket b (from 1) stands for request number (b - 1) * 32768 + i + 1. Requests are gathered
    per entity, and the bitmaps of a product's levels are united; requests never meet products one
    by one, and each row stands for up to 32768 requests.
    """
    bitmaps = numbered.groupBy("level", "entity", F.bitmap_bucket_number("number").alias("bucket")
                               ).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number"))
                                     .alias("bitmap"))
    wanted = salted_join(expand_levels(hierarchy).select("product_code", "level", "entity"),
                         bitmaps, ["level", "entity"], salt_by=["product_code"])
    return wanted.groupBy("product_code", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def wanted_rows(sales: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Facts that any request wants, each once per bucket of requests, with ``bitmap``."""
    return checked_join(sales.drop(*HIERARCHY), bitmaps, ["product_code"],
                        salt_by=["date", "turnover_qty"])


def bitmap_numbers(bucket: str, bitmap: str):
    """Request numbers in a bitmap, ascending."""
    return F.expr(f"""
        flatten(transform(sequence(1, length({bitmap})), i -> transform(
            filter(sequence(0, 7), b -> getbit(
                cast(conv(hex(substring({bitmap}, i, 1)), 16, 10) AS int), b) = 1),
            b -> ({bucket} - 1) * 32768 + (i - 1) * 8 + b + 1)))""")


def entity_rows(sales: DataFrame, entities: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """All facts of each entity, however many requests ask for it.

    Entities are turned into product codes on the dimension, so facts meet one join and are
    not expanded to every level.
    """
    facts = sales.drop(*HIERARCHY)
    wanted = salted_join(expand_levels(hierarchy), entities, ["level", "entity"],
                         salt_by=["product_code"]).select(
        "product_code", "level", "entity", *HIERARCHY)
    return checked_join(facts, wanted, ["product_code"], salt_by=["date", "turnover_qty"])


def request_rows(sales: DataFrame, resolved: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """All facts of each resolved request, repeated for each request.

    With many requests for one entity use ``entity_rows`` and keep ``resolved`` as the map.
    """
    rows = entity_rows(sales, requested_entities(resolved), hierarchy)
    asked = resolved.filter("found").select("request_id", "level", "entity")
    return salted_join(rows, asked, ["level", "entity"], salt_by=["product_code", "date"]).drop(
        "level", "entity")


def filter_sales(sales: DataFrame, category=None, group=None, subgroup=None,
                 product_code=None, start_date=None, end_date=None) -> DataFrame:
    """All given conditions together; both dates are included."""
    wanted = {"category": category, "group": group, "subgroup": subgroup,
              "product_code": product_code}
    for column, value in wanted.items():
        if value is not None:
            sales = sales.filter(F.col(column) == F.lit(value))
    if start_date is not None:
        sales = sales.filter(F.col("date") >= F.lit(start_date).cast("date"))
    if end_date is not None:
        sales = sales.filter(F.col("date") <= F.lit(end_date).cast("date"))
    return sales


def available_choices(hierarchy: DataFrame, child: str, parent: str | None = None,
                      value=None) -> DataFrame:
    """Sorted distinct values of ``child``, below one ``parent`` value if that is given."""
    if value is not None:
        hierarchy = hierarchy.filter(F.col(parent) == F.lit(value))
    return (hierarchy.select(child).filter(F.col(child).isNotNull())
            .distinct().orderBy(child))


def choices_by_parent(hierarchy: DataFrame) -> DataFrame:
    """Every step of the cascade at once: category-group, group-subgroup, subgroup-product.

    ``position`` numbers the sorted children of each parent, however many they are.
    """
    steps = (("category", "group"), ("group", "subgroup"), ("subgroup", "product"))
    pairs = [F.struct(F.lit(parent).alias("parent_level"),
                      F.col(LEVEL_COLUMNS[parent]).alias("parent"),
                      F.lit(child).alias("child_level"),
                      F.col(LEVEL_COLUMNS[child]).cast("string").alias("child"))
             for parent, child in steps]
    children = (hierarchy.select(F.explode(F.array(*pairs)).alias("_p")).select("_p.*")
                .filter("parent IS NOT NULL AND child IS NOT NULL").distinct())
    return with_position(children, ["parent_level", "parent"], [F.col("child")]).orderBy(
        "parent_level", "parent", "position")


def level_values(hierarchy: DataFrame) -> DataFrame:
    """Distinct values of every level, sorted, with their position."""
    values = expand_levels(hierarchy).select("level", F.col("entity").alias("value")).distinct()
    return with_position(values, ["level"], [F.col("value")]).orderBy("level", "position")


def date_bounds(sales: DataFrame) -> DataFrame:
    """First and last date."""
    return sales.agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"))


def selection_level(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Narrowest level with a single value in the selection (or in each ``by`` group).

    A column has one value if its smallest and largest are equal, which needs no distinct
    counting.
    """
    def single(level):
        return F.min(LEVEL_COLUMNS[level]) == F.max(LEVEL_COLUMNS[level])
    def pick(result):
        chosen = F.lit(None).cast("string")
        for level in ("category", "group", "subgroup", "product"):
            chosen = F.when(single(level), result(level)).otherwise(chosen)
        return chosen
    return rows.groupBy(*(by or [])).agg(
        pick(F.lit).alias("level"),
        pick(lambda level: F.min(LEVEL_COLUMNS[level]).cast("string")).alias("entity"))


def multi_product_entities(hierarchy: DataFrame) -> DataFrame:
    """Entities above product level with their number of products and whether analyses of
    several products (stability classes, clusters) apply to them."""
    return (expand_levels(hierarchy).groupBy("level", "entity")
            .agg(F.count_distinct("product_code").alias("n_products"))
            .withColumn("applicable", F.col("n_products") != 1))
