"""Sales, products and requests built from the driver tables (see FIXTURES.md)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonwise.schemas import RAW_PRODUCT_HEADERS, RAW_SALES_HEADERS

# Given schemas spare the job that would read file footers to find them.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def shipped(spark: SparkSession, sf_dir: str, years=None) -> DataFrame:
    """Line items of the given years, filtered on the stored column so scans can skip."""
    items = table(spark, sf_dir, "lineitem")
    if years is None:
        return items
    within = F.lit(False)
    for year in years:
        within = within | ((F.col("l_shipdate") >= F.lit(f"{year}-01-01").cast("timestamp_ntz"))
                           & (F.col("l_shipdate")
                              < F.lit(f"{year + 1}-01-01").cast("timestamp_ntz")))
    return items.filter(within)


def _facts(items: DataFrame, product: str) -> DataFrame:
    return items.select(
        F.col("l_shipdate").cast("date").alias("date"),
        F.col(product).alias("product_code"),
        F.when(F.col("l_returnflag") == "R", F.lit(0.0)).otherwise(F.col("l_quantity"))
        .alias("turnover_qty"),
        (F.col("l_discount") * 100).alias("discount_pct"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("turnover_net"))


def supplier_sales(spark: SparkSession, sf_dir: str, years=None) -> DataFrame:
    """F1 facts: suppliers as products."""
    return _facts(shipped(spark, sf_dir, years), "l_suppkey")


def supplier_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 dimension: region > nation > half of a nation > supplier."""
    half = F.concat(F.col("n_name"), F.lit("/"), (F.col("s_suppkey") % 2).cast("string"))
    return (table(spark, sf_dir, "supplier")
            .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("s_suppkey").alias("product_code"), F.col("r_name").alias("category"),
                    F.col("n_name").alias("group"), half.alias("subgroup")))


def part_sales(spark: SparkSession, sf_dir: str, years=None) -> DataFrame:
    """F2 facts: parts as products, many of them without sales in some months."""
    return _facts(shipped(spark, sf_dir, years), "l_partkey")


def part_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 dimension: the same brand name occurs below several types."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_code"), F.col("p_type").alias("category"),
        F.col("p_brand").alias("group"),
        F.concat(F.col("p_brand"), F.lit("#"), F.col("p_size").cast("string"))
        .alias("subgroup"))


def dirty_sales(spark: SparkSession, sf_dir: str, *others: str) -> DataFrame:
    """F3 facts: text with percent signs, decimal commas, blanks, returns and junk.

    ``others`` are stored columns to keep.
    """
    line, quantity = F.col("l_linenumber"), F.col("l_quantity").cast("bigint")
    signed = F.when(F.col("l_returnflag") == "R", -quantity).otherwise(quantity)
    text = (F.when(line == 7, "n/a").when(line == 6, "1,5").when(line == 5, "1d")
            .when(line == 4, F.translate(F.format_number(signed * 1000, 0), ",", " "))
            .otherwise(signed.cast("string")))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("product_code"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
        text.alias("turnover_qty"),
        # 12,345.67 -> 12 345,67
        F.translate(F.format_number("l_extendedprice", 2), ",.", " ,").alias("turnover_net"),
        F.concat(F.translate((F.col("l_discount") * 100).cast("decimal(18,2)").cast("string"),
                             ".", ","), F.lit("%")).alias("discount_pct"), *others)


# Column orders of the files of a folder; the last one has no header.
LAYOUTS = (("product_code", "date", "turnover_qty", "turnover_net", "discount_pct"),
           ("discount_pct", "turnover_net", "note", "turnover_qty", "date", "product_code"),
           ("date", "product_code", "discount_pct", "turnover_qty", "turnover_net"),
           ("product_code", "date", "turnover_qty", "turnover_net", "discount_pct"))


def folder_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, line`` of dirty facts in files of different layout, with lines that are broken."""
    key = F.col("l_orderkey")
    rows = dirty_sales(spark, sf_dir, "l_orderkey", "l_partkey").select(
        F.when(key % 97 == 1, 3).otherwise(key % 3).cast("int").alias("n"), "l_orderkey",
        "product_code", F.when(key % 41 == 0, "31.12.1996").otherwise(F.col("date")).alias("date"),
        "turnover_qty", "discount_pct",
        F.when(F.col("l_partkey") % 37 == 0, "abc").otherwise(F.col("turnover_net"))
        .alias("turnover_net"), F.lit('"a;""b"""').alias("note"))
    file = F.concat(F.lit("part-"), F.col("n").cast("string")).alias("file")
    line = F.lit(None).cast("string")
    for n, layout in enumerate(LAYOUTS):
        line = F.when(F.col("n") == n, F.concat_ws(";", *layout)).otherwise(line)
    cut = F.when(key % 50 == 0, F.substring_index(line, ";", 2)).otherwise(line)
    names = {column: name for name, column in RAW_SALES_HEADERS.items()}
    headers = spark.createDataFrame(
        [(f"part-{n}", ";".join(f" {names.get(c, c)}" for c in layout))
         for n, layout in enumerate(LAYOUTS[:-1])], "file string, line string")
    return rows.select(file, cut.alias("line")).unionByName(headers)


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date range for an entity of any level per order."""
    key = F.col("o_orderkey")
    start = F.col("o_orderdate").cast("date")
    asked = table(spark, sf_dir, "orders").select(
        key.alias("request_id"), (F.col("o_custkey") % 103).alias("product_code"),
        F.when(key % 11 != 0, F.date_sub(start, 30)).alias("start_date"),
        F.when(key % 13 != 0, F.date_add(start, (key % 700).cast("int") - 50)).alias("end_date"))
    named = asked.withColumn("level", F.when(F.col("request_id") % 4 == 0, "product").when(
        F.col("request_id") % 4 == 1, "subgroup").when(
        F.col("request_id") % 4 == 2, "group").otherwise("category"))
    named = named.join(supplier_products(spark, sf_dir), "product_code", "left")
    return named.select("request_id", "level", F.expr(
        "CASE level WHEN 'product' THEN CAST(product_code AS STRING) WHEN 'subgroup' THEN subgroup "
        "WHEN 'group' THEN `group` ELSE category END").alias("entity"), "start_date", "end_date")


def _bracketed(name: str):
    return F.concat(F.lit("["), F.substring(name, 1, 1), F.lit("]"),
                    F.expr(f"substring(`{name}`, 2)"))


def dirty_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 dimension: names written like [A]b."""
    products = supplier_products(spark, sf_dir)
    return products.select(F.col("product_code").cast("string").alias("product_code"),
                           *[_bracketed(c).alias(c) for c in ("category", "group", "subgroup")])


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for every region, nation, half nation and supplier, and unknown names."""
    nation = table(spark, sf_dir, "nation")
    def ask(frame, kind, key, text):
        return frame.select(F.concat(F.lit(f"{kind}-"), F.col(key).cast("string"))
                            .alias("request_id"), text.alias("request"))
    return (ask(table(spark, sf_dir, "region"), "category", "r_regionkey", F.col("r_name"))
            .unionByName(ask(nation, "group", "n_nationkey", F.col("n_name")))
            .unionByName(ask(nation, "subgroup", "n_nationkey",
                             F.concat(F.col("n_name"), F.lit("/0"))))
            .unionByName(ask(table(spark, sf_dir, "supplier"), "product", "s_suppkey",
                             F.col("s_suppkey").cast("string")))
            .unionByName(ask(table(spark, sf_dir, "customer"), "unknown", "c_custkey",
                             F.col("c_name"))))


def raw_lines(frame: DataFrame, products: bool = False) -> tuple[DataFrame, str]:
    """Dirty facts or products as ``;`` separated lines, and the original header line."""
    headers = RAW_PRODUCT_HEADERS if products else RAW_SALES_HEADERS
    first, *others = headers
    line = F.to_csv(F.struct(*[F.col(name) for name in headers.values()]), {"sep": ";"})
    return frame.select(line.alias("line")), ";".join([first, *[f" {h}" for h in others]])


def prepared_lines(frame: DataFrame) -> tuple[DataFrame, str]:
    """Clean facts with hierarchy as comma separated lines, and their header line."""
    names = {"date": "date", "product_code": "product_code", "turnoverOfGoods": "turnover_qty",
             "percentOfDisc": "discount_pct", "turnoverWithDisc": "turnover_net",
             "category": "category", "group": "group", "subgroup": "subgroup"}
    line = F.to_csv(F.struct(*[F.col(name).alias(shown) for shown, name in names.items()]))
    return frame.select(line.alias("line")), ",".join(names)


def gapped_sales(spark: SparkSession, sf_dir: str, years=None) -> DataFrame:
    """F1 facts in which every product of one region sold nothing."""
    silent = (table(spark, sf_dir, "supplier")
              .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
              .select(F.col("s_suppkey").alias("product_code"),
                      (F.col("n_regionkey") == 4).alias("_silent")))
    return (supplier_sales(spark, sf_dir, years).join(silent, "product_code", "left")
            .withColumn("turnover_qty", F.when(F.col("_silent"), 0.0)
                        .otherwise(F.col("turnover_qty"))).drop("_silent"))


def gapped_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 dimension without every tenth product."""
    return supplier_products(spark, sf_dir).filter("product_code % 10 <> 7")
