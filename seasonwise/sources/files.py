"""Delimited text files. Every raw column is read as text and parsed by explicit rules."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonwise.functions.text import strip_brackets
from seasonwise.schemas import (DATE_FORMAT, HIERARCHY, PREPARED_HEADERS, RAW_PRODUCT_HEADERS,
                                RAW_SALES_HEADERS)


def _read_named(spark: SparkSession, path, separator: str, headers: dict[str, str]) -> DataFrame:
    raw = spark.read.csv(path, sep=separator, header=True, inferSchema=False,
                         enforceSchema=False)
    return _pick(raw, headers)


def _lines_named(lines: DataFrame, header: str, separator: str,
                 headers: dict[str, str]) -> DataFrame:
    """Lines that are in a frame already (its first column), with their header line."""
    names = header.split(separator)
    schema = ", ".join(f"`{name}` STRING" for name in names)
    parsed = lines.select(F.from_csv(F.col(f"`{lines.columns[0]}`"), schema,
                                     {"sep": separator}).alias("_line"))
    return _pick(parsed.select("_line.*"), headers)


def _pick(raw: DataFrame, headers: dict[str, str]) -> DataFrame:
    """Pick columns by header, whatever their order and whichever others there are."""
    present = {name.strip(): name for name in raw.columns}
    missing = [header for header in headers if header not in present]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return raw.select(*[F.col(f"`{present[header]}`").alias(name)
                        for header, name in headers.items()])


def read_raw_sales(spark: SparkSession, path) -> DataFrame:
    """Sales text file, ``;`` separated: five text columns."""
    return _read_named(spark, path, ";", RAW_SALES_HEADERS)


def raw_sales_of_lines(lines: DataFrame, header: str) -> DataFrame:
    """The same from a frame of text lines."""
    return _lines_named(lines, header, ";", RAW_SALES_HEADERS)


def read_raw_products(spark: SparkSession, path) -> DataFrame:
    """Product dimension text file, ``;`` separated: four text columns."""
    return _read_named(spark, path, ";", RAW_PRODUCT_HEADERS)


def raw_products_of_lines(lines: DataFrame, header: str) -> DataFrame:
    """The same from a frame of text lines."""
    return _lines_named(lines, header, ";", RAW_PRODUCT_HEADERS)


def read_prepared(spark: SparkSession, path, date_format: str = DATE_FORMAT) -> DataFrame:
    """Already cleaned, comma separated facts with their hierarchy."""
    return _typed(_read_named(spark, path, ",", PREPARED_HEADERS), date_format)


def prepared_of_lines(lines: DataFrame, header: str,
                      date_format: str = DATE_FORMAT) -> DataFrame:
    """The same from a frame of text lines."""
    return _typed(_lines_named(lines, header, ",", PREPARED_HEADERS), date_format)


def _typed(raw: DataFrame, date_format: str) -> DataFrame:
    return raw.select(
        F.to_date("date", date_format).alias("date"),
        F.col("product_code").cast("bigint").alias("product_code"),
        *[F.col(c).cast("double").alias(c)
          for c in ("turnover_qty", "discount_pct", "turnover_net")],
        *[strip_brackets(F.col(c)).alias(c) for c in HIERARCHY],
    )
