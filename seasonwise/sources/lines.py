"""Delimited text line by line: a header of its own for every file, and no line without a trace.

Files of one folder may order their columns differently, so each line is read by the header of
its own file. Lines that cannot be used are kept with a reason instead of being dropped.
"""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonwise.functions import text
from seasonwise.functions.joins import checked_join
from seasonwise.schemas import DATE_FORMAT, RAW_PRODUCT_HEADERS, RAW_SALES_HEADERS


def read_lines(spark: SparkSession, path) -> DataFrame:
    """``file, line`` of all lines of text files."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"),
                                        F.col("value").alias("line"))


def fields(line: str, separator: str) -> Column:
    """Fields of a line; one in double quotes may hold separators and doubled quotes."""
    found = F.regexp_extract_all(
        F.concat(F.lit(separator), F.col(line)),
        F.lit(f'{separator}("(?:[^"]|"")*"|[^{separator}]*)'), F.lit(1))
    return F.transform(found, lambda f: F.when(
        f.rlike('^".*"$'), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'),
                                     F.lit('"'))).otherwise(f))


def _is_header(headers: dict[str, str]) -> Column:
    # Most lines lack the first name and are told by that alone.
    held = reduce(and_, [F.contains("line", F.lit(name)) for name in headers])
    names = F.array(*[F.lit(name) for name in headers])
    return held & (F.size(F.array_except(names, F.transform(
        "_fields", lambda f: F.trim(f)))) == 0)


def by_header(lines: DataFrame, headers: dict[str, str], separator: str = ";") -> DataFrame:
    """``file, line``, the columns named in ``headers``, and ``reason``.

    A header is a line that holds all names of ``headers`` as fields, blanks around them aside, in
    any order and with any others; a file has one, and its other lines are read by it. Headers
    themselves and empty lines are no rows. ``reason`` is null, ``header`` for lines of a file
    without one, or ``columns`` where the number of fields is not that of the header; such lines
    have null columns, and so have blank fields. Headers are found by a pass of their own and meet the lines by file.
    """
    split = lines.filter(F.trim("line") != "").withColumn("_fields", fields("line", separator))
    marked = split.withColumn("_header", _is_header(headers))
    known = marked.filter("_header").groupBy("file").agg(F.min("_fields").alias("_names"))
    known = known.select("file", F.size("_names").alias("_size"), *[
        F.array_position(F.transform("_names", lambda f: F.trim(f)), name).cast("int")
        .alias(f"_p{i}") for i, name in enumerate(headers)])
    rows = checked_join(marked.filter(~F.col("_header")), known, ["file"], salt_by=["line"],
                        how="left")
    reason = F.when(F.col("_size").isNull(), "header").when(
        F.size("_fields") != F.col("_size"), "columns")
    def value(i):
        field = F.get("_fields", F.col(f"_p{i}") - 1)
        return F.when(F.col("reason").isNull() & (F.trim(field) != ""), field)

    return rows.withColumn("reason", reason).select(
        "file", "line", *[value(i).alias(column) for i, column in enumerate(headers.values())],
        "reason")


def checked_sales(lines: DataFrame, date_format: str = DATE_FORMAT) -> DataFrame:
    """Raw sales lines with ``reason`` why a line is not usable, or null.

    After ``header`` and ``columns``: ``product_code`` that is no whole number, ``date`` that does
    not parse, ``quantity``, ``money`` or ``discount`` that is no number; the first that holds. A
    missing amount or discount is no reason, a missing quantity is one.
    """
    rows = by_header(lines, RAW_SALES_HEADERS)
    code = F.col("product_code").try_cast("bigint")

    def wrong(column, plain):
        return F.coalesce(~plain(F.col(column)).rlike(text.NUMBER), F.lit(False))

    return rows.withColumn("reason", F.coalesce(
        "reason", F.when(code.isNull(), "product_code"),
        F.when(F.try_to_date("date", date_format).isNull(), "date"),
        F.when(~F.coalesce(text.is_quantity(F.col("turnover_qty")), F.lit(False)), "quantity"),
        F.when(wrong("turnover_net", text.plain_money), "money"),
        F.when(wrong("discount_pct", text.plain_percent), "discount")))


def raw_products(lines: DataFrame) -> DataFrame:
    """Raw product lines with ``reason``; a code that is no whole number is one."""
    rows = by_header(lines, RAW_PRODUCT_HEADERS)
    code = F.col("product_code").try_cast("bigint")
    return rows.withColumn("reason", F.coalesce(
        "reason", F.when(code.isNull(), "product_code")))


def accepted(checked: DataFrame) -> DataFrame:
    """Columns of the usable lines, ready for cleaning."""
    return checked.filter("reason IS NULL").drop("file", "line", "reason")


def rejected(checked: DataFrame) -> DataFrame:
    """``file, reason, line`` of all others."""
    return checked.filter("reason IS NOT NULL").select("file", "reason", "line")


def reject_counts(checked: DataFrame) -> DataFrame:
    """Per file the number of its lines by ``reason``; usable ones are ``ok``."""
    return checked.groupBy("file", F.coalesce("reason", F.lit("ok")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n_lines"))
