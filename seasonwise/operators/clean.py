"""Cleaning of raw sales and products."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonwise.functions.joins import checked_join
from seasonwise.functions.text import (is_quantity, money_to_double, percent_to_double,
                                       quantity_to_double, strip_brackets)
from seasonwise.schemas import DATE_FORMAT, HIERARCHY


def without_returns(quantity):
    """A negative quantity counts as nothing sold."""
    return F.greatest(quantity, F.lit(0.0))


def clean_sales(raw: DataFrame, date_format: str = DATE_FORMAT,
                year: int | None = None) -> DataFrame:
    """Typed sales; rows whose quantity is not a number are dropped.

    The check is a filter below the projection, so each text is parsed once.
    """
    sales = raw.filter(is_quantity(F.col("turnover_qty"))).select(
        F.to_date("date", date_format).alias("date"),
        F.col("product_code").cast("bigint").alias("product_code"),
        without_returns(quantity_to_double(F.col("turnover_qty"))).alias("turnover_qty"),
        percent_to_double(F.col("discount_pct")).alias("discount_pct"),
        money_to_double(F.col("turnover_net")).alias("turnover_net"))
    return keep_year(sales, year)


def clean_products(raw: DataFrame) -> DataFrame:
    """Typed product dimension without brackets in its names."""
    return raw.select(F.col("product_code").cast("bigint").alias("product_code"),
                      *[strip_brackets(F.col(c)).alias(c) for c in HIERARCHY])


def keep_year(sales: DataFrame, year: int | None) -> DataFrame:
    """Facts (or month totals) of one calendar year, or everything for None."""
    return sales if year is None else keep_years(sales, (year,))


def keep_years(sales: DataFrame, years) -> DataFrame:
    """Several calendar years, as ranges on the date itself that a scan can use."""
    time = "date" if "date" in sales.columns else "month_start"
    within = F.lit(False)
    for year in years:
        within = within | F.col(time).between(F.make_date(F.lit(year), F.lit(1), F.lit(1)),
                                              F.make_date(F.lit(year), F.lit(12), F.lit(31)))
    return sales.filter(within)


def with_month(sales: DataFrame) -> DataFrame:
    """Add the calendar month 1..12."""
    return sales.withColumn("month", F.month("date"))


def attach_hierarchy(rows: DataFrame, products: DataFrame) -> DataFrame:
    """Add category, group and subgroup; rows without a dimension entry keep NULLs.

    Meant for rows already aggregated per product and period. Use
    ``attach_hierarchy_to_facts`` for raw facts.
    """
    return rows.join(products.select("product_code", *HIERARCHY), "product_code", "left")


def attach_hierarchy_to_facts(sales: DataFrame, products: DataFrame) -> DataFrame:
    """The same for single facts, where one product may hold a large share of all rows."""
    return checked_join(sales, products.select("product_code", *HIERARCHY), ["product_code"],
                        salt_by=["date", "turnover_qty", "turnover_net"], how="left")
