"""Small hand-made frames."""

import datetime as dt

from seasonwise.schemas import PRODUCTS, SALES


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def sales_frame(spark, rows):
    """rows: (date text, product_code, quantity)"""
    return spark.createDataFrame([(day(d), p, float(q), 0.0, 0.0) for d, p, q in rows], SALES)


def products_frame(spark, rows):
    """rows: (product_code, category, group, subgroup)"""
    return spark.createDataFrame(rows, PRODUCTS)


def months(year: int, values):
    """(date text, value) on the 3rd of each month of a year."""
    return [(f"{year}-{m:02d}-03", v) for m, v in enumerate(values, start=1)]


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
