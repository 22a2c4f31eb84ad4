"""Rounding and division rules."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(value: Column, digits: int = 0) -> Column:
    """Round to ``digits`` decimals, exact halves to the even neighbour."""
    if digits == 0:
        return F.rint(value)
    scale = float(10 ** digits)
    return F.rint(value * scale) / scale


def truncate(value: Column) -> Column:
    """Drop the fraction."""
    return value.cast("bigint")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, NULL for a zero denominator."""
    return F.try_divide(numerator, denominator)
