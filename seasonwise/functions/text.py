"""Parsing of raw text columns and display text of numbers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal literal; keeps out forms such as '1d' that a cast would accept.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def plain_percent(text: Column) -> Column:
    """'7,5%' -> '7.5'"""
    return F.translate(text, ",%", ".")


def percent_to_double(text: Column) -> Column:
    """'7,5%' -> 7.5"""
    return plain_percent(text).cast("double")


def plain_money(text: Column) -> Column:
    """'12 345,60' -> '12345.60'"""
    return F.translate(text, ", ", ".")


def money_to_double(text: Column) -> Column:
    """'12 345,60' -> 12345.6"""
    return plain_money(text).cast("double")


def is_quantity(text: Column) -> Column:
    """Whether a quantity is a number once blanks are removed; '1,5' is none."""
    return F.translate(text, " ", "").rlike(NUMBER)


def quantity_to_double(text: Column) -> Column:
    """'1 200' -> 1200.0; only for texts that pass ``is_quantity``."""
    return F.translate(text, " ", "").cast("double")


def strip_brackets(name: Column) -> Column:
    """'[A]b' -> 'Ab'"""
    return F.translate(name, "[]", "")


def display_number(value: Column, digits: int = 2, signed: bool = False,
                   decimal_mark: str = ",") -> Column:
    """Fixed decimals, a decimal mark and, if asked, an explicit sign.

    The stored binary value is rounded, exact halves to even: 1.115, which is a little less, shows
    as 1,11.
    """
    plain = F.translate(F.format_number(value, digits), ",", "")
    if signed:
        plain = F.when(plain.startswith("-"), plain).otherwise(F.concat(F.lit("+"), plain))
    return F.translate(plain, ".", decimal_mark)
