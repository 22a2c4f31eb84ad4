"""Calendar expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from seasonwise.schemas import MONTH_NAMES


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def months_spanned(first: Column, last: Column) -> Column:
    """Number of calendar months from ``first`` to ``last``, both included."""
    return (F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first) + 1


def month_name(day: Column) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in MONTH_NAMES]), F.month(day))


def month_label(day: Column, shown_years: dict[int, int] | None = None) -> Column:
    """'MM/yyyy', with some years shown as others, e.g. ``{2019: 2020}``."""
    year = F.date_format(day, "yyyy")
    shown = year
    for own, other in (shown_years or {}).items():
        shown = F.when(year == str(own), str(other)).otherwise(shown)
    return F.concat(F.date_format(day, "MM/"), shown)
