"""Usable embeddings: what searches and similarity joins take part with."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(embedding: str):
    """Not null, no null or non-finite component, not all zeros."""
    column = F.col(f"`{embedding}`")
    return F.coalesce(
        column.isNotNull()
        & F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists(column, lambda v: v != 0), F.lit(False))


def vectors(table: DataFrame, vec_id: str, embedding: str, *others: str) -> DataFrame:
    """``vec_id, embedding array<double>`` and the other columns of usable rows with an id."""
    return table.filter(F.col(f"`{vec_id}`").isNotNull() & usable(embedding)).select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
        F.col(f"`{embedding}`").cast("array<double>").alias("embedding"),
        *[F.col(f"`{o}`").alias(o) for o in others])
