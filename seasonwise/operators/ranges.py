"""Totals of any date range of any entity, by two look-ups each.

Sums are kept per entity and month: what was sold before the month, and the running total of each
of its days. A range is the running total at its end minus the one before its start; the facts
are read once, however many ranges are asked for.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonwise.functions.dates import month_start
from seasonwise.functions.joins import salted_join
from seasonwise.schemas import ENTITY

BY = "PARTITION BY level, entity"


def day_blocks(days: DataFrame) -> DataFrame:
    """Running totals of ``days (level, entity, day, turnover)``, one row per entity and month.

    ``upto`` and ``days`` hold 31 values: turnover and number of days with sales from the first
    day of the entity to each day of the month. Months without sales inside the entity's range are
    there too. Windows hold the months of one entity.
    """
    months = days.groupBy(*ENTITY, month_start(F.col("day")).alias("seen")).agg(
        F.collect_list(F.struct(F.dayofmonth("day").alias("i"), "turnover")).alias("d"),
        F.sum("turnover").alias("turnover"), F.count(F.lit(1)).alias("n"))
    earlier = f"OVER ({BY} ORDER BY seen ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    spread = months.selectExpr(
        *ENTITY, "seen", "d", f"coalesce(sum(turnover) {earlier}, 0D) AS before",
        f"coalesce(sum(n) {earlier}, 0L) AS n_before",
        f"lead(seen) OVER ({BY} ORDER BY seen) AS after")
    running = spread.selectExpr(
        *ENTITY, "seen", "after",
        "transform(sequence(1, 31), i -> before + aggregate(filter(d, x -> x.i <= i), 0D, "
        "(t, x) -> t + x.turnover)) AS upto",
        "transform(sequence(1, 31), i -> n_before + size(filter(d, x -> x.i <= i))) AS days")
    # A month without sales repeats the last values of the one before.
    filled = running.selectExpr("*", "explode(sequence(seen, coalesce(add_months(after, -1), seen),"
                                " INTERVAL 1 MONTH)) AS month_start")
    return filled.selectExpr(
        *ENTITY, "month_start", *[f"IF(month_start = seen, {c}, array_repeat({c}[30], 31)) AS {c}"
                                  for c in ("upto", "days")])


def range_totals(ranges: DataFrame, blocks: DataFrame) -> DataFrame:
    """``turnover`` and ``active_days`` of each row of ``ranges``.

    ``ranges`` has ``level, entity, start_date, end_date``, both dates included, and any other
    columns, which stay; ``blocks`` comes from ``day_blocks``. A missing date leaves that side
    open, a start after the end gives 0, an entity without sales has nulls. Many ranges may ask
    for one entity: both look-ups are salted.
    """
    spans = blocks.groupBy(*ENTITY).agg(
        F.max("month_start").alias("_last"),
        F.max_by(F.get("upto", F.lit(30)), "month_start").alias("_u"),
        F.max_by(F.get("days", F.lit(30)), "month_start").alias("_n"))
    columns = [F.col(f"`{c}`") for c in ranges.columns]
    asked = ranges.withColumn("_r", F.struct(*columns))
    salt = ["_r"]
    asked = salted_join(asked, spans, ENTITY, salt_by=salt, how="left")
    start, end, after = F.date_sub("start_date", 1), F.col("end_date"), F.add_months("_last", 1)
    asked = asked.select(
        "_r", *ENTITY, "_last", "_u", "_n",
        (F.col("start_date") > F.col("end_date")).alias("_empty"),
        # A range that is open or ends after the last month takes all there is.
        (start >= after).alias("_all0"), (end.isNull() | (end >= after)).alias("_all1"),
        *[c for side, date in (("0", start), ("1", end)) for c in (
            month_start(date).alias(f"_m{side}"), F.dayofmonth(date).alias(f"_d{side}"))])
    for side in "01":
        looked = blocks.select(*ENTITY, F.col("month_start").alias(f"_m{side}"),
                               F.col("upto").alias(f"_u{side}"), F.col("days").alias(f"_n{side}"))
        asked = salted_join(asked, looked, [*ENTITY, f"_m{side}"], salt_by=salt, how="left")

    def difference(values: str, none):
        # Before the first month nothing has been sold, and a missing start is before it.
        ends = [F.when(F.col(f"_all{side}"), F.col(f"_{values}")).otherwise(F.coalesce(
            F.get(F.col(f"_{values}{side}"), F.col(f"_d{side}") - 1), none)) for side in "01"]
        return F.when(F.col("_last").isNull(), None).when(F.col("_empty"), none).otherwise(
            ends[1] - ends[0])

    return asked.select(
        "_r.*", difference("u", F.lit(0.0)).alias("turnover"),
        difference("n", F.lit(0).cast("long")).alias("active_days"))
