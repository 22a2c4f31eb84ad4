"""Date ranges beside summing the days of each one."""

import datetime as dt
import random

from pyspark.sql import functions as F

from seasonwise.operators import ranges
from tests.helpers import day

DAYS = [("product", "1", "2020-01-31", 5.0), ("product", "1", "2020-02-01", 2.0),
        ("product", "1", "2020-02-29", 0.0), ("product", "1", "2020-07-15", 7.0), ("product", "1", "2020-07-20", -3.0),
        ("group", "g", "2021-12-31", 1.0)]


def blocks(spark, days=DAYS):
    frame = spark.createDataFrame([(a, b, day(d), v) for a, b, d, v in days],
                                  "level string, entity string, day date, turnover double")
    return ranges.day_blocks(frame)


def plain(level, entity, start, end, days=DAYS):
    own = [(dt.date.fromisoformat(d), v) for a, b, d, v in days if (a, b) == (level, entity)]
    if not own:
        return None, None
    inside = [v for d, v in own if (start is None or d >= start) and (end is None or d <= end)]
    return sum(inside, 0.0), len(inside)


def test_every_range_of_a_short_calendar(spark):
    draw = random.Random(4)
    first = dt.date(2019, 12, 1)
    asked = [(i, level, entity,
              None if draw.random() < 0.1 else first + dt.timedelta(draw.randrange(400)),
              None if draw.random() < 0.1 else first + dt.timedelta(draw.randrange(900)))
             for i, (level, entity) in enumerate(
                 [("product", "1"), ("group", "g"), ("product", "g"), ("product", None)] * 150)]
    # Month ends and starts, and names that a range may bring along.
    asked += [(1000 + i, "product", "1", day(a), day(b)) for i, (a, b) in enumerate([
        ("2020-01-31", "2020-01-31"), ("2020-02-01", "2020-02-29"), ("2020-03-01", "2020-07-14"),
        ("2020-02-01", "2020-01-31"), ("2020-07-15", "2020-07-15"), ("2020-08-01", "2020-08-02")])]
    frame = spark.createDataFrame(
        [(*a, "clash") for a in asked],
        "id int, level string, entity string, start_date date, end_date date, upto string")
    got = {r["id"]: (r["turnover"], r["active_days"]) for r in
           ranges.range_totals(frame, blocks(spark)).collect()}
    assert len(got) == len(asked)
    for i, level, entity, start, end in asked:
        assert got[i] == plain(level, entity, start, end), (i, level, entity, start, end)


def test_no_sales_and_no_ranges(spark):
    empty = blocks(spark, DAYS[:0])
    one = spark.createDataFrame([("product", "1", day("2020-01-01"), day("2020-01-02"))],
                                "level string, entity string, start_date date, end_date date")
    assert [tuple(r)[4:] for r in ranges.range_totals(one, empty).collect()] == [(None, None)]
    assert ranges.range_totals(one.filter(F.lit(False)), blocks(spark)).count() == 0


def test_repeated_ranges_each_have_their_row(spark):
    one = spark.createDataFrame([("product", "1", day("2020-01-01"), day("2020-02-01"))] * 3,
                                "level string, entity string, start_date date, end_date date")
    assert [r["turnover"] for r in ranges.range_totals(one, blocks(spark)).collect()] == [7.0] * 3
