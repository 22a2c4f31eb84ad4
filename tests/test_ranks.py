"""Positions beside a window over whole groups."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seasonwise.functions.ranks import with_position
from seasonwise.operators import select
from tests.helpers import products_frame, rows_of, sales_frame


def frame(spark, n=4000):
    draw = random.Random(5)
    # One key holds half of all rows; some keys and values are null, many values tie.
    rows = [(None if i % 50 == 0 else "hot" if i % 2 else f"k{draw.randrange(300)}",
             None if i % 40 == 0 else draw.randrange(1500), i) for i in range(n)]
    return spark.createDataFrame(rows, "k string, v int, i int")


@pytest.mark.parametrize("blocks", [1, 2, 3, 16, 40])
def test_positions(spark, blocks):
    df = frame(spark)
    got = with_position(df, ["k"], [F.col("v"), -F.col("i")], blocks=blocks)
    want = df.withColumn("position", F.row_number().over(
        Window.partitionBy("k").orderBy("v", F.desc("i"))))
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_whole_table_and_ties(spark):
    df = frame(spark, 700).select("v")
    got = with_position(df, [], [F.col("v")], name="rank", blocks=8).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 701))
    assert [r["v"] for r in got] == sorted((r["v"] for r in got), key=lambda v: (v is not None, v))


def test_empty_and_small_tables(spark):
    df = frame(spark)
    assert with_position(df.limit(0), ["k"], [F.col("v")]).count() == 0
    assert [r["position"] for r in with_position(df.limit(1), ["k"], [F.col("v")]).collect()] == [1]


def test_no_window_holds_a_whole_group(spark):
    """Rows of the hot key are spread over many blocks."""
    plan = with_position(frame(spark), ["k"], [F.col("v"), F.col("i")], blocks=40)
    spread = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_block" in spread
    from seasonwise.functions.ranks import _block, _cuts
    placed = frame(spark).withColumn("_s", F.struct("k", "v", "i"))
    sizes = placed.withColumn("_cuts", _cuts(placed.select("_s"), 40).scalar()).groupBy(
        _block(40).alias("b")).count().collect()
    assert len(sizes) > 30 and max(r["count"] for r in sizes) < 4 * 4000 / len(sizes)


PRODUCTS = [(1, "food", "tea", "green"), (2, "food", "mix", "a"), (3, "tea", "mix", "b"),
            (4, "tea", "leaf", "a")]


def test_bitmaps_of_requests(spark):
    """Every request of a product is one bit, also beyond one bucket of 32768."""
    sales = sales_frame(spark, [(f"2021-01-{p:02d}", p, p) for p, *_ in PRODUCTS])
    hierarchy = select.sold_products(sales, products_frame(spark, PRODUCTS))
    asked = {"a": "tea", "b": "mix", "c": "2", "d": "none", "e": "mix", "f": "food"}
    requests = spark.createDataFrame(list(asked.items()), "request_id string, request string")
    resolved = select.resolve_requests(requests, hierarchy)
    numbered = select.numbered_requests(resolved)
    assert rows_of(numbered, "request_id", "number") == [("a", 1), ("b", 2), ("c", 3), ("e", 4),
                                                         ("f", 5)]
    bitmaps = select.product_requests(numbered.withColumn("number", F.expr("number * 30000")),
                                      hierarchy)
    got = {}
    for row in bitmaps.select("product_code", select.bitmap_numbers("bucket", "bitmap")
                              .alias("numbers")).collect():
        got.setdefault(row["product_code"], []).extend(row["numbers"])
    assert {p: sorted(n // 30000 for n in numbers) for p, numbers in got.items()} == {
        1: [5], 2: [2, 3, 4, 5], 3: [1, 2, 4], 4: [1]}
    facts = select.wanted_rows(sales, bitmaps.select("product_code").distinct())
    assert facts.count() == 4


def test_levels_of_requests(spark):
    sales = sales_frame(spark, [(f"2021-01-{p:02d}", p, p) for p, *_ in PRODUCTS])
    hierarchy = select.sold_products(sales, products_frame(spark, PRODUCTS))
    requests = spark.createDataFrame([(t, t) for t in ("tea", "mix", "a", "green", "x")] +
                                     [("again", "mix")], "request_id string, request string")
    found = select.request_levels(select.resolve_requests(requests, hierarchy), hierarchy)
    assert rows_of(found, "request_id", "level", "entity") == [
        ("a", "subgroup", "a"), ("again", "group", "mix"), ("green", "product", "1"),
        ("mix", "group", "mix"), ("tea", "category", "tea")]
