from seasonwise.operators import series
from tests.helpers import day, products_frame, rows_of, sales_frame

PRODUCTS = [(1, "c", "g", "s"), (2, "c", "g", "t"), (3, "d", "g", "s")]


def test_missing_months_are_zero_inside_the_own_range(spark):
    sales = sales_frame(spark, [("2021-01-31", 1, 2), ("2021-01-01", 1, 3), ("2021-04-10", 1, 4),
                                ("2021-06-01", 2, 1)])
    monthly = series.monthly_series(sales, levels=("product",))
    assert rows_of(monthly, "entity", "month_start", "turnover") == [
        ("1", day("2021-01-01"), 5.0), ("1", day("2021-02-01"), 0.0),
        ("1", day("2021-03-01"), 0.0), ("1", day("2021-04-01"), 4.0),
        ("2", day("2021-06-01"), 1.0)]


def test_missing_days(spark):
    sales = sales_frame(spark, [("2020-02-27", 1, 2), ("2020-03-01", 1, 4)])
    daily = series.daily_series(sales, levels=("product",))
    assert [r[1] for r in rows_of(daily, "day", "turnover")] == [2.0, 0.0, 0.0, 4.0]


def test_levels_are_grouped_by_name_only(spark):
    sales = sales_frame(spark, [("2021-01-05", p, 10 ** p) for p in (1, 2, 3)]
                        + [("2021-01-06", 9, 5)])
    monthly = series.monthly_series(sales, products_frame(spark, PRODUCTS))
    # Product 9 has no dimension row: it is an entity of its own and part of nothing else.
    assert rows_of(monthly, "level", "entity", "turnover") == [
        ("category", "c", 110.0), ("category", "d", 1000.0), ("group", "g", 1110.0),
        ("product", "1", 10.0), ("product", "2", 100.0), ("product", "3", 1000.0),
        ("product", "9", 5.0), ("subgroup", "s", 1010.0), ("subgroup", "t", 100.0)]


def test_hierarchy_on_the_facts_gives_the_same(spark):
    sales = sales_frame(spark, [(f"2021-0{m}-05", p, m * p) for p in (1, 2, 3) for m in (1, 3)])
    products = products_frame(spark, PRODUCTS)
    columns = ("level", "entity", "month_start", "turnover")
    assert rows_of(series.monthly_series(sales.join(products, "product_code")), *columns) == \
        rows_of(series.monthly_series(sales, products), *columns)


def test_span_columns(spark):
    sales = sales_frame(spark, [("2020-11-05", 1, 6), ("2021-02-05", 1, 2)])
    row = series.monthly_spans(sales, levels=("product",)).first()
    assert (row["first"], row["last"], row.periods, row.total, row.mean) == (
        day("2020-11-01"), day("2021-02-01"), 4, 8.0, 2.0)


def window(spark, rows):
    return series.model_window(series.monthly_spans(sales_frame(spark, rows),
                                                    levels=("product",)))


def test_model_window_skips_the_middle_year(spark):
    rows = [(f"{y}-{m:02d}-09", 1, y - 2000 + m) for y in (2019, 2021) for m in range(1, 13)]
    got = rows_of(window(spark, rows), "t", "month_start", "turnover")
    assert [g[0] for g in got] == list(range(1, 25))
    assert got[11] == (12, day("2019-12-01"), 31.0) and got[12] == (13, day("2021-01-01"), 22.0)


def test_late_start_has_no_window(spark):
    rows = [(f"{y}-{m:02d}-09", 1, 5) for y in (2019, 2021) for m in range(1, 13)]
    assert window(spark, rows[1:]).count() == 0
    assert window(spark, rows[:-1]).count() == 0


def test_calendar_totals_pool_years(spark):
    sales = sales_frame(spark, [("2020-03-01", 1, 1), ("2021-03-31", 1, 2), ("2021-05-01", 1, 4)])
    assert rows_of(series.calendar_product_totals(sales), "month", "turnover") == [
        (3, 3.0), (5, 4.0)]
