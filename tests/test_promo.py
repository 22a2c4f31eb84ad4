import pytest

from pyspark.sql import functions as F

from seasonwise.operators import promo
from seasonwise.operators.series import product_totals
from tests.helpers import day, rows_of, sales_frame


def sales(spark):
    rows = []
    for m in range(1, 13):
        # 1: ordinary days with mean 2.5 and a promo day sold twice
        rows += [(f"2021-{m:02d}-03", 1, 2), (f"2021-{m:02d}-04", 1, 3),
                 (f"2021-{m:02d}-15", 1, 50), (f"2021-{m:02d}-15", 1, 60)]
        # 2: promo days only
        rows.append((f"2021-{m:02d}-15", 2, 7))
        # 3: no ordinary day in December
        if m < 12:
            rows.append((f"2021-{m:02d}-10", 3, 4))
        rows.append((f"2021-{m:02d}-15", 3, 4))
        # 4: promo days only, and not every month
        if m != 5:
            rows.append((f"2021-{m:02d}-15", 4, 1))
        # 5: never sold on promo days, two years pooled
        rows.append((f"{2020 + m % 2}-{m:02d}-20", 5, 1))
    return sales_frame(spark, rows)


def test_baseline_is_half_even(spark):
    baseline = promo.promo_baseline(sales(spark)).filter("product_code = 1")
    assert {r.baseline for r in baseline.collect()} == {2.0}


def test_gates(spark):
    frame = sales(spark)
    assert rows_of(promo.incomplete_products(frame), "product_code") == [(3,)]
    assert rows_of(promo.complete_products(frame), "product_code") == [(1,), (2,), (5,)]


def test_replacement(spark):
    replaced = promo.neutralise_promo(sales(spark)).filter(F.col("date") == day("2021-01-15"))
    # Both promo rows of product 1 get the baseline, product 2 has none and keeps its value.
    assert rows_of(replaced, "product_code", "turnover_qty") == [(1, 2.0), (1, 2.0), (2, 7.0)]


def test_ordinary_days_and_duplicates_are_kept(spark):
    frame = sales(spark)
    twice = frame.union(frame)
    assert promo.neutralise_promo(twice).count() == 2 * promo.neutralise_promo(frame).count()


@pytest.mark.parametrize("period, time", [("month", "month_start"), ("day", "day")])
def test_totals_in_one_pass_equal_the_replaced_facts(spark, period, time):
    frame = sales(spark)
    expected = rows_of(product_totals(promo.neutralise_promo(frame), period),
                       "product_code", time, "turnover")
    assert rows_of(promo.promo_free_totals(frame, period), "product_code", time,
                   "turnover") == expected


def test_other_promo_day_and_months(spark):
    frame = sales_frame(spark, [("2021-01-01", 1, 9), ("2021-01-02", 1, 4),
                                ("2021-02-01", 1, 9), ("2021-02-02", 1, 6)])
    replaced = promo.neutralise_promo(frame, promo_day=1, min_months=2)
    assert rows_of(replaced, "date", "turnover_qty") == [
        (day("2021-01-01"), 4.0), (day("2021-01-02"), 4.0),
        (day("2021-02-01"), 6.0), (day("2021-02-02"), 6.0)]
