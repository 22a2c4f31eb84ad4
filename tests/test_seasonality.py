import numpy as np
import pytest

from pyspark.sql import functions as F

from seasonwise.operators import seasonality, select, series
from tests.helpers import day, months, products_frame, rows_of, sales_frame

PRODUCTS = [(1, "c", "g", "s"), (2, "c", "g", "t"), (3, "d", "g", "s"), (4, "d", "h", "u")]


def test_thresholds_against_numpy(spark):
    rng = np.random.default_rng(3)
    values = {p: rng.integers(0, 40, 12) for p in (1, 2, 3)}
    values[4] = np.zeros(12)  # all zero: no coefficients
    sales = sales_frame(spark, [(d, p, v) for p in values for d, v in months(2021, values[p])])
    coefficients = seasonality.product_month_coefficients(sales, products_frame(spark, PRODUCTS))
    assert coefficients.filter("product_code = 4 AND coefficient IS NOT NULL").count() == 0
    pooled = np.concatenate([values[p] / values[p].mean() for p in (1, 2)])
    other = values[3] / values[3].mean()
    got = dict(rows_of(seasonality.category_thresholds(coefficients, by_category={"d": 65}),
                       "category", "threshold"))
    assert got == {"c": round(np.percentile(pooled, 75), 2),
                   "d": round(np.percentile(other, 65), 2)}


def test_mean_uses_existing_months_only(spark):
    sales = sales_frame(spark, [("2021-01-01", 1, 3), ("2021-07-01", 1, 9)])
    assert rows_of(seasonality.product_month_coefficients(sales), "month", "coefficient") == [
        (1, 0.5), (7, 1.5)]


def test_histogram_shares(spark):
    coefficients = spark.createDataFrame(
        [("c", v) for v in (0.05, 0.09, 1.0, 5.0, None)], "category string, coefficient double")
    assert rows_of(seasonality.coefficient_histogram(coefficients), "bin_start", "n") == [
        (0.0, 2), (1.0, 1)]
    shares = seasonality.coefficient_histogram(coefficients).agg(F.sum("share_pct")).first()[0]
    assert shares == pytest.approx(100)


def spans(spark, rows, daily=False):
    make = series.daily_spans if daily else series.monthly_spans
    return make(sales_frame(spark, rows), levels=("product",))


def test_classes_deviations_and_markers(spark):
    classes = seasonality.month_classes(
        spans(spark, [(d, 1, v) for d, v in months(2021, [10] * 10 + [5, 15])]))
    assert [r[1] for r in rows_of(classes, "month_start", "month_class")] == (
        ["normal"] * 10 + ["low", "high"])
    table = {r["month_start"].month: r for r in seasonality.deviation_table(classes).collect()}
    assert (table[12]["turnover_text"], table[12]["deviation_text"]) == ("15", "+50,00")
    bars = {r["month_start"].month: r for r in seasonality.deviation_bars(classes).collect()}
    assert (bars[11]["bar_class"], bars[11]["label"], bars[11]["bar_pct"]) == (
        "low", "-50.00", -50.0)
    assert bars[1]["bar_class"] == "within"
    assert rows_of(seasonality.season_markers(classes), "month_class", "turnover") == [
        ("high", 15.0), ("low", 5.0)]


def test_all_zero_entity_has_no_class(spark):
    classes = seasonality.month_classes(spans(spark, [("2021-01-01", 1, 0), ("2021-03-01", 1, 0)]))
    assert rows_of(classes, "month_class") == [(None,)] * 3


DAYS = ([("2021-01-01", 1, 1), ("2021-02-03", 1, 1)]
        # March is high: the promo day sells most, then the 7th and 9th alike
        + [("2021-03-15", 1, 40), ("2021-03-09", 1, 20), ("2021-03-07", 1, 20)]
        + [("2021-04-30", 1, 1)])


def test_peak_day_skips_the_promo_day_and_takes_the_first(spark):
    peaks = {r["month_start"].month: r for r in
             seasonality.peak_days(spans(spark, DAYS, daily=True)).collect()}
    assert (peaks[3]["month_class"], peaks[3]["day"]) == ("high", day("2021-03-07"))
    assert peaks[3]["deviation_pct"] == round((80 / (83 / 4) - 1) * 100, 2)
    # The first day without sales is the trough, and the deviation is positive.
    assert (peaks[1]["day"], peaks[2]["day"]) == (day("2021-01-02"), day("2021-02-01"))
    assert peaks[1]["deviation_pct"] == round((1 - 1 / (83 / 4)) * 100, 2)


def test_extreme_days_keep_ties_and_the_promo_day(spark):
    found = seasonality.extreme_days(spans(spark, DAYS, daily=True))
    assert rows_of(found.filter("month_class = 'high'"), "day") == [(day("2021-03-15"),)]
    assert found.filter("month_start = DATE '2021-02-01'").count() == 27
    tied = spans(spark, DAYS + [("2021-03-20", 1, 40)], daily=True)
    assert rows_of(seasonality.extreme_days(tied).filter("month_class = 'high'"), "day") == [
        (day("2021-03-15"),), (day("2021-03-20"),)]


def test_no_season_at_all(spark):
    flat = [(d, 1, 5) for d, _ in months(2021, range(12))]
    assert seasonality.peak_days(spans(spark, flat, daily=True)).count() == 0


def test_own_threshold(spark):
    sales = sales_frame(spark, [(d, p, 10 + p * (d[5:7] == "12")) for p in (1, 3)
                                for d, _ in months(2021, range(12))])
    products = products_frame(spark, PRODUCTS)
    thresholds = spark.createDataFrame([("c", 1.5), ("d", 1.05)],
                                       "category string, threshold double")
    hierarchy = select.sold_products(sales, products)
    rated = seasonality.month_classes(seasonality.with_category_threshold(
        series.monthly_spans(sales, products), thresholds, hierarchy), threshold=None)
    high = rows_of(rated.filter("month_class = 'high'"), "level", "entity", "threshold")
    # Group g and subgroup s belong to both categories; the first by name gives the threshold.
    assert high == [("category", "d", 1.05), ("product", "3", 1.05)]


def test_category_of_a_request(spark):
    sales = sales_frame(spark, [("2021-01-01", p, 1) for p in (1, 2, 3, 4)])
    hierarchy = select.sold_products(sales, products_frame(spark, PRODUCTS))
    requests = spark.createDataFrame([(t, t) for t in ("g", "h", "3")],
                                     "request_id string, request string")
    resolved = select.resolve_requests(requests, hierarchy)
    assert rows_of(seasonality.request_categories(resolved, hierarchy),
                   "request_id", "category") == [("3", "d"), ("g", "c"), ("h", "d")]
