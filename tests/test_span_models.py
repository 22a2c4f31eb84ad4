"""Models on other spans than two years, beside numpy and the two-year models."""

import math

import numpy as np
import pytest

from seasonwise.operators import models, series, span_models
from tests.helpers import rows_of, sales_frame

RNG = np.random.default_rng(11)


def spans_of(spark, by_product):
    """Gap-filled months of products with the given monthly values from January 2015 on."""
    rows = [(f"{2015 + m // 12}-{m % 12 + 1:02d}-03", p, v)
            for p, values in by_product.items() for m, v in enumerate(values)]
    return series.monthly_spans(sales_frame(spark, rows), levels=("product",))


def wave(n):
    return [max(1, round(200 + 3 * t + 40 * math.sin(t / 2) + x))
            for t, x in zip(range(n), RNG.normal(0, 15, n))]


def test_trends_of_any_span(spark):
    data = {n: wave(n) for n in (4, 5, 24, 25, 37, 84, 131)}
    window = span_models.span_window(spans_of(spark, data), 4)
    rows = span_models.span_points(window).filter("seasonality = 'add'").collect()
    for n, y in data.items():
        t = np.arange(1, n + 1)
        log = np.polyfit(np.log(t), y, 1)
        want = {"linear": np.polyval(np.polyfit(t, y, 1), t),
                "polynomial2": np.polyval(np.polyfit(t, y, 2), t),
                "polynomial3": np.polyval(np.polyfit(t - n / 2, y, 3), t - n / 2),
                "log": np.polyval(log, np.log(t)),
                "exp": np.exp(np.polyval(np.polyfit(t, np.log(y), 1), t)),
                "pow": np.exp(np.polyval(np.polyfit(np.log(t), np.log(y), 1), np.log(t)))}
        for trend, values in want.items():
            got = sorted((r["t"], r["trend_value"]) for r in rows
                         if r["entity"] == str(n) and r["trend"] == trend)
            assert [v for _, v in got] == pytest.approx(values, rel=1e-8)


def test_index_is_the_mean_residual_of_all_years(spark):
    y = wave(40)
    points = span_models.span_points(span_models.span_window(spans_of(spark, {1: y})))
    t = np.arange(1, 41)
    residual = np.array(y) - np.polyval(np.polyfit(t, y, 1), t)
    raw = np.array([residual[i::12].mean() for i in range(12)])
    rows = {r["t"]: r for r in points.filter("trend = 'linear' AND seasonality = 'add'").collect()}
    assert [rows[i + 1]["index"] for i in range(12)] == pytest.approx(raw - 2 * raw.mean())
    ratio = np.array(y) / np.polyval(np.polyfit(t, y, 1), t)
    raw = np.array([ratio[i::12].mean() for i in range(12)])
    rows = {r["t"]: r for r in points.filter("trend = 'linear' AND seasonality = 'mul'").collect()}
    assert [rows[i + 1]["index"] for i in range(12)] == pytest.approx(raw / raw.mean())


def test_two_years_are_as_before(spark):
    data = {1: wave(24), 2: [5] * 24, 3: [0, 3] * 12, 4: [max(0, v - 215) for v in wave(24)]}
    # The two-year window skips a year in the middle; the same points without it.
    skipped = {p: y[:12] + [1] * 12 + y[12:] for p, y in data.items()}
    before = models.model_points(series.model_window(spans_of(spark, skipped)))
    points = span_models.span_points(span_models.span_window(spans_of(spark, data)))
    columns = ["entity", "ord", "trend", "seasonality", *models.METRICS]
    got = rows_of(span_models.span_scores(points).na.fill(-1), *columns)
    assert got == rows_of(models.model_scores(before).na.fill(-1), *columns)
    best = span_models.best_span_points(points)
    assert rows_of(best.select("entity", "trend", "seasonality").distinct(), "entity", "trend",
                   "seasonality") == rows_of(models.best_points(before).select(
                       "entity", "trend", "seasonality").distinct(), "entity", "trend",
                       "seasonality")
    ahead = [[(r["entity"], r["t"], round(r["forecast"], 6)) for r in rows.orderBy(
        "entity", "t").collect()] for rows in (span_models.span_forecast(best, 15), models.forecast(
            models.best_points(before), 15))]
    assert ahead[0] == ahead[1] and len(ahead[0]) == 4 * 15


def test_forecast_goes_on_after_the_span(spark):
    line = [10 * t + 7 for t in range(1, 31)]
    window = span_models.span_window(spans_of(spark, {1: line}))
    best = span_models.best_span_points(span_models.span_points(window))
    rows = span_models.span_forecast(best, 14).orderBy("t").collect()
    assert [r["t"] for r in rows] == list(range(31, 45))
    assert [r["forecast"] for r in rows] == pytest.approx([10 * t + 7 for t in range(31, 45)])
    assert str(rows[0]["month_start"]) == "2017-07-01" and rows[0]["month_label"] == "07/2017"
    assert span_models.span_forecast(best, 0).count() == 0
    with pytest.raises(ValueError):
        span_models.span_forecast(best, -1)


def test_short_spans_are_left_out(spark):
    spans = spans_of(spark, {1: wave(23), 2: wave(24)})
    assert rows_of(span_models.span_window(spans).select("entity").distinct(), "entity") == [("2",)]
    assert span_models.span_window(spans.limit(0)).count() == 0
    with pytest.raises(ValueError):
        span_models.span_window(spans, 3)


def test_a_zero_month_has_no_logarithm(spark):
    y = wave(30)
    y[7] = 0
    scores = span_models.span_scores(span_models.span_points(
        span_models.span_window(spans_of(spark, {1: y}))))
    assert {r["trend"] for r in scores.filter("r2 IS NULL").collect()} == {"exp", "pow"}
    assert scores.filter("mape IS NOT NULL").count() == 0
