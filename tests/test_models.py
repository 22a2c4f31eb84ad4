import math

import numpy as np
import pytest

from seasonwise.operators import models, series
from tests.helpers import day, sales_frame

T = np.arange(1, 25)


def window(spark, series_by_product):
    rows = [(f"{2019 + 2 * (t // 12)}-{t % 12 + 1:02d}-07", p, v)
            for p, values in series_by_product.items() for t, v in enumerate(values)]
    return series.model_window(series.monthly_spans(sales_frame(spark, rows),
                                                    levels=("product",)))


def trends(y):
    """Fitted functions of t per trend, by numpy; those on ln(y) only for positive y."""
    found = {"linear": np.poly1d(np.polyfit(T, y, 1)),
             "polynomial2": np.poly1d(np.polyfit(T, y, 2)),
             "polynomial3": np.poly1d(np.polyfit(T, y, 3))}
    a, b = np.polyfit(np.log(T), y, 1)
    found["log"] = lambda t: a * np.log(t) + b
    if min(y) > 0:
        k, ln_b = np.polyfit(T, np.log(y), 1)
        found["exp"] = lambda t: np.exp(ln_b) * np.exp(k * t)
        k2, ln_b2 = np.polyfit(np.log(T), np.log(y), 1)
        found["pow"] = lambda t: np.exp(ln_b2) * np.power(t, k2)
    return found


def expected(y):
    """{(trend, seasonality): (fit, r2, mape, mae, mse, rmse, index, function)}"""
    y, out = np.array(y, float), {}
    for trend, f in trends(y).items():
        for season in ("add", "mul"):
            raw = y - f(T) if season == "add" else y / f(T)
            index = np.tile((raw[:12] + raw[12:]) / 2, 2)
            if season == "add":
                index = index - index.sum() / 12
                fit = np.round(np.round(f(T) + index, 6))
            else:
                index = index / (index[:12].sum() / 12)
                fit = np.round(np.round(f(T) * index, 6))
            mse = ((y - fit) ** 2).mean()
            r2 = 1 - ((y - fit) ** 2).sum() / ((y - y.mean()) ** 2).sum()
            mape = None if 0 in y else round(np.mean(np.abs((y - fit) / y)) * 100, 3)
            out[trend, season] = (fit, r2, mape, int(np.abs(y - fit).mean()), int(mse),
                                  int(math.sqrt(mse)), index, f)
    return out


RNG = np.random.default_rng(11)
SERIES = {1: RNG.integers(50, 400, 24), 2: 100 + 5 * T + 40 * np.sin(T / 2).round(1),
          3: np.r_[0, RNG.integers(1, 60, 23)], 4: (20 * 1.08 ** T).round()}


def test_scores_and_fits_against_numpy(spark):
    points = models.model_points(window(spark, SERIES)).cache()
    scores = {(int(r["entity"]), r["trend"], r["seasonality"]): r
              for r in models.model_scores(points).collect()}
    assert len(scores) == 48
    for product, y in SERIES.items():
        wanted = expected(y)
        for trend in models.TRENDS:
            for season in models.SEASONALITIES:
                row = scores[product, trend, season]
                if (trend, season) not in wanted:
                    assert [row[m] for m in models.METRICS] == [None] * 5
                    continue
                _, r2, mape, mae, mse, rmse, *_ = wanted[trend, season]
                assert row["r2_exact"] == pytest.approx(r2, abs=1e-9)
                assert (row["mae"], row["mse"], row["rmse"]) == (mae, mse, rmse)
                assert (row["mape"] is None) == (mape is None)
                assert mape is None or row["mape"] == pytest.approx(mape, abs=1.1e-3)


def test_additive_index_of_least_squares_trends_sums_to_zero(spark):
    points = models.model_points(window(spark, SERIES))
    sums = (points.filter("seasonality = 'add' AND trend NOT IN ('exp', 'pow')")
            .groupBy("entity", "trend").sum("index").collect())
    assert sums and all(abs(r[2]) < 1e-6 for r in sums)


def test_multiplicative_index_averages_one(spark):
    points = models.model_points(window(spark, {1: SERIES[1]}))
    means = points.filter("seasonality = 'mul'").groupBy("trend").avg("index").collect()
    assert len(means) == 6 and all(r[1] == pytest.approx(1) for r in means)


def test_parameters_against_numpy(spark):
    row = models.parameters(window(spark, {1: SERIES[1]})).first()
    y = SERIES[1].astype(float)
    cubic = np.polyfit(T, y, 3)
    assert [row[f"poly3_{c}"] for c in "abcd"] == pytest.approx(cubic, rel=1e-7)
    assert [row[f"poly2_{c}"] for c in "abc"] == pytest.approx(np.polyfit(T, y, 2), rel=1e-8)
    assert [row["linear_k"], row["linear_b"]] == pytest.approx(np.polyfit(T, y, 1), rel=1e-9)
    assert [row["log_a"], row["log_b"]] == pytest.approx(np.polyfit(np.log(T), y, 1), rel=1e-9)
    k, b = np.polyfit(T, np.log(y), 1)
    assert [row["exp_k"], row["exp_b"]] == pytest.approx([k, math.exp(b)], rel=1e-9)


def test_best_model_and_its_points_agree(spark):
    points = models.model_points(window(spark, SERIES)).cache()
    best = {r["entity"]: (r["trend"], r["seasonality"])
            for r in models.best_models(models.model_scores(points)).collect()}
    chosen = {r["entity"]: (r["trend"], r["seasonality"])
              for r in models.best_points(points).collect()}
    assert best == chosen and len(best) == 4
    for product, y in SERIES.items():
        wanted = expected(y)
        top = max(v[1] for v in wanted.values())
        assert wanted[best[str(product)]][1] == pytest.approx(top, abs=1e-12)


def test_exact_line_and_ties(spark):
    points = models.model_points(window(spark, {1: 3 * T + 5})).cache()
    scores = models.model_scores(points)
    assert [(r["trend"], r["seasonality"], r["r2"]) for r in
            models.best_models(scores).collect()] == [("linear", "add", 1.0)]
    ahead = models.forecast(models.best_points(points), 3).orderBy("t").collect()
    assert [r["t"] for r in ahead] == [25, 26, 27]
    assert [r["forecast"] for r in ahead] == pytest.approx([80, 83, 86])
    assert [r["month_label"] for r in ahead] == ["01/2022", "02/2022", "03/2022"]


def test_constant_and_zero_series(spark):
    scores = models.model_scores(models.model_points(window(spark, {1: [7] * 24, 2: [0] * 24})))
    rows = {(r["entity"], r["trend"], r["seasonality"]): r for r in scores.collect()}
    assert rows["1", "linear", "add"]["r2"] == 1.0
    assert rows["2", "linear", "add"]["r2"] == 1.0
    assert rows["2", "linear", "add"]["mape"] is None
    assert rows["2", "exp", "add"]["r2"] is None and rows["2", "linear", "mul"]["r2"] is None


def test_forecast_continues_trend_and_season(spark):
    points = models.model_points(window(spark, SERIES))
    ahead = models.forecast(models.best_points(points), 12).collect()
    assert len(ahead) == 48
    for row in ahead:
        wanted = expected(SERIES[int(row["entity"])])[row["trend"], row["seasonality"]]
        index, f = wanted[6], wanted[7]
        trend, season = f(row["t"]), index[(row["t"] - 1) % 12]
        value = trend + season if row["seasonality"] == "add" else trend * season
        assert row["forecast"] == pytest.approx(value, rel=1e-6, abs=1e-6)


def test_chart_and_horizon(spark):
    best = models.best_points(models.model_points(window(spark, {1: SERIES[1]}))).cache()
    assert models.chart_frame(best).count() == 24
    chart = models.chart_frame(best, 2, {2019: 2020})
    assert chart.count() == 26
    labels = {r["month_label"] for r in chart.collect()}
    assert "01/2020" in labels and "01/2019" not in labels
    with pytest.raises(ValueError):
        models.chart_frame(best, -1)


def test_forecasts_reach_as_far_as_asked(spark):
    """Trend at any later month, index of the same month of the year, for every model."""
    points = models.model_points(window(spark, {1: SERIES[1]}))
    ahead = models.forecast(points.filter("trend = 'polynomial3' AND seasonality = 'add'"), 30)
    rows = ahead.orderBy("t").collect()
    assert [r["t"] for r in rows] == list(range(25, 55))
    fit = np.polyfit(T, np.asarray(SERIES[1], float), 3)
    assert [r["trend_value"] for r in rows] == pytest.approx(
        [np.polyval(fit, t) for t in range(25, 55)], rel=1e-6, abs=1e-6)
    indices = [r["forecast"] - r["trend_value"] for r in rows]
    assert indices[:18] == pytest.approx(indices[12:], abs=1e-6)
    assert rows[-1]["month_start"] == day("2024-06-01")


def test_table_order_and_card(spark):
    scores = models.model_scores(models.model_points(window(spark, {3: SERIES[3]}))).cache()
    table = models.metrics_table(scores).collect()
    r2 = [r["r2"] for r in table if r["r2"] is not None]
    assert r2 == sorted(r2, reverse=True) and table[-1]["r2"] is None
    card = models.metrics_card(scores).first()
    assert card["r2"] == str(table[0]["r2"]).replace(".", ",") and card["mape"] is None
