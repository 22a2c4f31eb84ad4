import numpy as np
import pytest

from seasonwise.operators import correlation, series
from tests.helpers import products_frame, sales_frame

RNG = np.random.default_rng(5)
WAVE = 60 + 40 * np.sin(np.arange(24) / 3).round(2)
SERIES = {1: WAVE, 2: WAVE * 2 + RNG.integers(0, 9, 24), 3: RNG.integers(0, 99, 24),
          4: np.full(24, 5)}
PRODUCTS = [(1, "c", "g", "s"), (2, "c", "g", "s"), (3, "c", "h", "u"), (4, "d", "k", "v")]


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(f"{2019 + 2 * (t // 12)}-{t % 12 + 1:02d}-07", p, v)
            for p, values in SERIES.items() for t, v in enumerate(values)]
    products = products_frame(spark, PRODUCTS)
    window = series.model_window(series.monthly_spans(sales_frame(spark, rows), products))
    return window, products


def test_against_numpy(frames):
    window, products = frames
    rows = {(r["product_code"], r["parent_level"]): r["correlation"]
            for r in correlation.parent_correlations(window, products).collect()}
    parents = {"s": SERIES[1] + SERIES[2], "u": SERIES[3],
               "c": SERIES[1] + SERIES[2] + SERIES[3]}
    for product, level, name in ((1, "subgroup", "s"), (2, "group", "s"), (3, "subgroup", "u"),
                                 (1, "category", "c"), (3, "category", "c")):
        wanted = np.corrcoef(SERIES[product], parents[name])[0][1]
        assert rows[product, level] == pytest.approx(wanted, abs=5.1e-4)
    assert rows[4, "group"] is None  # a constant series correlates with nothing


def test_best_parent_prefers_the_narrower_one(frames):
    window, products = frames
    correlations = correlation.parent_correlations(window, products)
    best = {r["product_code"]: r for r in correlation.best_parents(correlations).collect()}
    # Subgroup s and group g are the same series here.
    assert (best[1]["parent_level"], best[3]["parent_level"]) == ("subgroup", "subgroup")
    assert 4 not in best
    assert correlation.best_parents(correlations, minimum=1.1).count() == 0


def test_table(frames):
    window, products = frames
    table = {r["product_code"]: r for r in correlation.correlation_table(
        correlation.parent_correlations(window, products)).collect()}
    assert table[3]["subgroup"] == 1.0 and set(table) == {1, 2, 3, 4}


def test_parent_model(frames):
    window, products = frames
    best = correlation.best_parents(correlation.parent_correlations(window, products))
    rows = correlation.parent_models(window, best).filter("product_code = 1").orderBy("t").collect()
    y = SERIES[1] + SERIES[2]
    trend = np.poly1d(np.polyfit(np.arange(1, 25), y, 1))(np.arange(1, 25))
    index = np.tile(((y - trend)[:12] + (y - trend)[12:]) / 2, 2)
    wanted = np.round(trend + index - index[:12].sum() / 12)
    assert [r["parent_fit"] for r in rows] == pytest.approx(wanted)
    assert [r["product_turnover"] for r in rows] == pytest.approx(WAVE)
    assert [r["parent_turnover"] for r in rows] == pytest.approx(y)
