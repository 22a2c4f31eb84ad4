import numpy as np
import pytest

from seasonwise.operators.clean import attach_hierarchy
from seasonwise.plans.dashboard import VIEWS, dashboard_view
from tests.helpers import months, products_frame, rows_of, sales_frame

RNG = np.random.default_rng(4)
PRODUCTS = [(p, "c" if p < 12 else "d", f"g{p % 3}", f"s{p % 5}") for p in range(1, 15)]


@pytest.fixture(scope="module")
def facts(spark):
    rows = [(d, p, v) for p, *_ in PRODUCTS for year in (2019, 2021)
            for d, v in months(year, RNG.integers(5, 90, 12))]
    return attach_hierarchy(sales_frame(spark, rows),
                            products_frame(spark, PRODUCTS)).cache()


@pytest.mark.parametrize("view", VIEWS)
def test_every_view_has_rows(facts, view):
    assert dashboard_view(facts, view, category="c", year=2021, horizon=2).count() > 0


@pytest.mark.parametrize("view", VIEWS)
def test_single_product(facts, view):
    rows = dashboard_view(facts, view, category="c", product_code=1, year=2021).count()
    assert (rows == 0) == view.startswith(("xyz", "cluster"))


def test_selection_is_summed(facts):
    rows = dashboard_view(facts, "lin_turn", category="c", group="g1", start_date="2021-01-01",
                          end_date="2021-02-28")
    wanted = (facts.filter("category = 'c' AND `group` = 'g1' AND year(date) = 2021 "
                           "AND month(date) <= 2").groupBy("date").sum("turnover_qty"))
    assert [r[1] for r in rows_of(rows, "month_start", "turnover")] == [
        r[1] for r in rows_of(wanted, "date", "sum(turnover_qty)")]


def test_threshold_follows_the_category(facts):
    default = dashboard_view(facts, "seas_tab", category="c")
    lower = dashboard_view(facts, "seas_tab", category="c", by_category={"c": 10})
    high = "month_class = 'high'"
    assert lower.filter(high).count() > default.filter(high).count()


def test_nothing_selected(facts):
    assert dashboard_view(facts, "seas_tab", category="nothing").count() == 0
    assert dashboard_view(facts, "lin_turn", category="nothing").count() == 0


def test_unknown_view(facts):
    with pytest.raises(ValueError):
        dashboard_view(facts, "pie")
