import numpy as np

from seasonwise.operators import describe, select, series
from tests.helpers import months, products_frame, sales_frame

VALUES = [12, 7, 31, 5, 5, 90, 14, 8, 22, 17, 3, 11]


def spans(spark, values):
    return series.monthly_spans(
        sales_frame(spark, [(d, 1, v) for d, v in months(2021, values)]), levels=("product",))


def test_statistics_against_numpy(spark):
    row = describe.monthly_statistics(spans(spark, VALUES)).first()
    y = np.array(VALUES, float)
    q1, median, q3 = np.percentile(y, [25, 50, 75])
    assert (row["mean"], row["std"], row["min"], row["max"]) == (
        round(y.mean()), int(y.std(ddof=1)), 3, 90)
    assert (row["q1"], row["median"], row["q3"]) == (int(q1), int(median), int(q3))
    assert row["cv_pct"] == int(y.std(ddof=1) / y.mean() * 100)


def test_single_month_has_no_spread(spark):
    sales = sales_frame(spark, [("2021-01-01", 1, 4)])
    row = describe.monthly_statistics(series.monthly_spans(sales, levels=("product",))).first()
    assert (row["mean"], row["std"], row["cv_pct"]) == (4, None, None)


def test_boxplot(spark):
    row = describe.boxplot_numbers(spans(spark, VALUES)).first()
    q1, q3 = np.percentile(VALUES, [25, 75])
    assert row["lower_fence"] == 3.0
    assert row["upper_fence"] == max(v for v in VALUES if v < q3 + 1.5 * (q3 - q1))
    assert (row["q1"], row["q3"]) == (round(q1), round(q3))


def test_boxplot_of_a_constant_series_has_no_upper_fence(spark):
    assert describe.boxplot_numbers(spans(spark, [4] * 12)).first()["upper_fence"] is None


def test_line_names_months(spark):
    names = [r["month_name"] for r in
             describe.line_chart(spans(spark, VALUES)).orderBy("month_start").collect()]
    assert (names[0], names[-1], len(names)) == ("Январь", "Декабрь", 12)


def test_cards_count_what_is_below(spark):
    products = products_frame(spark, [(1, "c", "g", "s"), (2, "c", "g", "t"), (3, "c", "h", "u"),
                                      (4, "c", "h", "u")])
    sales = sales_frame(spark, [("2021-01-01", p, 1) for p in (1, 2, 3)])
    cards = {(r["level"], r["entity"]): r for r in
             describe.entity_cards(select.sold_products(sales, products)).collect()}
    category, group = cards["category", "c"], cards["group", "g"]
    assert (category["n_products"], category["n_subgroups"], category["n_groups"]) == (3, 3, 2)
    assert (group["n_products"], group["n_subgroups"], group["n_groups"]) == (2, 2, None)
    assert (cards["product", "3"]["subgroup"], cards["product", "3"]["n_products"]) == ("u", None)
    assert ("product", "4") not in cards
