import numpy as np
import pytest

from seasonwise.operators import select, stability
from tests.helpers import months, products_frame, rows_of, sales_frame

RNG = np.random.default_rng(9)
VALUES = {p: RNG.integers(1, 60, 12) for p in range(1, 10)}
PRODUCTS = [(p, "c", f"g{p % 3}", f"s{p}") for p in range(1, 8)] + [
    (8, "d", "x", "y"), (9, "d", "x", "z"), (10, "e", "w", "w"), (11, "c", "g1", "s11")]


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(d, p, v) for p in VALUES for d, v in months(2021, VALUES[p])]
    rows += [(d, 10, 0) for d, _ in months(2021, range(12))]          # never sells
    rows += [(d, 11, 5) for d, _ in months(2021, range(12))][:11]     # one month missing
    rows += [("2020-12-01", 11, 5), ("2020-12-01", 1, 99)]            # another year
    return sales_frame(spark, rows), products_frame(spark, PRODUCTS)


def variation(values):
    return np.std(values, ddof=1) / np.mean(values) * 100


def classified(frames):
    complete = stability.complete_year_totals(frames[0], 2021, frames[1])
    products = stability.product_variation(complete)
    return stability.classify(products, stability.category_limits(products))


def test_classes_against_numpy(frames):
    rows = {r["product_code"]: r for r in classified(frames).collect()}
    assert 11 not in rows
    # No variation, so its category has no limits either; the product stays.
    assert (rows[10]["variation"], rows[10]["x_limit"], rows[10]["sector"]) == (None, None, None)
    for category, members in (("c", range(1, 8)), ("d", (8, 9))):
        v = {p: variation(VALUES[p]) for p in members}
        x, y = np.percentile(list(v.values()), [33, 66])
        for p in members:
            assert rows[p]["variation"] == pytest.approx(v[p])
            assert rows[p]["sector"] == ("X" if v[p] <= x else "Y" if v[p] <= y else "Z")


def test_summary_has_three_rows_and_all_products(frames):
    summary = stability.sector_summary(classified(frames))
    counts = rows_of(summary, "category", "sector", "n_products", "limits")
    assert [c[:2] for c in counts] == [(c, s) for c in "cde" for s in "XYZ"]
    assert [c[2:] for c in counts[6:]] == [(0, None)] * 3
    assert sum(c[2] for c in counts if c[0] == "c") == 7
    x = np.percentile([variation(VALUES[p]) for p in range(1, 8)], 33)
    assert counts[0][3] == f"V<={x:.0f}"


def test_groups_use_the_same_limits(frames):
    complete = stability.complete_year_totals(frames[0], 2021, frames[1])
    limits = stability.category_limits(stability.product_variation(complete))
    groups = {r["group"]: r for r in stability.classify(
        stability.group_variation(complete), limits).collect()}
    assert groups["g1"]["variation"] == pytest.approx(
        variation(VALUES[1] + VALUES[4] + VALUES[7]))
    curve = stability.group_curve(stability.classify(stability.group_variation(complete), limits))
    rows = curve.filter("category = 'c'").orderBy("position").collect()
    assert [r["variation"] for r in rows] == sorted(r["variation"] for r in rows)
    without = stability.group_curve(stability.classify(
        stability.group_variation(complete), limits), exclude_groups=("g1",))
    assert without.filter("category = 'c'").count() == len(rows) - 1


def test_curve_labels(spark):
    groups = spark.createDataFrame(
        [("c", f"g{i}", float(v), 10.0, 20.0) for i, v in enumerate([5, 8, 10, 12, 20, 25, 30])],
        "category string, group string, variation double, x_limit double, y_limit double")
    rows = stability.group_curve(groups).orderBy("position").collect()
    def at(flag):
        return [r["position"] for r in rows if r[flag]]
    # Parts: up to 10 -> 3 groups, 10 to below 20 -> 2, from 20 -> 3; middle is round(n / 2).
    assert (at("x_line"), at("y_line")) == ([3], [5])
    assert (at("x_label"), at("y_label"), at("z_label")) == ([3], [4], [7])


def test_one_product_alone_is_not_classified(frames):
    sales, products = frames
    hierarchy = select.sold_products(sales, products)
    kept = stability.only_applicable(classified(frames), select.multi_product_entities(hierarchy),
                                     "subgroup")
    assert kept.count() == 0


def test_members_per_sector(frames):
    rows = stability.sector_groups(classified(frames)).collect()
    assert sum(r["n_products"] for r in rows) == 9


def test_a_group_is_known_by_name(spark):
    """One below two categories has one variation, compared with the limits of both."""
    products = products_frame(spark, [(1, "c", "g", "s"), (2, "d", "g", "s"), (3, "d", "h", None)])
    rows = [(d, p, v) for p in (1, 2, 3) for d, v in months(2021, VALUES[p])]
    complete = stability.complete_year_totals(sales_frame(spark, rows), 2021, products)
    found = {(r.category, r.group): r.variation for r in stability.group_variation(complete).collect()}
    whole = pytest.approx(variation(VALUES[1] + VALUES[2]))
    assert found == {("c", "g"): whole, ("d", "g"): whole,
                     ("d", "h"): pytest.approx(variation(VALUES[3]))}
    # Limits take products without a subgroup too, the class table does not.
    each = stability.product_variation(complete)
    assert each.count() == 3 and stability.named_products(each).count() == 2


def test_table_is_limited(frames):
    assert stability.product_table(classified(frames)).count() == 10
    table = stability.product_table(classified(frames), 3).collect()
    assert [r["product_code"] for r in table] == [3, 6, 1]
    assert "," in table[0]["variation"]
