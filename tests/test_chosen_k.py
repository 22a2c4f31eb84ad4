"""The number of clusters is that of the plain silhouette, also where its bounds leave several k."""

import numpy as np
import pytest

from seasonwise.operators import clusters, kmeans, silhouette
from seasonwise.operators.clean import attach_hierarchy
from seasonwise.plans import catalog
from tests.helpers import months, products_frame, rows_of, sales_frame
from tests.test_clusters import plain_silhouette, profiles_of

rate = silhouette.rate
PRODUCTS = [(p, "ASIA", f"g{p % 3}", f"s{p % 5}") for p in range(1, 121)]


@pytest.fixture(scope="module")
def sales(spark):
    """Products without clear clusters: the middle of the bounds is best at 3, the silhouette at 8."""
    rng = np.random.default_rng(9)
    return sales_frame(spark, [(d, p, v) for p, *_ in PRODUCTS
                               for d, v in months(2021, rng.integers(1, 100, 12))]).cache()


@pytest.fixture(scope="module")
def plain(sales):
    """(k, labels, silhouettes): from the labels of all k and all pairs in numpy."""
    fit = clusters.fit_clusters(clusters.monthly_profiles(clusters.product_months(sales)))
    x = np.array([r["x"] for r in fit.points.orderBy("id").collect()]) / kmeans.SCALE
    labels = {k: np.array([c for _, c in rows_of(fit.labels(k), "product_code", "cluster")])
              for k in fit.fit.centres}
    values = {k: plain_silhouette(x, found) for k, found in labels.items()}
    k = max(values, key=values.get)
    return k, dict(zip(range(1, 121), labels[k].tolist())), values


@pytest.fixture
def few_cells(spark, sales, monkeypatch):
    """The queries on these products, with as few cells for them as many products would have."""
    products = products_frame(spark, PRODUCTS)
    monkeypatch.setattr(silhouette, "rate", lambda points, fit, *_: rate(points, fit, (8,)))
    monkeypatch.setattr(catalog, "_product_months", lambda *_: clusters.product_months(sales))
    monkeypatch.setattr(catalog, "_prepared", lambda *_: attach_hierarchy(sales, products))
    monkeypatch.setattr(catalog.fx, "supplier_products", lambda *_: products)
    return lambda name: catalog.QUERIES[name](spark, "")


def test_bounds_alone_would_choose_another_k(sales, plain):
    fit = clusters.fit_clusters(clusters.monthly_profiles(clusters.product_months(sales)))
    bounds = rate(fit.points, fit.fit, (8,))
    assert not silhouette.certain(bounds) and silhouette.best(bounds) != plain[0]


def test_clu4_chosen_k(few_cells, plain):
    assert [r["k"] for r in few_cells("clu4_chosen_k").collect()] == [plain[0]]


def test_pairs_are_the_plain_silhouette(sales, plain, monkeypatch):
    """Whatever the number of strips, and only for the k that bounds leave."""
    fit = clusters.fit_clusters(clusters.monthly_profiles(clusters.product_months(sales)))
    for strip in (1, 50, 1 << 20):
        monkeypatch.setattr(silhouette, "STRIP", strip)
        found = silhouette.pairs(fit.points, fit.fit, [3, 7, 8])
        assert sorted(found) == [3, 7, 8]
        for k, (low, high) in found.items():
            assert low == high == pytest.approx(plain[2][k], abs=1e-12)
    bounds = {3: (0.9, 0.95), 4: (0.1, 0.9), 5: (0.92, 0.99), 6: (0.2, 0.3), 7: (0.0, 0.1)}
    settled = silhouette.settled(fit.points, fit.fit, bounds)
    assert {k for k, (low, high) in settled.items() if low == high} == {3, 5, 8}
    assert {k: settled[k] for k in (4, 6, 7)} == {k: bounds[k] for k in (4, 6, 7)}


def test_certain_bounds_are_left_alone(sales):
    fit = clusters.fit_clusters(clusters.monthly_profiles(clusters.product_months(sales)))
    bounds = {k: (0.1, 0.2) for k in fit.fit.centres} | {5: (0.3, 0.4)}
    assert silhouette.settled(fit.points, fit.fit, bounds) is bounds


def test_ties_go_to_the_smallest_k():
    assert silhouette.best({5: (0.4, 0.4), 4: (0.4, 0.4)}) == 4
    assert silhouette.certain({5: (0.4, 0.4), 4: (0.4, 0.4)})
    assert not silhouette.certain({5: (0.4, 0.5), 4: (0.3, 0.4)})
    assert silhouette.certain({4: (0.4, 0.5), 5: (0.3, 0.4)})


def test_equal_profiles_and_missing_keys(spark):
    """Copies are at distance 0, also of a product without a code."""
    rows = [np.eye(12)[i % 5] for i in range(40)]
    profiles = profiles_of(spark, rows)
    profiles = profiles.unionByName(profiles.limit(1).selectExpr(
        "CAST(NULL AS BIGINT) AS product_code", *clusters.MONTHS))
    fit = clusters.fit_clusters(profiles)
    assert fit.best_k == 5 and fit.bounds[5] == (1.0, 1.0) and fit.labels().count() == 41


@pytest.mark.parametrize("largest", [3, 3_000_000, 1 << 29])
def test_pairs_of_any_integers(spark, largest):
    """Also of those whose squares doubles do not hold."""
    rows = np.random.default_rng(5).integers(-largest, largest, (60, 3), endpoint=True)
    points = spark.createDataFrame([(i, [int(v) for v in row]) for i, row in enumerate(rows)],
                                   "id long, x array<bigint>").cache()
    fit = kmeans.fit(points, range(3, 5), 10)
    for k, (low, _) in silhouette.pairs(points, fit, [3, 4]).items():
        labels = np.array([r["cluster"] for r in fit.labels(points, k).orderBy("id").collect()])
        assert low == pytest.approx(plain_silhouette(rows / kmeans.SCALE, labels), abs=1e-9)


@pytest.mark.parametrize("n, levels", [(0, ()), (1023, ()), (1024, (64,)), (60_000, (64, 512)),
                                       (1_000_000, (64, 512, 4096))])
def test_levels_are_less_work_than_pairs(n, levels):
    assert silhouette.worthwhile(n) == levels


def test_clu5_labels(few_cells, plain):
    assert dict(rows_of(few_cells("clu5_labels"), "product_code", "cluster")) == plain[1]


def test_clu6_table(few_cells, plain):
    rows = few_cells("clu6_table").collect()
    assert [r["product_code"] for r in rows] == [p for p, *_ in PRODUCTS]
    assert {r["product_code"]: r["cluster"] for r in rows} == plain[1]


def curves(spark, sales, labels):
    """Mean turnover of each cluster and month, from plain labels."""
    frame = spark.createDataFrame([*labels.items()], "product_code long, cluster int")
    return rows_of(catalog.tidy(clusters.cluster_profiles(frame, clusters.product_months(sales))),
                   "cluster", "month", "mean_turnover")


def test_clu7_fitted_profiles(spark, sales, few_cells, plain):
    assert rows_of(few_cells("clu7_fitted_profiles"), "cluster", "month", "mean_turnover") == \
        curves(spark, sales, plain[1])


def test_view_cluster_graph(spark, sales, few_cells, plain):
    assert rows_of(few_cells("view_cluster_graph"), "cluster", "month", "mean_turnover") == \
        curves(spark, sales, plain[1])
