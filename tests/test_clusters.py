import time

import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from seasonwise.operators import clusters, kmeans, silhouette
from tests.helpers import months, products_frame, rows_of, sales_frame

RNG = np.random.default_rng(2)
SHAPES = [np.sin(np.arange(12) / 12 * 2 * np.pi + shift) for shift in (0, 2, 4)]


def sales(spark, n=30):
    return sales_frame(spark, [
        (d, p, max(0, round(v))) for p in range(1, n + 1)
        for d, v in months(2021, 100 + 60 * SHAPES[p % 3] + RNG.normal(0, 4, 12))])


@pytest.fixture(scope="module")
def data(spark):
    return sales(spark).cache()


@pytest.fixture(scope="module")
def fit(data):
    return clusters.fit_clusters(clusters.monthly_profiles(clusters.product_months(data)))


def test_three_shapes_are_found(fit):
    assert fit.best_k == 3
    labels = dict(rows_of(fit.labels(), "product_code", "cluster"))
    assert set(labels) == set(range(1, 31)) and set(labels.values()) == {1, 2, 3}
    assert len({(p % 3, c) for p, c in labels.items()}) == 3
    assert labels[1] == 1 and labels[2] == 2  # numbered by smallest product code


def test_scores(fit):
    rows = fit.scores().collect()
    assert [r["k"] for r in rows] == list(range(3, 9))
    assert [r["k"] for r in rows if r["chosen"]] == [3]


def test_assignment_is_the_nearest_centre(fit, data):
    centres = np.array(fit.centres(5))
    scaled = {r["product_code"]: [r[m] for m in clusters.MONTHS] for r in
              clusters.standardised_profiles(clusters.monthly_profiles(
                  clusters.product_months(data))).collect()}
    for code, raw in rows_of(fit.raw_labels(5), "product_code", "raw"):
        distances = ((centres - scaled[code]) ** 2).sum(axis=1)
        assert distances[raw] == pytest.approx(distances.min(), abs=1e-5)


@pytest.mark.parametrize("partitions", [1, 7, 200])
def test_layout_does_not_matter(data, fit, partitions):
    shuffled = data.repartition(partitions, "date", "turnover_qty")
    profiles = clusters.monthly_profiles(clusters.product_months(shuffled))
    again = clusters.fit_clusters(profiles.repartition(partitions))
    assert (again.fit, again.best_k) == (fit.fit, fit.best_k)
    assert rows_of(again.all_labels(), "k", "product_code", "cluster") == \
        rows_of(fit.all_labels(), "k", "product_code", "cluster")


def test_standardised_profiles(spark):
    frame = sales_frame(spark, [(d, 1, v) for d, v in months(2021, range(12))]
                        + [(d, 2, 7) for d, _ in months(2021, range(12))]
                        + [("2020-03-01", 3, 6), ("2021-03-01", 3, 2)])
    profiles = clusters.monthly_profiles(clusters.product_months(frame))
    rows = {r["product_code"]: r for r in profiles.collect()}
    assert rows[3]["m3"] == 4.0 and rows[3]["m4"] == 0.0
    scaled = {r["product_code"]: [r[m] for m in clusters.MONTHS] for r in
              clusters.standardised_profiles(profiles).collect()}
    y = np.arange(12.0)
    assert scaled[1] == pytest.approx((y - y.mean()) / y.std())
    assert scaled[2] == [0.0] * 12


def test_tables(spark, data, fit):
    hierarchy = products_frame(spark, [(p, "c", f"g{p % 2}", f"s{p % 5}") for p in range(1, 31)])
    table = clusters.cluster_table(fit.labels(), hierarchy, 4).collect()
    assert [r["product_code"] for r in table] == [1, 2, 3, 4]
    members = clusters.cluster_members(fit.labels(), hierarchy, "group").collect()
    assert sum(r["n_products"] for r in members) == 30
    profiles = clusters.cluster_profiles(fit.labels(), clusters.product_months(data))
    assert profiles.count() == 36


def test_too_few_products(spark):
    fit = clusters.fit_clusters(clusters.monthly_profiles(clusters.product_months(sales(spark, 2))),
                                keep=True)
    assert [tuple(r) for r in fit.scores().collect()] == [(k, None, False) for k in range(3, 9)]
    assert rows_of(fit.labels(), "product_code", "cluster") == [(1, 1), (2, 1)]
    fit.release()


def profiles_of(spark, rows):
    schema = "product_code long, " + ", ".join(f"{m} double" for m in clusters.MONTHS)
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(rows)], schema)


def test_no_products(spark):
    fit = clusters.fit_clusters(profiles_of(spark, []))
    assert fit.best_k is None and fit.certain and fit.labels().count() == 0


def test_fewer_different_profiles_than_clusters(spark):
    """Only k up to the number of different profiles are fitted; equal ones stay together."""
    rows = [np.roll(range(12), i % 4) for i in range(20)]
    fit = clusters.fit_clusters(profiles_of(spark, rows))
    assert sorted(fit.fit.centres) == [3, 4] and fit.best_k == 4
    assert rows_of(fit.labels(), "product_code", "cluster") == [(i, i % 4 + 1) for i in range(20)]
    assert [r["k"] for r in fit.scores().collect() if r["silhouette"] is None] == [5, 6, 7, 8]


def plain_silhouette(points, labels):
    far = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
    values = []
    for i, own in enumerate(labels):
        mean = {c: far[i][labels == c].sum() / ((labels == c).sum() - (c == own))
                for c in set(labels) if c != own or (labels == c).sum() > 1}
        a, b = mean.get(own), min(v for c, v in mean.items() if c != own)
        values.append(0.0 if a is None or max(a, b) == 0 else (b - a) / max(a, b))
    return np.mean(values)


def fitted_points(spark, rows):
    frame = spark.createDataFrame([(i, [int(v) for v in row]) for i, row in enumerate(rows)],
                                  "id long, x array<bigint>").cache()
    return frame, kmeans.fit(frame, range(3, 7), 10)


@pytest.mark.parametrize("levels", [(8,), (64,), (4096,)])
def test_bounds_hold_the_plain_silhouette(spark, levels):
    rows = np.round(RNG.normal(0, 1, (150, 4)) * 1e6)
    points, fit = fitted_points(spark, rows)
    # Not more points than half a level would be exact at once.
    bounds = {k: b for k, b in silhouette.rate(points, fit, levels).items()}
    for k in fit.centres:
        labels = np.array([r["cluster"] for r in fit.labels(points, k).orderBy("id").collect()])
        exact = plain_silhouette(rows / 1e6, labels)
        low, high = bounds[k]
        assert low - 1e-9 <= exact <= high + 1e-9
        assert levels != (4096,) or high - low < 1e-6


def test_clear_clusters_are_told_by_few_cells(spark):
    """The best k is certain long before every point is a sub-centre."""
    homes = np.eye(5) * 50
    rows = np.round((homes[np.arange(3000) % 5] + RNG.normal(0, 1, (3000, 5))) * 1e6)
    points, fit = fitted_points(spark, rows)
    bounds = silhouette.rate(points, fit, (64, 512))
    assert silhouette.best(bounds) == 5 and silhouette.certain(bounds)
    labels = np.array([r["cluster"] for r in fit.labels(points, 5).orderBy("id").collect()])
    low, high = bounds[5]
    assert low <= plain_silhouette(rows / 1e6, labels) <= high < low + 0.2
    # Fewer sub-centres than asked for when their cells would be too many.
    assert silhouette.rate(points, fit, (64,), most_cells=3) == {}


def test_too_many_combinations_of_clusters_still_have_bounds(spark):
    """Many unlike points: cells of all k together are too many, those of each k are not."""
    rows = np.round(RNG.normal(0, 1, (400, 4)) * 1e6)
    points, fit = fitted_points(spark, rows)
    bounds = silhouette.rate(points, fit, (8, 16), most_cells=16 * 6)
    assert sorted(bounds) == sorted(fit.centres) == [3, 4, 5, 6]
    wide = silhouette.rate(points, fit, (8,), most_cells=8 * 6)
    for k, (low, high) in bounds.items():
        labels = np.array([r["cluster"] for r in fit.labels(points, k).orderBy("id").collect()])
        assert low - 1e-9 <= plain_silhouette(rows / 1e6, labels) <= high + 1e-9
        assert high - low < wide[k][1] - wide[k][0]


def test_many_points_meet_many_cells_fast(spark):
    """8,000 different points and some thousand cells, 12 dimensions."""
    points, fit = fitted_points(spark, np.round(RNG.normal(0, 1, (8000, 12)) * 1e6))
    start = time.perf_counter()
    bounds = silhouette.rate(points, fit, (512,))
    assert time.perf_counter() - start < 20
    assert sorted(bounds) == [3, 4, 5, 6] and all(low <= high for low, high in bounds.values())


@pytest.mark.parametrize("largest", [5, 3_000_000, 1 << 29])
def test_nearest_rows(largest):
    """Also of integers that doubles do not hold, and the first one on ties."""
    x, centres = (RNG.integers(-largest, largest, (n, 3), endpoint=True) for n in (700, 300))
    plain = [[sum((int(p) - int(q)) ** 2 for p, q in zip(a, b)) for b in centres] for a in x]
    assert silhouette.nearest_rows(x, centres).tolist() == [d.index(min(d)) for d in plain]


def test_best_and_certain():
    assert silhouette.best({}) is None and silhouette.certain({})
    assert silhouette.best({3: (0.1, 0.2), 4: (0.15, 0.15)}) == 3
    assert not silhouette.certain({3: (0.1, 0.2), 4: (0.15, 0.15)})
    assert silhouette.certain({3: (0.3, 0.4), 4: (0.1, 0.3)})


def test_silhouette_of_given_labels(spark, fit, data):
    """Closed form beside the library's evaluator."""
    scaled = clusters.standardised_profiles(clusters.monthly_profiles(clusters.product_months(data)))
    labels = fit.labels(5).withColumn("k", F.lit(5))
    got = clusters.silhouettes(scaled, labels).first()
    vectors = VectorAssembler(inputCols=clusters.MONTHS, outputCol="features").transform(scaled)
    rated = vectors.join(fit.labels(5).withColumn("prediction", F.col("cluster").cast("double")),
                         "product_code")
    assert got.k == 5 and got.silhouette == pytest.approx(ClusteringEvaluator().evaluate(rated))


def test_labels_do_not_read_the_facts_again(spark):
    """Once fitted, labels come from the written points."""
    made = clusters.monthly_profiles(clusters.product_months(sales(spark, 6)))
    labels = clusters.fit_clusters(made, range(3, 4)).labels()
    plan = labels._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Window" not in plan
    assert [r["product_code"] for r in labels.orderBy("product_code").collect()] == [*range(1, 7)]


def test_points_are_dealt_by_number(spark, monkeypatch):
    """However few cores were known when the fit began, a task holds a bounded number of points."""
    monkeypatch.setattr(clusters, "POINTS_PER_TASK", 2)
    made = clusters.monthly_profiles(clusters.product_months(sales(spark, 40)))
    fit = clusters.fit_clusters(made, range(3, 4), keep=True)
    assert fit.points.rdd.getNumPartitions() >= 20
    assert fit.labels().count() == 40
    fit.release()


@pytest.mark.parametrize("largest", [3, 3_000_000])
def test_passes_find_the_nearest_centres_as_labels_do(spark, largest):
    points = spark.createDataFrame(
        [(i, [int(v) for v in row]) for i, row in
         enumerate(RNG.integers(-largest, largest, (300, 3), endpoint=True))],
        "id long, x array<bigint>").repartition(5)
    centres = {k: [[int(v) for v in row] for row in
                   RNG.integers(-largest, largest, (k, 3), endpoint=True)] for k in (3, 4)}
    rows = kmeans.labelled(points, centres).withColumn("plain", F.array(*[
        kmeans.nearest("x", vectors) for vectors in centres.values()])).collect()
    assert len(rows) == 300 and all(r["ls"] == r["plain"] for r in rows)
    sums = kmeans._sums(points, centres)
    for at, k in enumerate(centres):
        for c in range(k):
            mine = [r["x"] for r in rows if r["ls"][at] == c]
            assert sums[k, c] == [len(mine), *(sum(x[j] for x in mine) for j in range(3))]


def test_distances_beyond_64_bits_are_refused():
    far = np.array([[1 << 31, 0], [-(1 << 31), 1]])
    with pytest.raises(OverflowError):
        silhouette.nearest_rows(far, far)


@pytest.mark.parametrize("points, cores", [(0, 8), (1000, 8), (60_000, 12), (360_000, 12), (5, 1)])
def test_tasks_fill_whole_rounds_of_all_cores(points, cores):
    parts = clusters.tasks(points, cores)
    assert parts % cores == 0 and points <= parts * clusters.POINTS_PER_TASK
    assert parts == cores or points > (parts - cores) * clusters.POINTS_PER_TASK


def test_labels_of_all_k_are_found_in_one_pass(spark, fit):
    labels = fit.all_labels()
    plan = labels._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("MapInArrow") == 1
    assert labels.dtypes == [("product_code", "bigint"), ("cluster", "int"), ("k", "int")]
    for k in fit.fit.centres:
        assert rows_of(labels.filter(F.col("k") == k), "product_code", "cluster") == \
            rows_of(fit.labels(k), "product_code", "cluster")
    assert labels.count() == 30 * len(fit.fit.centres)
