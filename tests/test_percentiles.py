import numpy as np
import pytest

from seasonwise.functions.percentiles import exact_percentiles

PERCENTS = {"low": 33, "mid": 50, "high": 75, "top": 100, "first": 0, "odd": 66}


def check(spark, groups, accuracy):
    rows = [(k, float(v)) for k, values in groups.items() for v in values]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r["k"]: r for r in
           exact_percentiles(frame, ["k"], "v", PERCENTS, accuracy).collect()}
    assert set(got) == set(groups)
    for key, values in groups.items():
        for name, percent in PERCENTS.items():
            assert got[key][name] == pytest.approx(np.percentile(values, percent), rel=1e-12)


@pytest.mark.parametrize("accuracy", [50, 200, 10_000])
def test_against_numpy(spark, accuracy):
    rng = np.random.default_rng(7)
    check(spark, {
        # One group holds most of all values; the sketch must bracket it, not hold it.
        "hot": rng.lognormal(size=20_000),
        "few distinct": rng.integers(0, 4, 3_000),
        "one value": np.full(1_500, 2.5),
        "mostly one value": np.r_[np.zeros(2_000), rng.normal(size=40)],
        "far apart": 10.0 ** rng.uniform(-300, 300, 2_000),
        "tiny": [3.0, 1.0],
        "single": [9.0],
        "odd": rng.normal(size=1_001),
    }, accuracy)


def test_nulls_are_left_out(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", None)],
                                  "k string, v double")
    assert [tuple(r) for r in
            exact_percentiles(frame, ["k"], "v", {"p": 50}).collect()] == [("a", 2.0)]
