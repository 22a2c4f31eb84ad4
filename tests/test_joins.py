import pytest

from seasonwise.functions.joins import checked_join, salted_join, salts_for
from tests.helpers import rows_of


@pytest.fixture(scope="module")
def frames(spark):
    # Key 0 holds most rows; key 9 has no partner and key 7 no rows.
    large = spark.range(1000).selectExpr("CASE WHEN id < 900 THEN 0 ELSE id % 10 END AS k",
                                         "id AS v")
    small = spark.createDataFrame([(k, f"n{k}") for k in (0, 1, 2, 3, 4, 5, 6, 8, 77)],
                                  "k bigint, name string")
    return large, small


@pytest.mark.parametrize("how", ["inner", "left"])
def test_same_rows_as_a_plain_join(frames, how):
    large, small = frames
    def rows(df):
        return sorted((tuple(r) for r in df.select("k", "v", "name").collect()), key=str)
    wanted = rows(large.join(small, "k", how))
    assert rows(salted_join(large, small, ["k"], ["v"], how)) == wanted
    for limit in (0, 1 << 20):
        assert rows(checked_join(large, small, ["k"], ["v"], how, broadcast_bytes=limit)) == wanted


def test_hot_key_is_spread(spark, frames):
    large, small = frames
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        joined = salted_join(large, small, ["k"], ["v"]).filter("k = 0")
        sizes = joined.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) > 2 and max(r["count"] for r in sizes) < 900


def test_broadcast_depends_on_the_size(spark, frames):
    large = frames[0]
    small = spark.range(9).selectExpr("id AS k", "id * 2 AS name")
    def plan(limit):
        joined = checked_join(large, small, ["k"], ["v"], broadcast_bytes=limit)
        return joined._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(1 << 20) and "broadcast" not in plan(3)


def test_shares_follow_the_cluster(spark, frames):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "10000")
        assert salts_for(frames[0]) == 100
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_nothing_runs_while_a_join_is_planned(spark, frames):
    fails = spark.range(10).selectExpr("id AS k", "assert_true(id < 0) AS name")
    checked_join(frames[0], fails, ["k"], ["v"])


def test_other_join_types_are_refused(frames):
    with pytest.raises(ValueError):
        salted_join(*frames, ["k"], ["v"], "right")


def test_rows_are_whole(frames):
    large, small = frames
    assert len(rows_of(salted_join(large, small, ["k"], ["v"], "left"), "v")) == 1000
