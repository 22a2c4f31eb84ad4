"""Shape of the plans: what is scanned, shuffled and joined."""

import re

import pytest

from seasonwise.plans.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"
# These fit models while the query is built.
EAGER = ("clu3_fit", "clu3_sil", "clu4_chosen", "clu5_all", "clu5_fit", "clu5_labels", "clu6_table",
         "clu7_fit", "clu8_fit", "clu9_fit", "view_cluster")


def initial(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final(df) -> str:
    df.collect()
    return initial(df).split("== Initial Plan ==")[0]


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(EAGER)))
def test_no_cross_joins_and_no_python_workers(spark, name):
    plan = initial(QUERIES[name](spark, SF_DIR))
    assert not re.search("CartesianProduct|NestedLoop|Python|Pandas", plan)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(EAGER)))
def test_windows_and_sorts_are_partitioned(spark, name):
    """A single partition is only for one-row aggregates, the sum of a whole selection, and counts
    of blocks when a whole table is numbered."""
    single = initial(QUERIES[name](spark, SF_DIR)).count("Exchange SinglePartition")
    assert single == 0 or name.startswith(
        ("sel6", "sel2_wanted", "view_", "clu4", "clu5", "clu6"))


def test_year_reaches_the_scan_and_columns_are_pruned(spark):
    plan = final(QUERIES["xyz2_variation"](spark, SF_DIR))
    scan = next(line for line in plan.splitlines() if "l_suppkey" in line and "FileScan" in line)
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in scan
    assert set(re.findall(r"(l_\w+)#", scan.split("Batched")[0])) == {
        "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate"}


@pytest.mark.parametrize("name", ["xyz4_class", "cor3_parent_model", "sea2_threshold",
                                  "mod14_fitted_series", "sea9_extreme_days", "prm_group_months",
                                  "sel3_ranges", "mod_any_span_fitted"])
def test_facts_are_read_once(spark, name):
    plan = final(QUERIES[name](spark, SF_DIR))
    assert len(re.findall(r"FileScan parquet \[[^\]]*l_", plan)) == 1


@pytest.mark.parametrize("name", ["ts4_all_levels", "prm_months", "clu1_profiles", "sea1_coefficients"])
def test_facts_are_summed_before_their_shuffle(spark, name):
    plan = optimized(QUERIES[name](spark, SF_DIR))
    # Nothing but projections and filters between the scan of the facts and the first sum.
    lines = [line for line in plan.splitlines() if line.strip(" :+-")]
    scan = next(i for i, line in enumerate(lines) if re.search(r"Relation \[.*l_orderkey", line))
    above = [re.sub(r"^[ :+-]*", "", line).split()[0] for line in lines[:scan]]
    while above and above[-1] in ("Project", "Filter"):
        above.pop()
    assert above[-1] == "Aggregate"


def test_models_add_no_shuffle_to_the_series(spark):
    series = initial(QUERIES["ts5_model_window"](spark, SF_DIR)).count("Exchange hash")
    for name in ("mod9_fitted", "mod10_metrics", "mod11_best", "mod14_fitted_series",
                 "mod17_chart"):
        assert initial(QUERIES[name](spark, SF_DIR)).count("Exchange hash") == series


def test_facts_are_not_shuffled_for_a_small_dimension(spark):
    plan = initial(QUERIES["prm3_neutralised"](spark, SF_DIR))
    facts = plan[plan.index("BroadcastHashJoin"):].split("BroadcastExchange")[0]
    assert "Exchange hash" not in facts and "l_partkey" in facts
