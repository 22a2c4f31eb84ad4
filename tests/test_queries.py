"""Every registered query beside its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# No subgroup has two products at this size.
EMPTY = {"xyz10_applicable", "view_xyz_table", "view_xyz_graph", "view_cluster_table_products", "view_cluster_table", "view_cluster_graph",
         "view_cluster_graph_months", "op6_secrets"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    found = compare(spark, duck, SF_DIR, entry.queries()[name], entry.oracle_sql().get(name))
    assert found == "" or (found == "no rows" and name in EMPTY)
