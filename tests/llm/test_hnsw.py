"""Nearest neighbours: recall and scores beside brute force, ties, odd rows."""

import numpy as np
import pytest

from seasonwise.llm import hnsw
from seasonwise.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"
COLUMNS = "vec_id long, embedding array<float>, rank string"


def good(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute_force(rows, every=20, k=20):
    """query -> [(-score, vec_id)], nearest first."""
    rows = {i: np.array(v, dtype=np.float32).astype(np.float64) for i, v in rows
            if i is not None and good(v)}
    out = {}
    for q, u in rows.items():
        if q % every == 0:
            out[q] = sorted((-float(np.dot(u, v)), i) for i, v in rows.items()
                            if i != q and len(v) == len(u))[:k]
    return {q: found for q, found in out.items() if found}


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        found = out.setdefault(r.query_id, [])
        assert r.rank == len(found) + 1
        found.append((-r.score, r.vec_id))
    return out


def recall(got, want):
    return np.mean([len({i for _, i in got.get(q, [])} & {i for _, i in w}) / len(w)
                    for q, w in want.items()])


def check(got, want, rows):
    table = {i: np.array(v, dtype=np.float64) for i, v in rows if i is not None and good(v)}
    assert set(got) == set(want)
    for q, found in got.items():
        assert found == sorted(found) and len(found) == len(want[q]) and q not in dict(
            (i, s) for s, i in found)
        assert all(abs(-s - table[q] @ table[i]) < 1e-9 for s, i in found)
    return recall(got, want)


@pytest.mark.parametrize("shard", [64, 8192])
def test_vectors_of_different_norms_and_copies(spark, shard):
    rng = np.random.default_rng(2)
    points = rng.standard_normal((900, 24)) * rng.uniform(0.2, 2, (900, 1))
    points[100:160] = points[100]
    rows = [(i, [float(np.float32(x)) for x in p]) for i, p in enumerate(points)]
    table = spark.createDataFrame([(*r, "x") for r in rows], COLUMNS)
    index = hnsw.build_index(table, 20, shard=shard).cache()
    assert index.count() > (10 if shard == 64 else 5)
    got = answers(hnsw.search(index, table.filter("vec_id % 20 = 0"), 20))
    want = brute_force(rows)
    assert check(got, want, rows) >= 0.95
    assert got[120][:20] == want[120][:20]  # copies: ties to smaller ids


def test_small_and_odd_tables(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (3, [0.5, 0.5]), (4, None), (40, [0.0, 0.0]),
            (60, [nan, 1.0]), (5, [None, 1.0]), (6, []), (None, [1.0, 0.0]), (80, [1.0, 2.0, 3.0]),
            (7, [3.0, 0.0]), (8, [3.0, 0.0]), (8, [3.0, 0.0])]
    table = spark.createDataFrame([(*r, "x") for r in rows], COLUMNS)
    assert answers(hnsw.nearest(table)) == brute_force(rows)
    assert hnsw.nearest(spark.createDataFrame([], COLUMNS)).count() == 0
    assert hnsw.nearest(table.filter("vec_id = 0")).count() == 0


def test_whole_table(spark):
    table = [(r.vec_id, r.embedding) for r in
             spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    got = answers(QUERIES["op1_nearest_neighbours"](spark, SF_DIR))
    assert check(got, brute_force(table), table) >= 0.97
