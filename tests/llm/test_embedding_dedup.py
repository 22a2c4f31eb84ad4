"""Embedding near-duplicates beside brute force over all pairs."""

import numpy as np
import pytest

from seasonwise.llm import embedding_dedup
from seasonwise.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"
COLUMNS = "vec_id long, embedding array<float>, label int, rep string"


def brute_force(rows, least=0.98):
    """(vec_id, n_links, component_id, kept) sorted."""
    good = [k for k, (i, v, label) in enumerate(rows) if i is not None and label is not None
            and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent = list(range(len(rows)))
    links = [0] * len(rows)

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    units = {k: np.array(rows[k][1], dtype=np.float32).astype(np.float64) for k in good}
    units = {k: u / np.linalg.norm(u) for k, u in units.items()}
    for n, a in enumerate(good):
        for b in good[:n]:
            if rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) \
                    and units[a] @ units[b] >= least:
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                if x != y:
                    parent[x] = y
    low = {}
    for k in good:
        low[root(k)] = min(low.get(root(k), rows[k][0]), rows[k][0])
    out = []
    for k, (i, _, _) in enumerate(rows):
        component = low.get(root(k), i) if k in units else i
        out.append((i, links[k], component, i is None or i == component))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def family(rng, centre, n, noise):
    return [centre + noise * rng.standard_normal(len(centre)) for _ in range(n)]


@pytest.mark.parametrize("leaf, block", [(1024, 2048), (16, 2048), (16, 8)])
def test_families_in_many_leaves(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(4)
    points = list(rng.standard_normal((250, 16)))
    for k in range(12):
        points += family(rng, points[k], 12, 0.09 + 0.02 * k / 12)
    points += [points[0]] * 30
    rows = [(int(i), [float(np.float32(x)) for x in p], int(i % 2)) for i, p in
            zip(rng.permutation(len(points)) * 3, points)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(
        [(*r, "x") for r in rows], COLUMNS), leaf=leaf)
    assert result(got) == brute_force(rows)


def test_vectors_longer_than_any_of_the_sample(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SAMPLE", 40)
    rng = np.random.default_rng(6)
    points = [rng.standard_normal(8) for _ in range(160)] + [rng.standard_normal(3)
                                                             for _ in range(30)]
    points += family(rng, points[0], 5, 0.02) + family(rng, points[-1], 5, 0.02)
    points += [rng.standard_normal(40)] * 2 + [rng.standard_normal(41)]
    rows = [(i, [float(np.float32(x)) for x in p], 1) for i, p in enumerate(points)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(
        [(*r, "x") for r in rows], COLUMNS), leaf=8)
    assert result(got) == brute_force(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None),
            (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [None, 1.0], 1),
            (9, [inf, 1.0], 1), (10, [], 1), (2, [2.0, 0.0], 1), (None, [1.0, 0.0], 1),
            (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.25], 1), (13, [1e-30, 0.0], 1)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(
        [(*r, "x") for r in rows], COLUMNS))
    assert result(got) == brute_force(rows)


def test_empty_table(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], COLUMNS)).count() == 0


def test_whole_table_in_small_leaves(spark):
    """Every label has trees."""
    frame = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in frame.collect()]
    assert result(embedding_dedup.near_duplicates(frame, leaf=8)) == brute_force(rows)


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    got = result(QUERIES["op7_embedding_dedup"](spark, SF_DIR))
    assert got == brute_force([(r.vec_id, r.embedding, r.label) for r in table])
