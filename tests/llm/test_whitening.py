"""Whitening beside a plain computation in whole numbers."""

import math
from collections import Counter

import numpy as np
import pytest

from seasonwise.llm import whitening
from seasonwise.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, x string, n int"


def expected(vectors, weights="one", components=16):
    """(vec_id, component): (n, deviation, |whitened|, explained) of (vec_id, vector) of one length."""
    grid = [(i, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)) for i, v in vectors]
    counts = Counter(x for _, x in grid)
    fit = [(x, 1 if weights == "one" else c) for x, c in counts.items()]
    n = sum(w for _, w in fit)
    sums = [sum(w * x[j] for x, w in fit) for j in range(len(fit[0][0]))]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x, _ in fit])
    w = np.array([w for _, w in fit], float)
    v = (centred * w[:, None]).T @ centred / n
    values, directions = np.linalg.eigh(v)
    values, directions = values[::-1], directions[:, ::-1]
    found = []
    for i, x in grid:
        gaps = [n * a - s for a, s in zip(x, sums)]
        for k in range(min(components, len(sums))):
            real = values[k] > values[0] * 1e-11
            place = (float(np.dot([g / n for g in gaps], directions[:, k])) / math.sqrt(values[k])
                     if real else None)
            found.append((i, k + 1, n, sum(g * g for g in gaps), place,
                          max(values[k], 0) / np.trace(v) if np.trace(v) > 0 else None))
    return found


def check(rows, want):
    def order(r):
        return tuple(-1 if v is None else v for v in (r[0], r[1], r[3]))
    got = sorted(((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained)
                  for r in rows), key=order)
    want = sorted(want, key=order)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    signs = {}
    for g, w in zip(got, want):
        assert (g[4] is None) == (w[4] is None) and (g[5] is None) == (w[5] is None)
        if w[4] is not None:
            assert abs(g[4]) == pytest.approx(abs(w[4]), rel=1e-6, abs=1e-7)
            if abs(w[4]) > 1e-6:
                signs.setdefault((w[1], w[2]), set()).add(math.copysign(1, g[4] * w[4]))
        if w[5] is not None:
            assert g[5] == pytest.approx(w[5], rel=1e-6, abs=1e-12)
    assert all(len(s) == 1 for s in signs.values())
    assert all(r.identity_error is None or r.identity_error < 1e-6 for r in rows)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)


def random_rows(n, length, seed=3):
    draw = np.random.default_rng(seed)
    return [(i, [float(np.float32(v)) for v in draw.normal(0, 1, length) * range(1, length + 1)])
            for i in range(n)]


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in
            spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    got = QUERIES["op11_whitening"](spark, SF_DIR).collect()
    check(got, expected(rows))
    assert len({r.identity_error for r in got}) == 1


@pytest.mark.parametrize("weights", ["one", "count"])
def test_repeats_bad_vectors_and_other_lengths(spark, weights):
    good = random_rows(40, 5)
    good += [(100 + i, good[0][1]) for i in range(30)] + [(3, good[3][1]), (None, good[4][1])]
    short = random_rows(9, 3, seed=8)
    bad = [(201, None), (202, []), (203, [1.0, None, 0.0, 0.0, 0.0]),
           (204, [float("nan")] * 5), (205, [1.0, float("inf"), 0.0, 0.0, 0.0])]
    rows = whitening.whiten(frame(spark, good + short + bad), weights=weights).collect()
    check([r for r in rows if r.n != 9], expected(good, weights))
    check([r for r in rows if r.n == 9], expected(short, weights))


def test_fewer_components_than_asked_and_dependent_dimensions(spark):
    rows = [(i, [v[0], v[0], 2.0, v[1]]) for i, v in random_rows(30, 2)]
    found = whitening.whiten(frame(spark, rows)).collect()
    check(found, expected(rows))
    assert {r.component for r in found} == {1, 2, 3, 4}
    assert {r.component for r in found if r.whitened is None} == {3, 4}


def test_one_distinct_vector(spark):
    rows = [(i, [0.0, 0.0]) for i in range(3)]
    found = whitening.whiten(frame(spark, rows)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in found] == [
        (1, 0, None, None, None)] * 6


def test_wide_numbers(spark):
    """Deviations are exact as long as they are longs; beyond that they are null."""
    rows = [(i, [v * 2.0 ** 18 for v in x]) for i, x in random_rows(20, 4)]
    check(whitening.whiten(frame(spark, rows)).collect(), expected(rows))
    far = [(0, [1e30, 0.0]), (1, [-1e30, 0.5]), (2, [0.0, -0.5])]
    found = whitening.whiten(frame(spark, far)).collect()
    assert len(found) == 6 and all(r.deviation is None for r in found if r.vec_id < 2)


def test_shared_vectors_are_spread(spark):
    """A vector of most rows takes the salted way of the join back."""
    good = random_rows(25, 3)
    rows = good + [(1000 + i, good[0][1]) for i in range(3000)]
    check(whitening.whiten(frame(spark, rows)).collect(), expected(rows))


def test_empty_table(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None)])).count() == 0


def test_unknown_weights(spark):
    with pytest.raises(ValueError):
        whitening.whiten(frame(spark, []), weights="half")
