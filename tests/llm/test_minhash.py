"""Near duplicates beside brute force over all pairs of word shingle sets."""

import random
import re

import numpy as np
import pytest

from seasonwise.llm import minhash
from seasonwise.llm.components import components
from seasonwise.llm.queries import QUERIES
from seasonwise.llm.shingles import Sketcher, shingle_set, word_hashes

SF_DIR = "/root/testdata/sf0.01"


def shingles(text, width):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", lower) if w]
    if not words:
        return frozenset()
    run = min(width, len(words))
    return frozenset(tuple(words[k:k + run]) for k in range(len(words) - run + 1))


def brute_force(docs, width, percent):
    """doc_id -> (set size, component) by an index of shingles."""
    sets = {i: shingles(t, width) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_shingle = {}
    for i, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    shared = {}
    for ids in by_shingle.values():
        for n, i in enumerate(ids):
            for j in ids[:n]:
                shared[i, j] = shared.get((i, j), 0) + 1
    for (i, j), both in shared.items():
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in docs}


def result(df):
    rows = df.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows if r.doc_id is not None)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def test_words_across_chunks(monkeypatch):
    from seasonwise.llm import shingles as module
    text = b"one  two\tthree " + b"x" * 100 + b" four\n" * 30
    whole = word_hashes(text)
    monkeypatch.setattr(module, "CHUNK", 7)
    assert (word_hashes(text) == whole).all() and len(whole) == 34


@pytest.mark.parametrize("width", [1, 4, 5])
def test_set_sizes(width):
    for text in (None, "", " \n", "One", "one TWO three", "É É é É", "a b a b a b a", "x\x0by\x0cz"):
        assert len(shingle_set(text, width)) == len(shingles(text, width))


def test_samples_agree_as_often_as_sets():
    rng, sketcher = np.random.default_rng(1), Sketcher(100, 4, 256)
    common = rng.integers(0, 2**63, 800, dtype=np.uint64)
    a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, 100, dtype=np.uint64)]))
            for _ in range(2))
    same = (sketcher.minima(a) == sketcher.minima(b)).mean()
    assert abs(same - 0.8) < 0.08


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 700)] + [
        (7, 7), (3, 2), (2, 3)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 500 for k in range(500, 700)},
                   2: 2, 3: 2}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_group_whose_members_link_only_in_part(spark):
    """Chains of edits, copies, borderline pairs, odd rows."""
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(2000)]
    docs = {}
    for family in range(12):
        words = rng.choices(vocabulary, k=rng.randint(30, 200))
        for _ in range(25):
            words = list(words)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            docs[len(docs) * 3 + 5] = " ".join(words)
    docs |= {1: None, 2: "", 3: " \t ", 4: "two words", 6: "TWO  Words", 7: "x " * 30_000}
    rows = [(i, t, "extra") for i, t in docs.items()] + [(4, "two words", "again"),
                                                         (None, "two words", "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, component string")
    got = minhash.near_duplicates(frame, width=4).collect()
    assert len(got) == len(rows)
    unknown = [r for r in got if r.doc_id is None]
    assert [(r.component_id, r.kept) for r in unknown] == [(None, True)]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == \
        brute_force(docs, 4, 80)


def test_large_bands_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(100)]
    docs = {}
    for i in range(60):
        changed = list(words)
        for k in rng.sample(range(100), 2):
            changed[k] = f"x{i}-{k}"
        docs[i] = " ".join(changed)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert result(minhash.near_duplicates(frame, width=4)) == brute_force(docs, 4, 80)


def test_empty_table(spark):
    assert minhash.near_duplicates(
        spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert result(QUERIES["op2_minhash_dedup"](spark, SF_DIR)) == brute_force(docs, 4, 80)
