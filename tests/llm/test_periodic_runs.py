"""Periodic runs beside trying every period at every place."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from seasonwise.llm.periodic_runs import find_runs, runs_of
from seasonwise.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"
TEXTS = [None, "", " \t\n\x0b\x0c\r ", "a", "a a a a a", "a a a a a a", "x" * 50_000, "a b " * 30,
         "a\x0ba\x0ca\ra\na a", "a\u00a0a a\u2003a a a a", "b a a a a a a a c a a a a a a d",
         "a b a b a b a b a b b a b b a b b a b b a b b",
         "a a a a a a b a a a a a a b a a a a a a b a a a a a a b", "é " * 7, "a\x1ca " * 9]


def brute(words, least_words=6, least_repeats=4):
    letters = np.unique(np.array(words, object).astype(str), return_inverse=True)[1] \
        if words else np.array([], int)
    found = []
    for q in range(1, len(words) // least_repeats + 1):
        same = np.concatenate([[False], letters[q:] == letters[:-q], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for start, end in zip(edges[::2], edges[1::2]):
            length = int(end - start + q)
            stretch = letters[start:start + length]
            if length >= max(least_words, least_repeats * q) and not any(
                    (stretch[d:] == stretch[:-d]).all() for d in range(1, q)):
                found.append((int(start), length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_random_words_in_batches():
    draw = random.Random(1)
    for _ in range(600):
        docs = []
        for _ in range(draw.randint(1, 6)):
            letters = draw.choice([1, 2, 3])
            words = [bytes([97 + draw.randrange(letters)])
                     for _ in range(draw.choice([0, 1, 3, 7, 20, 60]))]
            if words and draw.random() < 0.5:
                words += words[-draw.randint(1, 6):] * draw.randint(1, 6) + words[:3]
            docs.append(words)
        for least_words, least_repeats in ((6, 4), (2, 2), (3, 4), (1, 3)):
            assert runs_of(docs, least_words, least_repeats) == [
                brute(words, least_words, least_repeats) for words in docs]


def test_long_documents():
    words = [b"a", b"b", b"c"] * 30_000
    assert runs_of([words, [b"a"] * 50_000]) == [[(0, 90_000, 3)], [(0, 50_000, 1)]]
    phrase = [b"p%d" % i for i in range(9)]
    assert runs_of([[w for i in range(5_000) for w in (*phrase, b"%d" % (i * i % 97))]]) == [[
        (0, 50_000, 970)]]


def test_odd_texts(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[7], "again"),
                                                             (None, TEXTS[5], "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words,
                  [tuple(x) for x in r.runs], r.collapsed) for r in find_runs(docs).collect())
    want = []
    for i, t, _ in rows:
        words = split(t)
        runs = brute(words)
        want.append((-1 if i is None else i, len(words), runs, collapsed(words, runs)))
    assert got == sorted(want)
    assert any(len(w[2]) > 1 for w in want)


def test_empty_table(spark):
    assert find_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_period_must_repeat(spark):
    with pytest.raises(ValueError):
        find_runs(spark.createDataFrame([], "doc_id long, text string"), least_repeats=1)


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, SF_DIR).collect()}
    assert set(got) == set(docs)
    for doc_id, text in docs.items():
        words, h = split(text), zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        row = got[doc_id]
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == hashlib.sha256(
            "".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
