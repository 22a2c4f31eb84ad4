"""Packing: ids beside the library, exact cover, little padding."""

import array
import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from seasonwise.llm import packing
from seasonwise.llm.common import tokenizer_path
from seasonwise.llm.queries import QUERIES
from seasonwise.llm.units import ByteBpe

SF_DIR = "/root/testdata/sf0.01"
TEXTS = [None, "", " ", "  two  spaces ", "a\n\n b\t c\r\n", "\x1c a\x85 b\xa0 c　 d", "x" * 9000,
         "it's we'LL 12½ ²3", "日本 語 👍🏽", "end<|endoftext|> of", "É é ß\xad ×÷", "trail \n",
         "a  ", "\n\n", "ﬁ ǅ ÀÖØ", "word " * 5000, "   x", "can't 've", "  lead"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, ids, window):
    """Every id once, crc of every piece, gapless windows. Returns the share of padding."""
    cover, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id][r.start:r.start + r.length]
        assert len(own) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(array.array("I", own).tobytes())
        cover[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    for i, pieces in cover.items():
        assert [p[0] for p in sorted(pieces)] == [
            0, *itertools.accumulate(n for _, n in sorted(pieces)[:-1])] and sum(
            n for _, n in pieces) == len(ids[i])
    assert set(cover) == set(ids)
    for pieces in windows.values():
        ends = list(itertools.accumulate(n for _, n in sorted(pieces)))
        assert [p[0] for p in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= window
    return 1 - sum(map(len, ids.values())) / (len(windows) * window)


def test_ids_are_the_librarys(library):
    bpe = ByteBpe("byte_bpe_50k.json", max_units=10)
    for text in TEXTS:
        assert list(array.array("I", bpe.ids(text or ""))) == ids_of(library, text)[:-1], text


def test_odd_texts(spark, library):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)],
                                 "doc_id long, text string, length string")
    rows = packing.pack(docs, window=64).collect()
    assert check(rows, {i: ids_of(library, t) for i, t in enumerate(TEXTS)}, 64) < 0.2


def test_repeated_rows_and_missing_ids(spark):
    docs = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "same text"),
                                  (None, None)], "doc_id long, text string")
    rows = packing.pack(docs).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 1), (0, 3), (1, 3), (1, 3)]
    assert sorted(r.offset for r in rows) != [0, 0, 0, 0]


def test_real_ids_come_along(spark, library):
    docs = spark.createDataFrame([(1, "hello big world")], "doc_id long, text string")
    row = packing.pack(docs, with_ids=True).first()
    assert list(array.array("I", row.ids)) == ids_of(library, "hello big world")


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_least_squares_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random((5, 7)), rng.random(5) * 10
        x = packing.non_negative_least_squares(a, b)
        gradient = a.T @ (a @ x - b)
        assert x.min() >= 0 and gradient.min() > -1e-6 and abs(gradient[x > 0]).max() < 1e-6


def test_a_plan_uses_every_piece_once():
    rng = np.random.default_rng(2)
    histogram = {int(s): int(n) for s, n in zip(range(1, 257), rng.integers(0, 2000, 256))}
    used, room = defaultdict(int), 0
    for parts, times in packing.plan(histogram, 256):
        assert sum(parts) <= 256
        room += (256 - sum(parts)) * times
        for p in parts:
            used[p] += times
    assert used == {s: n for s, n in histogram.items() if n}
    assert room < 0.05 * sum(s * n for s, n in histogram.items())


def test_whole_table(spark, library):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    rows = QUERIES["op8_packing"](spark, SF_DIR).collect()
    share = check(rows, {r.doc_id: ids_of(library, r.text) for r in docs}, 2048)
    print("padding", share)
    assert share < 0.02
