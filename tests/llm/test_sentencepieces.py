"""Pieces beside the library with the same vocabulary in its unigram mode."""

import zlib

import numpy as np
import pytest
import sentencepiece

from seasonwise.llm import sentencepieces as sp
from seasonwise.llm.common import tokenizer_path
from seasonwise.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"
FILE = "piece_bpe_32k.model"
TEXTS = ["", " ", "a", " a", "a ", "  two   spaces  ", "line\nbreak\ttab", "日本語 テスト 👍🏽",
         "ñandú \x00 zero", "▁mark ▁▁ here", "word " * 3000, "x" * 5000, "ÿ\U0010ffff", "été 12,5 %"]


@pytest.fixture(scope="module")
def library():
    from sentencepiece import sentencepiece_model_pb2
    model = sentencepiece_model_pb2.ModelProto()
    with open(tokenizer_path(FILE), "rb") as handle:
        model.ParseFromString(handle.read())
    model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


@pytest.fixture(scope="module")
def pieces():
    return sp.Pieces(FILE)


def test_trie_holds_every_piece_and_no_other():
    entries = {w.encode(): k for k, w in enumerate(["a", "ab", "abc", "b", "é", "▁a", "▁"])}
    trie = sp.DoubleArray(entries)

    def find(word):
        state = 0
        for byte in word:
            step = trie.base[state] + byte
            if trie.check[step] != state:
                return None
            state = step
        leaf = trie.base[state]
        return -1 - trie.base[leaf] if trie.check[leaf] == state else None

    assert all(find(w) == k for w, k in entries.items())
    assert all(find(w) is None for w in (b"", b"ac", b"abcd", b"\xc3", b"z", b"\xff"))


def test_best_path_by_brute_force(pieces):
    codec = sp.Codec(pieces)
    names = {}
    for i, score in pieces.scores.items():
        names.setdefault(pieces.surface[i].replace(b" ", "▁".encode()), score)

    def best(data):
        if not data:
            return 0.0
        found = [names[data[:n]] + rest for n in range(1, len(data) + 1) if data[:n] in names
                 for rest in [best(data[n:])] if rest is not None]
        return max(found, default=None)

    for word in ("hello", "▁theand", "naïve", "▁überall", "reheed"):
        assert codec.best_path(word)[1] == best(word.encode())


@pytest.mark.parametrize("text", TEXTS)
def test_same_pieces_as_the_library(pieces, library, text):
    data, _ = sp.Codec(pieces, max_words=20).encode(text)
    assert np.frombuffer(data, "<u4").tolist() == library.encode(text)


def test_real_outputs_and_odd_rows(spark):
    docs = spark.createDataFrame(
        [(i, t, "x") for i, t in enumerate([*TEXTS, None])] + [(2, "a", "again"), (None, "b", "")],
        "doc_id long, text string, ids string")
    encoded = sp.encode(docs)
    texts = sorted((r.doc_id if r.doc_id is not None else -1, r.text)
                   for r in sp.decode(encoded).collect())
    assert texts == sorted((i if i is not None else -1, (t or "").replace("▁", " "))
                           for i, t, _ in docs.collect())
    digest = {r.doc_id: r for r in sp.digests(docs).collect()}
    for r in encoded.filter("doc_id < 14").collect():
        assert digest[r.doc_id].n_pieces == len(r.ids) and digest[r.doc_id].score == r.score
        assert digest[r.doc_id].ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert sp.digests(docs.limit(0)).count() == 0


def test_whole_table(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = QUERIES["op10_sentencepieces"](spark, SF_DIR).collect()
    assert {r.doc_id for r in rows} == set(docs)
    # The library's own search stops short of the best sum for some words; never the reverse.
    codec = sp.Codec(sp.Pieces(FILE))
    for r in rows:
        assert r.round_trip and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode())
    for word in {w for t in list(docs.values())[:60] for w in t.split(" ") if w}:
        theirs = sum(codec.pieces.scores.get(i, 0.0) for i in library.encode(word))
        ours = np.frombuffer(codec.encode(word)[0], "<u4").tolist()
        assert sum(codec.pieces.scores.get(i, 0.0) for i in ours) >= theirs
