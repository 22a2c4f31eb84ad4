"""Language: held-out accuracy, code properties, odd rows."""

import zlib

import numpy as np
import pytest

from seasonwise.llm import language
from seasonwise.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 9, 20])
def test_codewords_are_apart(n):
    code = language.codewords(n)
    assert code.shape[0] == n and set(np.unique(code)) <= {1, -1}
    assert all((code[i] != code[j]).sum() >= (1 if n < 3 else 2)
               for i in range(n) for j in range(i))


def test_long_texts_are_read_to_the_end(monkeypatch):
    text = "abc déf " * 5000
    whole = language.features(text)
    monkeypatch.setattr(language, "_CHUNK", 1000)
    assert abs(whole - language.features(text)).max() < 0.02
    assert abs(language.features("a" * 50_000 + "zzz " * 50_000)
               - language.features("a" * 50_000)).max() > 0.1


def test_a_wrong_bit_is_corrected():
    rng = np.random.default_rng(1)
    centres = rng.random((4, 64))
    labels = rng.integers(0, 4, 400)
    x = centres[labels] + 0.1 * rng.random((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = language.train(x, [f"l{k}" for k in labels])
    assert model.code.shape == (4, 7)
    assert (model.losses(x).argmin(axis=1) == labels).mean() > 0.99
    model.bias[2] += 100  # one classifier always says yes
    model.trust[2] = 0.01
    assert (model.losses(x).argmin(axis=1) == labels).mean() > 0.95


def test_odd_rows(spark):
    texts = ["the cat and the dog went home", "der Hund und die Katze gehen heim"] * 40
    rows = [(i, t, "en" if i % 2 == 0 else "de", "x") for i, t in enumerate(texts)]
    rows += [(100, None, "en", ""), (101, "", None, ""), (102, "12 !? 3", "de", ""),
             (None, "the dog", "en", ""), (0, texts[0], None, ""), (103, "the dog " * 40_000, None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = language.predict(docs, language.fit(docs)).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert found[100] == found[101] == found[102] == ("und", 0.0)
    assert found[103][0] == "en" and found[1][0] == "de"
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
               for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    empty = docs.limit(0)
    assert language.predict(empty, language.fit(empty)).count() == 0
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = QUERIES["op4_language"](spark, SF_DIR).collect()
    assert {r.doc_id for r in rows} == set(lang)
    unseen = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == lang[r.doc_id] for r in unseen)
    print(right, len(unseen), [(r, lang[r.doc_id]) for r in unseen if r.lang_pred != lang[r.doc_id]])
    assert right >= 0.98 * len(unseen)
