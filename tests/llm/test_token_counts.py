"""Token counts beside the library on whole texts."""

import pytest
from tokenizers import Tokenizer

from seasonwise.llm.common import tokenizer_path
from seasonwise.llm.queries import QUERIES
from seasonwise.llm.token_counts import token_counts

SF_DIR = "/root/testdata/sf0.01"
TEXTS = [None, "", " ", "Hello,  World!", "it's DON'T 12½", "a\x1cb c\x1d", "x y　z",
         "ΣΟΦΟΣ İstanbul ﬁne é", "日本語 テスト 👍🏽", "<|endoftext|>a<|startoftext|> b",
         "<|ENDOFTEXT|>", "w" * 20_000, "\x85  x", "É ẹ́ Å", "ǅ ß ẞ \xad-"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def expected(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("head", [0, 5, 1000])
def test_odd_texts(spark, library, head):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again"),
                                                             (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit)
                 for r in token_counts(docs, limit=3, head=head).collect())
    want = sorted((i if i is not None else -1, len((t or "").encode()), n, n > 3)
                  for i, t, _ in rows for n in [expected(library, t)])
    assert got == want


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in QUERIES["op9_token_counts"](spark, SF_DIR).collect()}
    assert got == {i: expected(library, t) for i, t in docs.items()}


def test_rare_words_leave_a_task_in_the_row_of_their_document(spark, library):
    """Of all documents, tasks give one row each; words are told apart by Spark."""
    texts = ["Alpha beta, beta gamma", "delta-delta x", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counted = token_counts(docs, head=0)
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(rare" in plan
    assert {r.doc_id: r.n_tokens for r in counted.collect()} == \
        {i: expected(library, t) for i, t in enumerate(texts)}


def test_pre_tokens_are_given_in_batches():
    from collections import Counter

    from seasonwise.llm.token_counts import GIVEN_ROWS, _pre_tokens
    from seasonwise.llm.units import PreTokens
    units = Counter({f"w{chr(97 + i % 26)}{i}": 2 for i in range(GIVEN_ROWS)}) + Counter(["Ab", "ab"])
    given = list(_pre_tokens(PreTokens("word_bpe_49k.json"), units))
    assert not units and all(len(names) == len(ns) <= GIVEN_ROWS for names, ns in given)
    totals = {w: n for names, ns in given for w, n in zip(names, ns)}
    assert totals["ab"] == 2 and totals["wa"] == 2 * len(range(0, GIVEN_ROWS, 26))
