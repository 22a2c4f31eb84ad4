"""Pseudo-likelihood: exact sums, gradients, and that the network learns."""

import random
from collections import Counter

import numpy as np
import pytest

from seasonwise.llm import pseudo_likelihood as pl
from seasonwise.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"


def one_by_one(network, ids):
    """The plain formula, token by token; also the sum of all probabilities of each token."""
    padded = [pl.PAD] * 2 + list(ids) + [pl.PAD] * 2
    out = []
    for k, target in enumerate(ids):
        x = np.concatenate([network.embed[padded[k + 2 + s]] for s in pl.SIDES]).astype(np.float64)
        hidden = np.tanh(x @ network.into + network.bias)
        group = np.exp(hidden @ network.group + network.group_bias)
        every = np.concatenate([
            (group[g] / group.sum()) * (e / e.sum()) for g in range(pl.GROUPS)
            for e in [np.exp(hidden @ network.within[g] + network.within_bias[g])]])
        assert abs(every.sum() - 1) < 1e-9
        out.append(np.log(every[target]))
    return np.array(out)


def test_sums_are_exact():
    rng, network = np.random.default_rng(1), pl.Network.fresh()
    ids = rng.integers(0, pl.SIZE, 100)
    want = one_by_one(network, ids)
    assert np.allclose(network.log_probabilities(ids), want, atol=1e-4)
    assert np.allclose(network.log_probabilities(ids, block=7), want, atol=1e-4)


def test_steps_follow_the_gradient():
    rng, network = np.random.default_rng(2), pl.Network.fresh()
    context, target = rng.integers(0, pl.SIZE, (8, 4)), rng.integers(0, pl.SIZE, 8)

    def loss(net):
        total = 0.0
        for c, t in zip(context, target):
            ids = np.array([c[0], c[1], t, c[2], c[3]])
            total -= one_by_one(net, ids)[2]
        return total / 8

    trainer = pl.Trainer(network, rate=1e-3)
    trainer._step(context, target)
    assert loss(trainer.network) < loss(network)
    slope = trainer.squares[1] - np.float32(1e-2)  # squares of the first step's gradient
    flat = network.flat()
    for k in rng.integers(0, network.into.size, 5):
        step = np.zeros_like(flat, dtype=np.float64)
        step[network.embed.size + k] = 1e-3
        numeric = (loss(network.with_flat(flat + step)) - loss(network.with_flat(flat - step))) / 2e-3
        assert abs(numeric ** 2 - slope.ravel()[k]) < 1e-3


def test_order_is_learned_from_both_sides(spark):
    rng = random.Random(1)
    phrases = ["red green blue gray", "one two three four", "sun moon star sky"]
    docs = [(i, " ".join(rng.choice(phrases) for _ in range(60))) for i in range(150)]
    shuffled = []
    for i, t in docs[:20]:
        words = t.split()
        rng.shuffle(words)
        shuffled.append((1000 + i, " ".join(words)))
    model = pl.fit(spark.createDataFrame(docs, "doc_id long, text string"), stride=2, passes=20)
    got = {r.doc_id: r for r in pl.score(spark.createDataFrame(
        docs[:20] + shuffled, "doc_id long, text string"), model).collect()}
    natural = np.mean([got[i].mean_log_prob for i in range(20)])
    assert natural > -1.0 and natural > np.mean([got[1000 + i].mean_log_prob for i in range(20)]) + 1


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", ""), (3, " \n", ""), (4, "word", ""), (4, "word", ""),
            (None, "a b", ""), (5, "the " * 50_000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    model = pl.fit(docs)
    got = pl.score(docs, model).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert all(tuple(by_id[i])[1:] == (0, 0.0, None, None) for i in (1, 2, 3))
    words = pl.token_ids(model.words)
    for i, text in ((4, "word"), (None, "a b")):
        want = one_by_one(model.network, [words[w] for w in text.split()]).sum()
        assert abs(by_id[i].log_likelihood - want) < 1e-3
    assert by_id[5].n_tokens == 50_000
    empty = docs.limit(0)
    assert pl.score(empty, pl.fit(empty)).count() == 0


def test_whole_table(spark):
    """Each row by the plain formula; text of mixed languages is less likely."""
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs = {r.doc_id: r.text for r in table.collect()}
    rows = QUERIES["op5_pseudo_likelihood"](spark, SF_DIR).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(t.lower().split()) for i, t in docs.items()}
    assert np.mean([r.mean_log_prob for r in rows]) > -np.log(pl.SIZE)
    model = pl.fit(table)
    words = pl.token_ids(model.words)
    by_id = {r.doc_id: r for r in rows}
    for i in sorted(docs)[:15]:
        ids = [words[w] for w in docs[i].lower().split()][:3000]
        if len(ids) < 3000:
            want = one_by_one(model.network, ids).sum()
            assert abs(by_id[i].log_likelihood - want) < 1e-2 * max(1, len(ids) ** 0.5)


def test_words_of_a_class_have_probabilities_of_their_own(spark):
    """Held or joined, a rare word counts by its frequency; all words sum to one."""
    words = [f"w{k:05d}ing" for k in range(pl.SIZE + 500)]  # all end alike
    text = [" ".join(words + words[:pl.SIZE] + words[-3:] * 4), "x " * 9 + words[-1], words[-9] + " y",
            "neverseening " + "z" * 500 + "ing"]
    docs = spark.createDataFrame(list(enumerate(text[:3])), "doc_id long, text string")
    asked = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    model, counts = pl.fit(docs), Counter(" ".join(text[:3]).split())
    known = model.vocabulary
    shared = [w for w in counts if w[-3:] == "ing" and known.words.get(w, pl.SIZE) >= pl.SIZE]
    ending = pl._ending("ing")
    tokens = sum(counts[w] for w in shared)
    assert shared and known.totals[pl.SIZE - pl.ENDINGS + ending] == tokens
    ids = pl.token_ids(known.words)
    for word in ["neverseening", *shared]:
        assert abs(known.shares[ids[word]] - np.log(max(1, counts[word]) / (tokens + 1))) < 1e-9
    plain = {r.doc_id: r.log_likelihood for r in pl.score(asked, model).collect()}
    for k in (1, 2, 3):
        assert abs(plain[k] - one_by_one(model.network, [ids[w] for w in text[k].split()]).sum()) < 1e-2
    # Nothing held beyond the network's own words: the same sums by the join.
    joined = pl.vocabulary(docs, held=0)
    assert joined.rest is not None and joined.rest.count() > len(joined.words) - pl.SIZE
    got = {r.doc_id: r.log_likelihood for r in pl.score(asked, pl.Model(joined, model.classes)).collect()}
    same = all(joined.words.get(w) == k for w, k in known.words.items() if k < pl.SIZE)
    assert same and all(abs(got[k] - plain[k]) < 1e-6 * max(1, abs(plain[k])) for k in plain)


def test_every_position_is_a_target(spark, monkeypatch):
    """By default the distributed pass sees each token once, those of short documents too."""
    frames, plain = [], pl.map_rows

    def kept(df, function, schema, **more):
        frames.append((schema, plain(df, function, schema, **more)))
        return frames[-1][1]

    monkeypatch.setattr(pl, "map_rows", kept)
    docs = spark.createDataFrame([(i, "a b c" if i % 2 else "one") for i in range(60)],
                                 "doc_id long, text string").repartition(4)
    pl.fit(docs)
    trained = next(frame for schema, frame in frames if "seen" in schema)
    assert sum(r.seen for r in trained.filter("part = 0").collect()) == 120


def plain_step(net, squares, context, target, rate):
    """A step as its formulas say, with shifted exponentials and every product by itself."""
    n, at = len(target), np.arange(len(target))

    def softmax(logits):
        out = np.exp(logits - logits.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)

    x = net.embed[context].reshape(n, -1)
    hidden = np.tanh(x @ net.into + net.bias)
    group, inside = target // pl.IN_GROUP, target % pl.IN_GROUP
    slope = softmax(hidden @ net.group + net.group_bias)
    slope[at, group] -= 1
    d_hidden, d_within = slope @ net.group.T, np.zeros_like(net.within)
    d_within_bias = np.zeros_like(net.within_bias)
    for g in np.unique(group):
        own = np.flatnonzero(group == g)
        part = softmax(hidden[own] @ net.within[g] + net.within_bias[g])
        part[np.arange(len(own)), inside[own]] -= 1
        d_within[g], d_within_bias[g] = hidden[own].T @ part, part.sum(axis=0)
        d_hidden[own] += part @ net.within[g].T
    d_z = d_hidden * (1 - hidden ** 2)
    d_embed = np.zeros_like(net.embed)
    np.add.at(d_embed, context.ravel(), (d_z @ net.into.T).reshape(-1, pl.WIDTH))
    for value, gradient, square in zip(net.arrays(), [
            d_embed, x.T @ d_z, d_z.sum(axis=0), hidden.T @ slope, slope.sum(axis=0), d_within,
            d_within_bias], squares):
        square += (gradient / n) ** 2
        value -= rate * gradient / n / np.sqrt(square)


@pytest.mark.parametrize("scale", [1, 60])
def test_steps_are_those_of_the_formulas(scale):
    """Also of logits that exponentials cannot hold, and when a smaller batch follows."""
    rng, start = np.random.default_rng(3), pl.Network.fresh()
    start.within *= scale
    trainer = pl.Trainer(start, rate=0.02)
    plain = start.with_flat(start.flat().astype(np.float64))
    plain = pl.Network(*[a.astype(np.float64) for a in plain.arrays()])
    squares = [np.full(a.shape, 1e-2) for a in plain.arrays()]
    for n in (700, 700, 9):
        context = rng.integers(0, pl.SIZE + 1, (n, 4))
        target = np.minimum(rng.zipf(1.3, n) - 1, pl.SIZE - 1)
        trainer._step(context.astype(np.int16), target.astype(np.int16))
        plain_step(plain, squares, context, target, 0.02)
    for got, want in zip(trainer.network.arrays(), plain.arrays()):
        assert np.allclose(got, want, atol=2e-4 * scale)


def test_words_are_looked_up_once(spark, monkeypatch):
    """Training and scoring share the ids; results are those of scoring by itself."""
    docs = spark.createDataFrame([(i, f"a b w{i % 7} once{i}") for i in range(40)] + [(None, None)],
                                 "doc_id long, text string")
    made, plain = [], pl.encoded
    monkeypatch.setattr(pl, "encoded", lambda *args: made.append(1) or plain(*args))
    model = pl.fit(docs)
    got = {r.doc_id: r for r in pl.score(docs, model, rows=model.rows).collect()}
    assert len(made) == 1 and len(got) == 41 and got[None].n_tokens == 0
    assert got == {r.doc_id: r for r in pl.score(docs, model).collect()} and len(made) == 2


def test_scoring_reuses_its_tables(monkeypatch):
    network, ids = pl.Network.fresh(), np.arange(50) * 7
    want, tables = network.log_probabilities(ids), network.tables()
    monkeypatch.setattr(pl.Network, "tables", None)
    assert np.array_equal(network.log_probabilities(ids, tables=tables), want)
