"""Document scores by masked pseudo-likelihood of a small bidirectional network.

Every token is predicted from the two tokens on either side; a document's score is the sum of
the conditional log-probabilities of all its tokens. The output is a softmax in two steps, over
groups of tokens and within the group, so every probability is exact and cheap.

The vocabulary is every word of all documents. Frequent words are outputs of their own; the
others share classes by their last letters, and the network's probability of the class is
multiplied by that of the word in its class, from counts over all documents. A bounded sample
gives the first weights; then every partition trains on all positions of its documents, and
the weights of the partitions are averaged by the number of positions.
"""

import hashlib
import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonwise.llm.common import map_columns, map_rows, written
from seasonwise.llm.units import Remembered

GROUPS, IN_GROUP = 64, 128
SIZE = GROUPS * IN_GROUP
ENDINGS = 64  # rarer words fall into classes by their last letters, all in the last group
SIDES, WIDTH, HIDDEN = (-2, -1, 1, 2), 16, 32
PAD = SIZE
GATHERED = 300_000
HELD = 131_072  # counted words that every task holds; rarer ones are joined
LONG = 64
CACHED, MOVED = 2048, 16_384  # rows of logits, weights: they stay in the cache of a core
SAFE = 60.0  # exponentials of logits up to here need no shift


@dataclass
class Vocabulary:
    """Counts of all words.

    Ids up to ``PAD`` are those of the network, in groups of like frequency; the last ``ENDINGS``
    of them stand for a word of that class seen once or never. Ids above are held words of
    classes. ``rest`` has the words that occur more than once and are not held, with ``n``.
    """

    words: dict[str, int]
    outputs: np.ndarray  # id -> id of the network
    shares: np.ndarray  # id -> log P(word | output)
    totals: np.ndarray  # tokens by id of the network
    rest: DataFrame | None


def _key(word: str) -> str:
    """The word, or a digest of a long one (with a blank, which no word has)."""
    return word if len(word) <= LONG else " " + hashlib.blake2b(
        word.encode("utf-8", "replace"), digest_size=16).hexdigest()


def _ending(word: str) -> int:
    return zlib.crc32(word[-3:].encode("utf-8", "replace")) % ENDINGS


def vocabulary(docs: DataFrame, text: str = "text", held: int = HELD) -> Vocabulary:
    """All words of all documents; of those that share a class, a word that was seen ``n`` times
    has ``max(n, 1)`` in ``1 + all tokens of the class`` (the one is for all unseen words)."""
    def count(batches):
        counts = Counter()

        def gathered():
            return [[_key(w) for w in counts], [_ending(w) for w in counts], list(counts.values())]

        for (texts,) in batches:
            for value in texts:
                if value:
                    counts.update(value.lower().split())
                if len(counts) > GATHERED:
                    yield gathered()
                    counts.clear()
        yield gathered()

    totals = map_columns(docs.select(F.col(f"`{text}`")), count, "word string, ending int, n long")
    counts = written(totals.groupBy("word", "ending").agg(F.sum("n").alias("n")), "words")
    tokens = np.zeros(ENDINGS)
    for r in counts.groupBy("ending").agg(F.sum("n").alias("n")).collect():
        tokens[r.ending] = r.n
    # Every word above a frequency is held, so far as memory goes.
    least, so_far = 2, 0
    sizes = counts.filter("n > 1").groupBy("n").agg(F.count("*").alias("words")).collect()
    for r in sorted(sizes, key=lambda r: -r.n):
        so_far += r.words
        if so_far > held:
            least = r.n + 1
            break
    top = sorted(counts.filter(F.col("n") >= least).collect(), key=lambda r: (-r.n, r.word))
    if len(top) < SIZE - ENDINGS:  # a small table: words seen once are outputs, too
        top += counts.filter(F.col("n") < least).orderBy(F.desc("n"), "word").limit(
            SIZE - ENDINGS - len(top)).collect()
    own, others = top[:SIZE - ENDINGS], top[SIZE - ENDINGS:]
    for r in own:
        tokens[r.ending] -= r.n
    words = {r.word: k for k, r in enumerate(own)}
    words.update((r.word, PAD + 1 + k) for k, r in enumerate(others))
    ending = np.array([r.ending for r in others], dtype=np.int64)
    seen = np.array([r.n for r in others], dtype=np.float64)
    first = SIZE - ENDINGS
    return Vocabulary(
        words, np.concatenate([np.arange(PAD + 1), first + ending]),
        np.concatenate([np.zeros(first), -np.log(tokens + 1), [0.0],
                        np.log(seen) - np.log(tokens[ending] + 1)]),
        np.concatenate([[r.n for r in own], np.zeros(first - len(own)), tokens]),
        counts.filter(F.col("n").between(2, least - 1)).select("word", "n") if least > 2 else None)


def token_ids(words: dict[str, int]) -> Remembered:
    """Id of any word: its own, or that of a rare word of the class of its last three letters."""
    def find(word):
        known = words.get(_key(word))
        return SIZE - ENDINGS + _ending(word) if known is None else known
    found = Remembered(find, 200_000 + len(words))
    found.update(words)
    return found


def encoded(docs: DataFrame, known: Vocabulary, doc_id: str = "doc_id",
            text: str = "text") -> DataFrame:
    """``row, doc_id, h, ids, rare, times``: ids of all words of every text, four bytes each.

    ``h`` is a hash of the document's key and length. ``rare`` has the different words of the
    text that share a class and are not held, ``times`` how often each occurs, where some of them
    are to be joined.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known.words)
    joined_rest = known.rest is not None

    def run(batches):
        of_word, first = token_ids(shared.value), SIZE - ENDINGS
        for rows, keys, hashes, texts in batches:
            found, rare, times = [], [], []
            for value in texts:
                split = value.lower().split() if value else []
                ids = np.fromiter(map(of_word.__getitem__, split), np.int32, len(split))
                places = np.flatnonzero((ids >= first) & (ids < SIZE)) if joined_rest else ids[:0]
                counts = Counter([split[k] for k in places.tolist()])
                found.append(ids.tobytes())
                rare.append([_key(word) for word in counts])
                times.append(list(counts.values()))
            yield rows, keys, hashes, found, rare, times

    value = F.col(f"`{text}`")
    return map_columns(
        docs.select(F.monotonically_increasing_id().alias("row"),
                    F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                    F.xxhash64(F.col(f"`{doc_id}`"), F.length(value)).alias("h"),
                    value.alias("text")),
        run, "row long, doc_id long, h long, ids binary, rare array<string>, times array<long>",
        read_rows=1024)


@dataclass
class Network:
    embed: np.ndarray  # token (and padding) -> WIDTH
    into: np.ndarray  # WIDTH per side -> HIDDEN
    bias: np.ndarray
    group: np.ndarray  # HIDDEN -> GROUPS
    group_bias: np.ndarray
    within: np.ndarray  # per group HIDDEN -> IN_GROUP
    within_bias: np.ndarray

    @staticmethod
    def fresh(seed: int = 9) -> "Network":
        rng = np.random.default_rng(seed)

        def draw(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)

        return Network(draw(SIZE + 1, WIDTH), draw(len(SIDES) * WIDTH, HIDDEN),
                       np.zeros(HIDDEN, np.float32), draw(HIDDEN, GROUPS),
                       np.zeros(GROUPS, np.float32), draw(GROUPS, HIDDEN, IN_GROUP),
                       np.zeros((GROUPS, IN_GROUP), np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.into, self.bias, self.group, self.group_bias, self.within,
                self.within_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def with_flat(self, values: np.ndarray) -> "Network":
        out, at = [], 0
        for a in self.arrays():
            out.append(values[at:at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Network(*out)

    def started(self, totals: np.ndarray) -> "Network":
        """With small output weights and biases that give the frequencies of ``totals``."""
        totals = (totals + 0.1).reshape(GROUPS, IN_GROUP)
        within = totals / totals.sum(axis=1, keepdims=True)
        return Network(self.embed, self.into, self.bias, self.group * np.float32(0.1),
                       np.log(totals.sum(axis=1) / totals.sum()).astype(np.float32),
                       self.within * np.float32(0.1), np.log(within).astype(np.float32))

    def of_words(self, vocabulary: Vocabulary) -> "Network":
        """The same probabilities as a plain network over the vocabulary's ids.

        A held word has the weights of its class and its share in the bias. The last ids are what
        each class has beyond the words held and one rare word.
        """
        outputs, shares = vocabulary.outputs, vocabulary.shares
        first = SIZE - ENDINGS
        taken = np.bincount(outputs[first:] - first, np.exp(shares[first:]) *
                            (outputs[first:] != PAD), ENDINGS + 1)[:ENDINGS]
        left = np.where(taken < 1 - 1e-9, np.log(np.maximum(1 - taken, 1e-300)), -np.inf)
        more = np.concatenate([outputs[PAD + 1:], np.arange(first, SIZE)]) - (SIZE - IN_GROUP)
        bias = self.within_bias[-1] + shares[SIZE - IN_GROUP:SIZE]
        extra = self.within_bias[-1][more] + np.concatenate([shares[PAD + 1:], left])
        weights = self.within[-1].astype(np.float64)
        return Network(
            self.embed[np.concatenate([outputs, np.arange(first, SIZE)])], self.into, self.bias,
            self.group, self.group_bias,
            [*self.within[:-1], np.concatenate(
                [weights, np.zeros((HIDDEN, 1)), weights[:, more]], axis=1)],
            [*self.within_bias[:-1], np.concatenate([bias, [-np.inf], extra])])

    def tables(self) -> list[np.ndarray]:
        """What a token adds to the hidden values from each side."""
        return [self.embed @ self.into[k * WIDTH:(k + 1) * WIDTH] for k in range(len(SIDES))]

    def log_probabilities(self, ids: np.ndarray, block: int = 16_384,
                          tables: list[np.ndarray] | None = None) -> np.ndarray:
        """Conditional log-probability of every token, from both sides.

        Padding between documents keeps them apart; its own values mean nothing. ``tables`` spares
        making them anew.
        """
        padded = np.concatenate([[PAD] * 2, ids, [PAD] * 2])
        tables = tables or self.tables()
        out = np.empty(len(ids), dtype=np.float32)
        for at in range(0, len(ids), block):
            n = min(block, len(ids) - at)
            order, target, ends = _by_group(np.minimum(ids[at:at + n], SIZE - 1))
            hidden = np.tile(self.bias, (n, 1))
            for table, side in zip(tables, SIDES):
                hidden += np.take(table, padded[at + 2 + side:at + 2 + side + n][order], axis=0)
            np.tanh(hidden, out=hidden)
            group, inside = target // IN_GROUP, target % IN_GROUP
            part = np.empty(n, np.float32)
            for rows in _slices(0, n):
                part[rows] = _chosen_log_softmax(
                    hidden[rows] @ self.group + self.group_bias, group[rows])
            for g in range(GROUPS):
                for rows in _slices(ends[g], ends[g + 1]):
                    part[rows] += _chosen_log_softmax(
                        hidden[rows] @ self.within[g] + self.within_bias[g], inside[rows])
            out[at + order] = part
        return out


def _by_group(target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """An order in which the targets of a group stand together, they in it, and the groups' ends."""
    group = (target // IN_GROUP).astype(np.uint8)  # sorted by digits
    order = np.argsort(group, kind="stable")
    return order, target[order], [0, *np.cumsum(np.bincount(group, minlength=GROUPS)).tolist()]


def _slices(start: int, end: int) -> list[slice]:
    return [slice(at, min(at + CACHED, end)) for at in range(start, end, CACHED)]


def _centred(logits: np.ndarray) -> np.ndarray:
    """Less the row's largest where exponentials could leave the range of single precision."""
    if not (logits.size and logits.min() > -SAFE and logits.max() < SAFE):
        logits -= logits.max(axis=1, keepdims=True)
    return logits


def _exponentials(logits: np.ndarray) -> np.ndarray:
    """Sums of the exponentials by row; ``logits`` become the exponentials."""
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[1], logits.dtype)


def _chosen_log_softmax(logits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    picked = _centred(logits)[np.arange(len(logits)), chosen]
    return picked - np.log(_exponentials(logits))


def _slopes(logits: np.ndarray, chosen: np.ndarray, n: int) -> np.ndarray:
    """Softmax less one at the chosen places, by ``n``: ``logits`` times the factor of the row."""
    total = _exponentials(_centred(logits))
    logits[np.arange(len(logits)), chosen] -= total
    return 1 / (total * np.float32(n))


class Trainer:
    """Adaptive gradient steps on batches of positions."""

    def __init__(self, network: Network, rate: float = 0.05, batch: int = 1024, damping: float = 1e-2):
        self.network, self.rate, self.batch = Network(*[a.copy() for a in network.arrays()]), rate, batch
        self.squares = [np.full(a.shape, damping, np.float32) for a in network.arrays()]
        self.held_context, self.held_target, self.held, self.seen = [], [], 0, 0
        self.room = {}

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """An array that every step takes again: new ones cost about as much as the products."""
        size = math.prod(shape)
        if name not in self.room or self.room[name].size < size:
            self.room[name] = np.empty(size, np.float32)
        return self.room[name][:size].reshape(shape)

    def add(self, ids: np.ndarray, stride: int, offset: int) -> None:
        """Positions ``offset, offset + stride, ...`` of a document as targets."""
        at = np.arange(offset % stride, len(ids), stride)
        if not len(at):
            return
        gap = np.full(2, PAD, np.int16)
        padded = np.concatenate([gap, ids, gap])
        self.held_context.append(np.stack([padded[at + 2 + s] for s in SIDES], axis=1))
        self.held_target.append(ids[at])
        self.held += len(at)
        if self.held >= self.batch:
            self.flush(self.batch)

    def flush(self, least: int = 1) -> None:
        if self.held < max(1, least):
            return
        context, target = np.concatenate(self.held_context), np.concatenate(self.held_target)
        at = 0
        while len(target) - at >= max(1, least):
            self._step(context[at:at + self.batch], target[at:at + self.batch])
            at += self.batch
        at = min(at, len(target))
        self.held_context, self.held_target = [context[at:]], [target[at:]]
        self.held = len(target) - at

    def _step(self, context: np.ndarray, target: np.ndarray) -> None:
        net, n = self.network, len(target)
        self.seen += n
        order, target, ends = _by_group(target)
        context = context[order].ravel().astype(np.uint16)  # sorted by digits below
        x = np.take(net.embed, context, axis=0, mode="clip",
                    out=self._room("x", context.size, WIDTH)).reshape(n, -1)
        hidden = np.matmul(x, net.into, out=self._room("hidden", n, HIDDEN))
        hidden += net.bias
        np.tanh(hidden, out=hidden)
        slope = np.matmul(hidden, net.group, out=self._room("slope", n, GROUPS))
        slope += net.group_bias
        # Rows of slopes lack a factor each, which the narrower sides of the products get.
        factor = _slopes(slope, target // IN_GROUP, n)
        d_hidden = np.matmul(slope, net.group.T, out=self._room("d_hidden", n, HIDDEN))
        d_hidden *= factor[:, None]
        scaled = np.multiply(hidden, factor[:, None], out=self._room("scaled", n, HIDDEN))
        d_group, d_group_bias = scaled.T @ slope, factor @ slope
        part, more = self._room("part", n, IN_GROUP), self._room("more", n, HIDDEN)
        groups = [(g, slice(ends[g], ends[g + 1])) for g in range(GROUPS) if ends[g] < ends[g + 1]]
        for g, own in groups:
            np.matmul(hidden[own], net.within[g], out=part[own])
            part[own] += net.within_bias[g]
        factor = _slopes(part, target % IN_GROUP, n)
        np.multiply(hidden, factor[:, None], out=scaled)
        d_within = self._room("d_within", *net.within.shape)
        d_within_bias = np.zeros_like(net.within_bias)
        d_within.fill(0)
        for g, own in groups:
            np.matmul(scaled[own].T, part[own], out=d_within[g])
            np.matmul(factor[own], part[own], out=d_within_bias[g])
            np.matmul(part[own], net.within[g].T, out=more[own])
        more *= factor[:, None]
        d_hidden += more
        hidden *= hidden
        d_z = np.multiply(d_hidden, np.subtract(1, hidden, out=hidden), out=d_hidden)
        # Embeddings in the batch only: the others have no slope.
        d_x = np.matmul(d_z, net.into.T, out=self._room("d_x", n, x.shape[1]))
        order = np.argsort(context, kind="stable")
        sorted_context = context[order]
        starts = np.flatnonzero(np.diff(sorted_context, prepend=sorted_context[0] ^ 1))
        rows = sorted_context[starts]
        d_embed = np.add.reduceat(np.take(d_x.reshape(-1, WIDTH), order, axis=0, mode="clip",
                                          out=self._room("d_embed", context.size, WIDTH)), starts)
        squares = self.squares[0][rows] + d_embed ** 2
        self.squares[0][rows] = squares
        net.embed[rows] -= self.rate * d_embed / np.sqrt(squares)
        slopes = [x.T @ d_z, d_z.sum(axis=0), d_group, d_group_bias, d_within, d_within_bias]
        for value, gradient, square in zip(net.arrays()[1:], slopes, self.squares[1:]):
            _move(value.reshape(-1), gradient.reshape(-1), square.reshape(-1), self.rate)


def _move(value: np.ndarray, gradient: np.ndarray, square: np.ndarray, rate: float) -> None:
    for at in range(0, len(value), MOVED):
        some = slice(at, at + MOVED)
        step = gradient[some] * gradient[some]
        square[some] += step
        np.sqrt(square[some], out=step)
        np.divide(gradient[some], step, out=step)
        step *= np.float32(rate)
        value[some] -= step


@dataclass
class Model:
    vocabulary: Vocabulary
    classes: Network  # over the ids of the network
    rows: DataFrame | None = None  # what was learned from, as ``encoded``

    @property
    def words(self) -> dict[str, int]:
        return self.vocabulary.words

    @property
    def network(self) -> Network:
        return self.classes.of_words(self.vocabulary)


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = 2000,
        stride: int = 1, passes: int = 3) -> Model:
    """A model of all documents.

    First weights come from about ``sample`` documents, chosen by a hash, ``passes`` times.
    Then each partition goes on from there with every position of all its documents (with a
    ``stride``, every so many-th; the first one changes from document to document); the results
    are averaged.
    """
    known = vocabulary(docs, text)
    rows = written(encoded(docs, known, doc_id, text), "ids")
    return Model(known, _trained(rows.select("h", "ids"), known, sample, stride, passes), rows)


def _trained(rows: DataFrame, known: Vocabulary, sample: int, stride: int, passes: int) -> Network:
    """The network of ``fit`` from ``h, ids``, which are read twice."""
    context = rows.sparkSession.sparkContext
    outputs = known.outputs.astype(np.int16)
    share = min(1.0, sample / max(1, rows.count()))
    first = sorted((r.h, outputs[np.frombuffer(r.ids, np.int32)].tobytes()) for r in rows.filter(
        F.pmod("h", F.lit(1_000_000)) < share * 1_000_000).collect())
    trainer = Trainer(Network.fresh().started(known.totals), damping=1e-6)
    for turn in range(passes):
        for h, data in first:
            trainer.add(np.frombuffer(data, np.int16), 4, (h + turn) % 4)
    trainer.flush()
    start, shared_outputs = context.broadcast(trainer.network), context.broadcast(outputs)

    def train(batches):
        outputs = shared_outputs.value
        local = Trainer(start.value, rate=0.02, batch=4096, damping=1e-6)
        for hashes, texts in batches:
            for h, ids in zip(hashes, texts):
                local.add(outputs[np.frombuffer(ids, np.int32)], stride, h % stride)
        local.flush()
        if local.seen:
            weights = local.network.flat()
            for k, part in enumerate(np.array_split(weights, 16)):
                yield k, local.seen, part.tobytes()

    def average(batches):
        sums, counts = {}, Counter()
        for parts, seen, values in batches:
            for k, n, data in zip(parts, seen, values):
                sums[k] = sums.get(k, 0) + n * np.frombuffer(data, np.float32).astype(np.float64)
                counts[k] += n
        for k, total_sum in sums.items():
            yield k, (total_sum / counts[k]).astype(np.float32).tobytes()

    locally = map_rows(rows, train, "part int, seen long, weights binary", batch_rows=16)
    averaged = map_rows(locally.repartition(16, "part"), average, "part int, weights binary")
    parts = sorted((r.part, bytes(r.weights)) for r in averaged.collect())
    network = trainer.network
    if parts:
        network = network.with_flat(np.concatenate(
            [np.frombuffer(data, np.float32) for _, data in parts]))
    return network


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text",
          rows: DataFrame | None = None) -> DataFrame:
    """``doc_id, n_tokens, log_likelihood, mean_log_prob, perplexity`` of every whole text.

    Null, empty and blank texts have no tokens, a sum of 0 and null means. Repeated rows each
    get a row; other columns are not looked at; an empty table gives no rows. With ``rows``, these
    documents as ``encoded`` (``model.rows`` of those it learned from), no word is looked up again.
    """
    known = model.vocabulary
    if rows is None:
        rows = encoded(docs, known, doc_id, text)
        rows = rows if known.rest is None else written(rows, "ids")  # read twice then
    shared = rows.sparkSession.sparkContext.broadcast((known.outputs, known.shares, model.classes))

    def run(batches):
        outputs, shares, network = shared.value
        tables, gap = network.tables(), np.full(2, PAD)
        for numbers, keys, texts in batches:
            # Documents one after the other, padded apart: one pass for some of them.
            for at in range(0, len(numbers), 64):
                ids = [np.frombuffer(data, np.int32) for data in texts[at:at + 64]]
                joined = np.concatenate([part for one in ids for part in (one, gap)])
                found = network.log_probabilities(outputs[joined], tables=tables) + shares[joined]
                end = 0
                for k, one in enumerate(ids, at):
                    total = float(found[end:end + len(one)].sum(dtype=np.float64))
                    end += len(one) + 2
                    yield numbers[k], keys[k], len(one), total

    sums = map_rows(rows.select("row", "doc_id", "ids"), run,
                    "row long, doc_id long, n_tokens long, log_likelihood double")
    if known.rest is not None:
        # Words seen n times, not held: the class's share of a single word, times n.
        more = (rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w"))
                .select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
                .join(known.rest, "word").select(
                    "row", F.lit(None).cast("long").alias("doc_id"),
                    F.lit(None).cast("long").alias("n_tokens"),
                    (F.col("times") * F.log("n")).alias("log_likelihood")))
        sums = sums.unionByName(more).groupBy("row").agg(
            F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"),
            F.sum("log_likelihood").alias("log_likelihood"))
    mean = F.col("log_likelihood") / F.nullif("n_tokens", F.lit(0))
    return sums.select("doc_id", "n_tokens", "log_likelihood", mean.alias("mean_log_prob"),
                       F.when(mean.isNotNull(), F.exp(F.least(-mean, F.lit(700.0)))).alias("perplexity"))
