"""Language of texts by error-correcting output codes over n-grams.

Each language has a codeword of bits; each bit has a logistic classifier over hashed n-grams of
the lower-cased letters. Decoding weighs the loss of every bit by how well its classifier
separates, and takes the codeword with the smallest sum.
"""

import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seasonwise.llm.common import map_rows

UNDETERMINED = "und"
BUCKETS = 4096
LETTER = re.compile(r"[^\W\d_]")
# Bytes below 128 that are no letters count as a space.
_TABLE = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], dtype=np.uint32)
_CHUNK = 1 << 20


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in LETTER.finditer(text))


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed 1- to 4-grams of UTF-8 bytes of the whole text."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    data = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), dtype=np.uint8)
    for at in range(0, len(data), _CHUNK):
        part = _TABLE[data[at:at + _CHUNK + 3]]
        kept = np.ones(len(part), dtype=bool)
        kept[1:] = (part[1:] != 32) | (part[:-1] != 32)
        part = part[kept]
        gram = part.copy()
        for n in range(1, 5):
            if n > 1:
                gram = gram[:-1] * np.uint32(0x01000193) + part[n - 1:]
            if len(gram):
                mixed = gram * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
                counts += np.bincount((mixed ^ (mixed >> np.uint32(15))) % np.uint32(BUCKETS),
                                      minlength=BUCKETS)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """A row of +1 and -1 per language: every split of few languages, else random balanced ones.

    The first language always has +1 in the exhaustive code, so no two columns are complements.
    """
    if n <= 2:
        return np.array([[1], [-1]][:n])
    if n <= 6:
        splits = [s for s in itertools.product((1, -1), repeat=n - 1) if -1 in s]
        return np.array([(1, *s) for s in splits]).T
    rng, length = np.random.default_rng(seed), int(np.ceil(12 * np.log2(n)))
    best, widest = None, -1
    for _ in range(200):
        code = np.stack([rng.permutation(np.resize([1, -1], n)) for _ in range(length)], axis=1)
        apart = min((a != b).sum() for a, b in itertools.combinations(code, 2))
        if apart > widest:
            best, widest = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted loss of every codeword for every row."""
        margins = x @ self.weights + self.bias
        return np.einsum("nlb,b->nl", np.logaddexp(
            0, -margins[:, None, :] * self.code[None]), self.trust)

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Language, probability of its codeword, and whether another is nearly as near."""
        share = np.exp(-self.losses(features(text)[None])[0])
        share /= share.sum()
        order = np.argsort(-share, kind="stable")
        second = share[order[1]] if len(order) > 1 else 0.0
        best = float(share[order[0]])
        return self.languages[order[0]], best, bool(best - second < 0.2)


def train(x: np.ndarray, labels: list[str], steps: int = 300, penalty: float = 1e-4) -> Model:
    """Logistic classifiers of the codewords' bits, by accelerated gradient descent."""
    languages = sorted(set(labels))
    code = codewords(len(languages)).astype(np.float64)
    index = {language: k for k, language in enumerate(languages)}
    of_row = np.array([index[label] for label in labels])
    bits = code[of_row]
    # Every language weighs the same.
    weight = 1 / np.bincount(of_row)[of_row] / len(languages)
    w, b = np.zeros((x.shape[1], code.shape[1])), np.zeros(code.shape[1])
    v, c = w.copy(), b.copy()
    x = x.astype(np.float32)
    rate = 4.0 / (1 + penalty)  # rows have length one
    for step in range(steps):
        slope = -bits / (1 + np.exp(np.clip(bits * (x @ v.astype(np.float32) + c), -30, 30)))
        slope *= weight[:, None]
        next_w = v - rate * (x.T @ slope.astype(np.float32) + penalty * v)
        next_b = c - rate / 2 * slope.sum(axis=0)
        push = step / (step + 3)
        v, c, w, b = next_w + push * (next_w - w), next_b + push * (next_b - b), next_w, next_b
    margins = bits * (x @ w.astype(np.float32) + b)
    trust = 1 - 2 * (weight[:, None] * (margins <= 0)).sum(axis=0)
    return Model(languages, code, w.astype(np.float32), b, np.maximum(trust, 0.01))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        per_language: int = 1000) -> Model | None:
    """A model of documents with a language that are not held out.

    It learns from at most ``per_language`` documents of each language, the first by a hash
    of ``doc_id``, with their whole texts; None if there is none with a letter.
    """
    known = docs.select(F.xxhash64(F.col(f"`{doc_id}`")).alias("h"), F.col(f"`{lang}`").alias("lang"),
                        F.col(f"`{text}`").alias("text"), F.col(f"`{doc_id}`").alias("doc_id"))
    known = known.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    # First a share by hash, so that no window holds a whole language.
    bounds = docs.sparkSession.createDataFrame(
        [(lang, int(min(1.0, (2 * per_language + 50) / n) * (2**62)))
         for lang, n in counts.items()], "lang string, most long")
    chosen = known.join(F.broadcast(bounds), "lang").filter(
        F.shiftrightunsigned("h", 2) <= F.col("most")).select("lang", "h", "doc_id", "text")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = chosen.withColumn("n", place).filter(F.col("n") <= per_language).select("lang", "text")

    def run(batches):
        for languages, texts in batches:
            for language, value in zip(languages, texts):
                if has_letter(value):
                    yield language, features(value).astype(np.float16).tobytes()

    rows = map_rows(chosen, run, "lang string, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.lang, bytes(r.x)))
    x = np.stack([np.frombuffer(r.x, dtype=np.float16) for r in rows])
    return train(x, [r.lang for r in rows])


def predict(docs: DataFrame, model: Model | None, doc_id: str = "doc_id",
            text: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` of every whole text.

    A null text or one without a letter is ``und`` with score 0 and not ambiguous, and so is
    every text without a model. Repeated rows each get a row; a null ``doc_id`` is not held
    out; other columns are not looked at; an empty table gives no rows.
    """
    def run(batches):
        for ids, out, texts in batches:
            for i, held, value in zip(ids, out, texts):
                if model is None or not has_letter(value):
                    yield i, held, UNDETERMINED, 0.0, False
                else:
                    yield i, held, *model.predict(value)

    chosen = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                         held_out(doc_id).alias("held_out"), F.col(f"`{text}`").alias("text"))
    return map_rows(chosen, run, "doc_id long, held_out boolean, lang_pred string, "
                                 "score double, ambiguous boolean")


def recognised(docs: DataFrame, model: Model | None, text: str = "text",
               lang: str = "lang") -> DataFrame:
    """``docs`` without texts of no recognisable language; ``lang`` holds the predicted one.

    Dropped are texts that are null or without a letter, and those whose two nearest codewords
    are about equally near. All columns stay as they are but ``lang``; without a model nothing
    is recognised.
    """
    at = docs.columns.index(text)
    named = docs.columns.index(lang) if lang in docs.columns else None

    def run(batches):
        for batch in batches:
            found = [model.predict(value) if model is not None and has_letter(value)
                     else (None, 0.0, True) for value in batch.column(at).to_pylist()]
            kept = pa.array([not doubtful for _, _, doubtful in found])
            if named is not None:
                field = batch.schema.field(named)
                batch = batch.set_column(named, field.name, pa.array(
                    [language for language, _, _ in found], type=field.type))
            yield batch.filter(kept)

    return docs.mapInArrow(run, docs.schema)
