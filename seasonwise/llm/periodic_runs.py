"""Periodic runs of words: stretches that repeat one group of words several times over.

Suffixes of a document are sorted, and their classes are united by decreasing length of the
longest common prefix (LCP), as Kruskal's algorithm unites trees by weight. Each class keeps its
positions in text order. When two positions become neighbours in a class at a distance d not above
the LCP, the words from the first one on have period d for d + LCP words: the seed of a run.
"""

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words of documents that are sorted together; a longer document is sorted alone.
BATCH_WORDS = 200_000
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()),
                           ("period", pa.int64())]))


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = 6,
              least_repeats: int = 4) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row of ``docs``.

    Words are what white space of ASCII separates, in whole texts. A run is a stretch of
    consecutive words with smallest period q that no neighbouring word extends, of at least
    ``least_words`` and ``least_repeats * q`` words (``least_repeats`` is 2 or more, so that a
    run is seen as neighbours within the LCP). ``runs`` lists ``start`` (word number
    from 0), ``length`` and ``period`` by start, then period. ``collapsed`` is the text without
    the words that come after the first q words of a run, joined by one space.

    A null text counts as empty: no words, no runs, an empty ``collapsed``. Documents are looked
    at one by one, so repeated rows, rows without id and any order give the same; an empty table
    gives none. A document is one task's work, n log n in its words. Other columns are not looked
    at.
    """
    if least_repeats < 2:
        raise ValueError("a run repeats its period at least twice")
    schema = ("doc_id long, n_words long, "
              "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            first = 0
            while first < len(ids):
                split, n, last = [], 0, first
                while last < len(ids) and (n < BATCH_WORDS or last == first):
                    words = (texts[last].as_py() or "").encode().split()  # at ASCII blanks
                    if split and n + len(words) > BATCH_WORDS:
                        break
                    split.append(words)
                    n, last = n + len(words), last + 1
                yield _found(ids[first:last], split, least_words, least_repeats)
                first = last

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                       F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


def _found(ids: list, split: list[list[bytes]], least_words: int,
           least_repeats: int) -> pa.RecordBatch:
    runs = runs_of(split, least_words, least_repeats)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([len(w) for w in split], pa.int64()),
         pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], RUNS),
         pa.array([_collapsed(w, r) for w, r in zip(split, runs)], pa.string())],
        ["doc_id", "n_words", "runs", "collapsed"])


def _collapsed(words: list[bytes], runs: list[tuple]) -> str:
    kept, at = [], 0
    # Runs are sorted by start, but the first q words of one may lie in the rest of another.
    for start, end in sorted((s + q, s + n) for s, n, q in runs):
        if end > at:
            kept += words[at:max(at, start)]
            at = end
    return b" ".join(kept + words[at:]).decode()


def runs_of(split: list[list[bytes]], least_words: int = 6,
            least_repeats: int = 4) -> list[list[tuple[int, int, int]]]:
    """Runs ``(start, length, period)`` of each list of words, sorted."""
    # A run of period q and length m makes two suffixes, q apart, with an LCP of m - q.
    least = max(least_repeats - 1, min(max((least_repeats - 1) * q, least_words - q)
                                       for q in range(1, least_words + 1)))
    found = [[] for _ in split]
    if not any(len(words) > least for words in split):
        return found
    letters, starts = _letters(split)
    pairs = _neighbours(letters, least)
    for start, length, period in _kruskal(letters, *pairs, least_words, least_repeats):
        doc = int(np.searchsorted(starts, start, "right")) - 1
        found[doc].append((start - int(starts[doc]), length, period))
    return [sorted(r, key=lambda run: (run[0], run[2])) for r in found]


def _letters(split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Documents one after another as numbers of words, and the place where each begins.

    Each document ends with a number of its own, so that no two of them have it in common.
    """
    numbers = {}
    sizes = [len(words) + 1 for words in split]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    letters = np.empty(sum(sizes), np.int64)
    for at, words in zip(starts, split):
        letters[at:at + len(words)] = [numbers.setdefault(w, len(numbers)) for w in words]
    ends = starts + np.array(sizes) - 1
    letters[ends] = len(numbers) + np.arange(len(split))
    return letters, starts


def _neighbours(letters: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring suffixes with at least ``least`` common words: two positions and the LCP.

    Ranks by 1, 2, 4, ... words; only suffixes that still share a rank are sorted again, and the
    ranks of all levels give the LCP by halving steps.
    """
    n = len(letters)
    order = np.argsort(letters, kind="stable")
    rank = np.empty(n, np.int32)
    rank[order] = _since(letters[order])
    levels, step = [rank], 1
    live = order[_shared(rank[order])]
    while len(live):
        # No rank is shared beyond an end, so a shared one has all its words before the last.
        key = rank[live].astype(np.int64) * (n + 1) + rank[np.minimum(live + step, n - 1)]
        by = np.argsort(key, kind="stable")
        live, key = live[by], key[by]
        blocks = key // (n + 1)
        begin = _since(blocks)
        rank = rank.copy()
        rank[live] = blocks + _since(key) - begin
        order[blocks + np.arange(len(live)) - begin] = live
        levels.append(rank)
        step *= 2
        live = live[_shared(rank[live])]
    # Suffixes that differ within so many words have no LCP of ``least``.
    level = min(int(np.log2(least)), len(levels) - 1)
    near = np.flatnonzero(levels[level][order[1:]] == levels[level][order[:-1]])
    a, b = order[near], order[near + 1]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
        common += np.where((levels[k][x] == levels[k][y]) & (x != y), 1 << k, 0)
    wanted = common >= least
    return a[wanted], b[wanted], common[wanted]


def _since(sorted_values: np.ndarray) -> np.ndarray:
    """Index at which each item's group of equal values begins."""
    fresh = np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])
    return np.maximum.accumulate(np.where(fresh, np.arange(len(sorted_values)), 0))


def _shared(ranks: np.ndarray) -> np.ndarray:
    """Which of the sorted ranks occur more than once."""
    same = ranks[1:] == ranks[:-1]
    return np.concatenate([[False], same]) | np.concatenate([same, [False]])


def _kruskal(letters: np.ndarray, a: np.ndarray, b: np.ndarray, common: np.ndarray,
             least_words: int, least_repeats: int) -> Iterator[tuple[int, int, int]]:
    """Runs from uniting the classes of neighbouring suffixes by decreasing LCP."""
    by = np.lexsort((np.minimum(a, b), -common))
    a, b, common = a[by].tolist(), b[by].tolist(), common[by].tolist()
    members = {}  # position: the list of its class, in text order
    i = 0
    while i < len(common):
        lcp, seeds = common[i], []
        while i < len(common) and common[i] == lcp:
            p, q = a[i], b[i]
            large, small = members.get(p) or [p], members.get(q) or [q]
            if len(small) > len(large):
                large, small = small, large
            at = 0
            for position in small:
                at = bisect_left(large, position, at)
                large.insert(at, position)
                seeds += large[max(at - 1, 0):at + 1]
                members[position] = large
            if len(large) == len(small) + 1:
                for position in large:
                    members[position] = large
            i += 1
        # Neighbours at this level are known when all its classes are united.
        for p in set(seeds):
            positions = members[p]
            at = bisect_left(positions, p) + 1
            if at == len(positions):
                continue
            q = positions[at]
            period, length = q - p, q - p + lcp
            if (length >= least_words and length >= least_repeats * period
                    and (p == 0 or letters[p - 1] != letters[q - 1])
                    and letters[p + lcp] != letters[q + lcp]):
                yield p, length, period
