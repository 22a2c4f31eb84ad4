"""Packing of tokenised documents into windows of fixed length.

Documents are cut at every full window; the tails are packed by length. Tails of like length
(rounded up to a grain) are interchangeable, so the work is on a histogram: shallow
combinations of lengths that fill a window exactly are enumerated, non-negative least squares
finds how often each is to be used, the counts are rounded down, and what is left is packed
greedily, length class by length class. Only the histogram reaches the driver.
"""

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seasonwise.llm.common import cut_lineage, map_rows
from seasonwise.llm.units import ByteBpe


def token_pieces(docs: DataFrame, file: str, window: int, end_id: int, doc_id: str, text: str,
                 with_ids: bool = False) -> DataFrame:
    """Documents cut into full windows and a tail.

    ``doc_id, start, length, ids_crc32, doc_tokens``, and ``ids`` (unsigned little-endian
    32-bit numbers) if wanted. A null text is empty: its only id is ``end_id``.
    """
    def cut(batches):
        bpe, end = ByteBpe(file), end_id.to_bytes(4, "little")
        for ids, texts in batches:
            for i, value in zip(ids, texts):
                data = bpe.ids(value) + end if value else end
                for at in range(0, len(data), 4 * window):
                    piece = data[at:at + 4 * window]
                    row = i, at // 4, len(piece) // 4, zlib.crc32(piece), len(data) // 4
                    yield (*row, piece) if with_ids else row

    chosen = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                         F.col(f"`{text}`").alias("text"))
    return map_rows(chosen, cut, "doc_id long, start long, length long, ids_crc32 long, "
                                 "doc_tokens long" + ", ids binary" * with_ids)


def combinations(filled: int, depth: int, present: set[int]) -> list[tuple[int, ...]]:
    """Descending tuples of at most ``depth`` present classes that add up to ``filled``."""
    out = []

    def extend(parts, rest, most):
        if rest == 0:
            out.append(tuple(parts))
        elif len(parts) < depth:
            for size in sorted((s for s in present if s <= min(rest, most)), reverse=True):
                if size * (depth - len(parts)) < rest:
                    break
                extend([*parts, size], rest - size, size)

    extend([], filled, filled)
    return out


def non_negative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with the least |a x - b|: columns enter by gradient, leave at zero."""
    x = np.zeros(a.shape[1])
    active: list[int] = []
    tolerance = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(3 * len(b)):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        best = int(np.argmax(gradient)) if len(active) < a.shape[1] else -1
        if best < 0 or gradient[best] <= tolerance:
            break
        active.append(best)
        while active:
            solved = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if solved.min() > 0:
                x[:] = 0
                x[active] = solved
                break
            old = x[active]
            shrinking = solved <= 0
            step = np.min(old[shrinking] / np.maximum(old[shrinking] - solved[shrinking], 1e-300))
            moved = old + min(1.0, step) * (solved - old)
            x[:] = 0
            x[active] = np.maximum(moved, 0)
            active = [k for k, value in zip(active, moved) if value > tolerance]
        if best not in active:  # rounding only: nothing more to gain
            break
    return x


def plan(histogram: dict[int, int], filled: int, depth: int = 3) -> list[tuple[tuple, int]]:
    """Patterns of length classes and how often to use each; uses every piece once."""
    left = {size: n for size, n in histogram.items() if n > 0}
    patterns = []

    def use(parts, times):
        for part in parts:
            left[part] -= times
        patterns.append((tuple(parts), times))

    whole = left.get(filled, 0)
    if whole:
        use((filled,), whole)
    present = sorted(s for s in left if s < filled)
    combos = [c for c in combinations(filled, depth, set(present)) if len(c) > 1]
    if combos:
        row = {size: k for k, size in enumerate(present)}
        matrix = np.zeros((len(present), len(combos)))
        for column, parts in enumerate(combos):
            for part in parts:
                matrix[row[part], column] += 1
        times = non_negative_least_squares(matrix, np.array([left[s] for s in present], float))
        for k in np.argsort(-times, kind="stable"):
            parts = combos[k]
            most = min(left[p] // parts.count(p) for p in parts)
            if n := min(int(times[k] + 1e-6), most):
                use(parts, n)
    while any(left.values()):
        parts, room = [], filled
        for size in sorted((s for s, n in left.items() if n), reverse=True):
            fit = min(left[size], room // size)
            parts += [size] * fit
            room -= fit * size
        use(parts, min(left[p] // parts.count(p) for p in set(parts)))
    return patterns


def segments(patterns: list[tuple[tuple, int]]) -> list[tuple]:
    """Which ranks of a class go where: ``class, first, end, per window, window, slot``."""
    used: dict[int, int] = {}
    rows, windows = [], 0
    for parts, times in patterns:
        for slot, size in enumerate(parts):
            if slot and parts[slot - 1] == size:
                continue
            per = parts.count(size)
            first = used.get(size, 0)
            used[size] = first + per * times
            rows.append((size, first, first + per * times, per, windows, slot))
        windows += times
    return rows


def pack(docs: DataFrame, file: str = "byte_bpe_50k.json", window: int = 2048, end_id: int = 1,
         grain: int = 8, doc_id: str = "doc_id", text: str = "text",
         with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Every id lies in exactly one piece, pieces of a sequence are gapless from offset 0 and add
    up to ``window`` at most. ``grain`` is the step of the length classes. A null text is
    empty; repeated rows and rows without ``doc_id`` are documents of their own; other columns
    are not looked at; an empty table gives no rows.
    """
    if window % grain:
        raise ValueError("grain must divide window")
    spark: SparkSession = docs.sparkSession
    pieces = cut_lineage(token_pieces(docs, file, window, end_id, doc_id, text, with_ids))
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    classed = pieces.select(
        "*", F.ceil(F.col("length") / grain).cast("int").alias("_class"),
        F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int").alias("_salt"))
    # Rank of a piece in its class: its place in a salted share, after all earlier shares.
    shares = classed.groupBy("_class", "_salt").agg(F.count("*").alias("_n"))
    before = shares.select("_class", "_salt", (F.sum("_n").over(
        Window.partitionBy("_class").orderBy("_salt")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_class", "_salt").orderBy(
        "doc_id", "start", "ids_crc32"))
    ranked = (classed.withColumn("_place", place).join(before, ["_class", "_salt"])
              .withColumn("_rank", F.col("_before") + F.col("_place") - 1))
    histogram = {r[0]: r[1] for r in classed.groupBy("_class").count().collect()}
    rows = segments(plan(histogram, window // grain))
    # A few rows per class, window / grain classes: small whatever the corpus.
    places = spark.createDataFrame(
        rows, "_class int, _first long, _end long, _per long, _window long, _slot long")
    placed = ranked.join(F.broadcast(places), (ranked["_class"] == places["_class"])
                         & F.col("_rank").between(F.col("_first"), F.col("_end") - 1))
    at = F.col("_rank") - F.col("_first")
    placed = placed.select(
        *pieces.columns, (F.col("_window") + F.expr("(_rank - _first) div _per"))
        .alias("sequence_id"), (F.col("_slot") + at % F.col("_per")).alias("_slot"))
    ahead = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("_slot"))
    return placed.withColumn("offset", ahead - F.col("length")).drop("_slot")
