"""Token counts of documents from piece counts of distinct pre-tokens; no ids are made."""

from collections import Counter
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonwise.llm.common import map_columns, written
from seasonwise.llm.units import PreTokens, Remembered

# Pre-tokens whose counts every task holds: about 100 bytes each at most.
HEAD = 131_072
HEAD_CHARS = 32
# Distinct units a task gathers before it passes their counts on.
GATHERED = 100_000
# Units whose counts a task remembers, and rows that are Python objects at a time.
REMEMBERED = 100_000
READ_ROWS = 512
# Pre-tokens that are passed on at a time.
GIVEN_ROWS = 4096


def pre_token_table(docs: DataFrame, file: str, text: str = "text") -> DataFrame:
    """Every distinct pre-token of the corpus: ``pre_token, total, n_pieces``.

    Frequencies are summed per task before the shuffle; each pre-token meets the
    tokenizer once.
    """
    def count(batches):
        words, counts = PreTokens(file), Counter()
        for (texts,) in batches:
            for value in texts:
                if value:
                    counts.update(words.units(value))
                if len(counts) >= GATHERED:
                    yield from _pre_tokens(words, counts)
        yield from _pre_tokens(words, counts)

    def pieces(batches):
        words = PreTokens(file)
        for names, totals in batches:
            yield names, totals, words.pieces(names)

    totals = (map_columns(docs.select(F.col(f"`{text}`")), count, "pre_token string, n long",
                          read_rows=READ_ROWS)
              .groupBy("pre_token").agg(F.sum("n").alias("total")))
    return map_columns(totals, pieces, "pre_token string, total long, n_pieces long",
                       read_rows=4096)


def _most_frequent(table: DataFrame, most: int) -> DataFrame:
    """``pre_token, n_pieces`` above the lowest frequency that leaves at most ``most`` rows.

    A small histogram of frequencies gives that bound, so only the chosen rows travel.
    """
    step = F.floor(F.log2("total") * 8)
    chosen, lowest = 0, None
    for row in (table.groupBy(step.alias("step")).count().orderBy(F.desc("step"))).collect():
        chosen += row["count"]
        if chosen > most:
            break
        lowest = row["step"]
    kept = table.filter(step >= lowest) if lowest is not None else table.limit(0)
    return kept.select("pre_token", "n_pieces")


def _pre_tokens(words: PreTokens, units: Counter):
    """Batches of the pre-tokens of ``units``, which is empty afterwards."""
    totals, of_unit = {}, words.of_unit
    while units:  # each unit is given up once its pre-tokens are counted
        unit, n = units.popitem()
        for word in of_unit(unit):
            totals[word] = totals.get(word, 0) + n
    rows = iter(totals.items())
    while part := list(islice(rows, GIVEN_ROWS)):
        yield tuple(zip(*part))


def token_counts(docs: DataFrame, file: str = "word_bpe_49k.json", limit: int = 2048,
                 doc_id: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``.

    Piece counts of the ``head`` most frequent pre-tokens are known to every task (a bounded
    table), which also takes the hot keys out of the join; the frequencies of all others are
    joined by pre-token. A null text counts as empty (0 tokens); repeated rows each get a row,
    also without ``doc_id``; other columns are not looked at; an empty table gives none.
    """
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                       F.col(f"`{text}`").alias("text"))
    table = written(pre_token_table(docs, file), "pre-tokens")
    short = table.filter(F.length("pre_token") <= HEAD_CHARS)
    known = {r[0]: r[1] for r in _most_frequent(short, head).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def per_document(batches):
        words, pieces = PreTokens(file), shared.value

        def look_up(unit):
            """Pieces of held pre-tokens, with the others if there are any, or one other alone."""
            parts = words.of_unit(unit)
            if len(parts) == 1:
                return pieces.get(parts[0], parts[0])
            others = [p for p in parts if p not in pieces]
            value = sum(pieces.get(p, 0) for p in parts)
            return (value, others) if others else value

        units = Remembered(look_up, REMEMBERED)
        for ids, texts, keys in batches:
            n_bytes, n_tokens, rare, times = [], [], [], []
            for value in texts:
                total, counts = 0, {None: 0}  # the first entry is that of the document itself
                for found in map(units.__getitem__, words.units(value) if value else ()):
                    if type(found) is int:
                        total += found
                    elif type(found) is str:
                        counts[found] = counts.get(found, 0) + 1
                    else:
                        total += found[0]
                        for p in found[1]:
                            counts[p] = counts.get(p, 0) + 1
                n_bytes.append(len(value.encode()) if value else 0)
                n_tokens.append(total)
                rare.append(list(counts))
                times.append(list(counts.values()))
            yield ids, keys, n_bytes, n_tokens, rare, times

    rows = map_columns(docs.withColumn("key", F.xxhash64("text")), per_document,
                       "doc_id long, key long, n_bytes long, n_tokens long, "
                       "rare array<string>, times array<long>", read_rows=READ_ROWS)
    # A document's own row needs no partner; a name of its own keeps it off the hot null key.
    rows = rows.selectExpr("*", "posexplode(rare) AS (at, word)").selectExpr(
        "doc_id", "key", "IF(at = 0, n_bytes, 0) AS n_bytes", "IF(at = 0, n_tokens, 0) AS n_tokens",
        "IF(at = 0, 1, 0) AS copies", "IF(at = 0, NULL, times[at]) AS n",
        "IF(at = 0, concat(' ', CAST(key AS STRING)), word) AS pre_token")
    joined = rows.join(table.select("pre_token", "n_pieces"), "pre_token", "left")
    sums = joined.groupBy("doc_id", "key").agg(
        F.sum("copies").alias("copies"), F.sum("n_bytes").alias("n_bytes"),
        F.sum(F.col("n_tokens") + F.coalesce(F.col("n") * F.col("n_pieces"), F.lit(0)))
        .alias("n_tokens"))
    # Repeated rows met in one sum and part again.
    each = sums.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    n_tokens = F.expr("n_tokens div copies")
    return each.select("doc_id", F.expr("n_bytes div copies").alias("n_bytes"),
                       n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
