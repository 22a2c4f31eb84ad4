"""Near-duplicate documents by MinHash bands, odd sketches and exact word shingles.

Copies (equal shingle sets) collapse into classes first. Classes that share a band of MinHash
samples are candidates; their parity bitmaps, compared by an exclusive or and a population
count, turn away pairs that are far from the threshold; the rest is confirmed on full sets.
Groups stay cheap because each class is first compared with the smallest class of its bands;
then the members of a band that hang together in different components are compared in blocks,
nearest first, skipping pairs that meanwhile belong together. So the components are those of
all links, while links inside a component need not all be looked at, and no pair is emitted
unless it joins two components.
"""

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonwise.llm.common import cut_lineage, map_rows, written
from seasonwise.llm.components import components
from seasonwise.llm.shingles import Sketcher, most_odd_bits, shingle_set

BANDS, ROWS, BITS = 20, 4, 256
# Classes of a band that one task compares with as many others at a time.
BLOCK = 512


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, text_key, n_shingles, set_key, keys, parity`` of every document."""
    def run(batches):
        sketcher = Sketcher(BANDS, ROWS, BITS)
        for ids, texts, text_keys in batches:
            for i, text, text_key in zip(ids, texts, text_keys):
                shingles = shingle_set(text, width)
                if len(shingles):
                    keys, parity = sketcher.sketch(shingles)
                    yield (i, text_key, len(shingles),
                           xxhash.xxh3_128_digest(shingles.tobytes()), keys, parity)
                else:
                    yield i, text_key, 0, None, None, None

    return map_rows(docs.withColumn("text_key", F.xxhash64("text")), run,
                    "doc_id long, text_key long, n_shingles long, set_key binary, "
                    "keys array<long>, parity array<long>", batch_rows=1024)


def _odd_bits(a: str, b: str):
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(1, BITS // 64)),
               F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))


def _groups(batches: Iterator[list], keys: int) -> Iterator[tuple]:
    """Runs of rows with equal first ``keys`` columns, of a sorted partition."""
    held, at = [], None
    for batch in batches:
        for row in zip(*batch):
            if row[:keys] != at:
                if held:
                    yield at, held
                held, at = [], row[:keys]
            held.append(row[keys:])
    if held:
        yield at, held


def _cells(crowd: DataFrame, found: DataFrame) -> DataFrame:
    """Members of bands that hold several components, dealt to the cells of their comparison.

    The largest component of a band is passive: its members are compared with the others, not
    with each other. ``band, passive, i, j, own, role, rep, component``.
    """
    joined = crowd.select("band", "rep").join(
        found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "band", "rep", F.coalesce("component", "rep").alias("component"))
    sizes = joined.groupBy("band", "component").agg(F.count("*").alias("n"))
    bands = sizes.groupBy("band").agg(F.max(F.struct("n", "component")).alias("most"),
                                      F.sum("n").alias("n")).filter("most.n < n")
    bands = bands.select("band", F.col("most.component").alias("main"), F.expr(
        f"(n - most.n + {BLOCK - 1}) div {BLOCK}").alias("active"), F.expr(
        f"(most.n + {BLOCK - 1}) div {BLOCK}").alias("rest"))
    rows = joined.join(bands, "band").withColumn("role", F.expr("int(component = main)"))
    rows = rows.withColumn("own", F.expr(
        "pmod(xxhash64(rep), if(role = 0, active, rest))"))
    cells = F.expr("""if(role = 1,
        transform(sequence(0, active - 1), k -> named_struct('passive', 1, 'i', k, 'j', own)),
        concat(transform(sequence(0, rest - 1), k -> named_struct('passive', 1, 'i', own, 'j', k)),
               transform(sequence(0, active - 1), k -> named_struct('passive', 0,
                         'i', least(own, k), 'j', greatest(own, k)))))""")
    return rows.select("band", F.explode(cells).alias("cell"), "own", "role", "rep", "component"
                       ).select("band", "cell.passive", "cell.i", "cell.j", "own", "role", "rep",
                                "component")


def join_components(cells: DataFrame, classes: DataFrame, texts: DataFrame, width: int,
                    percent: int, limit: int) -> DataFrame:
    """Links ``a, b`` that join the components of a band: a spanning set of them per cell."""
    described = cells.join(classes.select("rep", "keys", "parity"), "rep").join(texts, "rep")
    order = ["band", "passive", "i", "j", "rep"]
    rows = (described.select("band", "passive", "i", "j", "own", "role", "rep", "component", "keys",
                             "parity", "text").repartition(*order[:4])
            .sortWithinPartitions(*order))

    def run(batches):
        for (band, passive, i, j), members in _groups(batches, 4):
            own, role, reps, component, keys, parity, text = zip(*members)
            own, role, component = np.array(own), np.array(role), np.array(component)
            left = np.flatnonzero((role == 0) & (own == i))
            right = np.flatnonzero((role == 1) if passive else (role == 0) & (own == j))
            if not len(left) or not len(right):
                continue
            sketch = np.array(parity, dtype=np.int64).view(np.uint64)
            odd = np.bitwise_count(sketch[left, None] ^ sketch[None, right]).sum(
                axis=2, dtype=np.int64)
            odd[component[left, None] == component[None, right]] = BITS + 1
            x, y = np.nonzero(odd <= limit)
            near = np.argsort(odd[x, y], kind="stable")
            x, y = left[x[near]], right[y[near]]
            # A pair is looked at in the first band that it shares.
            keys = np.array(keys)
            first = (keys[x] == keys[y]).argmax(axis=1)
            mine = keys[x, first] == band
            group = {c: c for c in component.tolist()}

            def root(c):
                while group[c] != c:
                    group[c] = group[group[c]]
                    c = group[c]
                return c

            sets = {}
            for a, b in zip(x[mine].tolist(), y[mine].tolist()):
                one, other = root(int(component[a])), root(int(component[b]))
                if one == other:
                    continue
                for k in (a, b):
                    if k not in sets:
                        sets[k] = shingle_set(text[k], width)
                if _similar(sets[a], sets[b], percent):
                    group[one] = other
                    yield reps[a], reps[b]

    return map_rows(rows, run, "a long, b long")


def _similar(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(one), len(other)))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * both >= percent * (small + large - both)


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets meet the threshold.

    ``texts``: ``rep, text``. The texts of a pair's larger side travel to the smaller one,
    whose text is repeated over a few shares, so that one text with many partners does not
    fill one task.
    """
    shares = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.pmod(F.xxhash64("b"), F.lit(shares)).cast("int").alias("share")
    members = pairs.select(F.col("b").alias("rep"), F.col("a").alias("key"), share,
                           F.lit(1).alias("role"))
    centres = pairs.select(F.col("a").alias("rep"), F.col("a").alias("key"), share,
                           F.lit(0).alias("role")).distinct()
    roles = members.union(centres).join(texts, "rep")
    rows = (roles.select("key", "share", "role", "rep", "text")
            .repartition("key", "share").sortWithinPartitions("key", "share", "role", "rep"))

    def run(batches):
        at, centre = None, None
        for batch in batches:
            for key, part, role, rep, text in zip(*batch):
                shingles = shingle_set(text, width)
                if role == 0:
                    at, centre = (key, part), shingles
                elif at == (key, part):
                    if _similar(centre, shingles, percent):
                        yield key, rep

    return map_rows(rows, run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked if their sets of ``width``-word shingles have a Jaccard similarity of
    at least ``percent`` hundredths. ``component_id`` is the smallest ``doc_id`` that links
    reach, itself included; ``kept`` marks that document. Documents without words (null, empty,
    white space) have no shingles and link with nothing. Rows without ``doc_id`` take no part:
    their component is null and they are kept. Repeated rows each get a row; rows of one
    ``doc_id`` count as one document. Other columns are not looked at; an empty table gives
    no rows.
    """
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                       F.col(f"`{text}`").alias("text"))
    rows = written(sketches(docs, width), "sketches")
    usable = rows.filter("doc_id IS NOT NULL AND n_shingles > 0")
    # Equal sets have equal sketches, so any of them will do.
    classes = usable.groupBy("set_key").agg(
        F.min(F.struct("doc_id", "text_key")).alias("m"), F.first("keys").alias("keys"),
        F.first("parity").alias("parity"))
    classes = cut_lineage(classes.select("set_key", F.col("m.doc_id").alias("rep"),
                                         F.col("m.text_key").alias("text_key"), "keys", "parity"))
    limit = most_odd_bits(BANDS * ROWS, BITS, percent / 100)
    banded = classes.select(F.explode("keys").alias("band"), "rep", "parity")
    shared = (classes.select(F.explode("keys").alias("band"), "rep").groupBy("band")
              .agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).filter("centre <> last"))
    crowd = cut_lineage(banded.join(shared, "band").select("band", "rep", "parity", "centre"))
    wanted = crowd.select("rep").distinct().join(classes.select("rep", "text_key"), "rep")
    texts = written(
        docs.withColumn("text_key", F.xxhash64("text"))
        .join(wanted.withColumnRenamed("rep", "doc_id"), ["doc_id", "text_key"])
        .groupBy("doc_id").agg(F.min("text").alias("text"))
        .withColumnRenamed("doc_id", "rep"), "texts")

    # First round: every class with the nearest of its bands' smallest classes.
    centres = classes.select(F.col("rep").alias("centre"), F.col("parity").alias("other"))
    stars = (crowd.filter("rep <> centre").select("rep", "parity", "centre")
             .dropDuplicates(["rep", "centre"]).join(centres, "centre")
             .withColumn("odd", _odd_bits("parity", "other")).filter(F.col("odd") <= limit))
    first = stars.groupBy("rep").agg(F.min(F.struct("odd", "centre")).alias("m"))
    pairs = first.select(F.col("m.centre").alias("a"), F.col("rep").alias("b"))
    links = cut_lineage(confirm(pairs, texts, width, percent))
    cells = _cells(crowd, components(links))
    links = cut_lineage(links.union(join_components(cells, classes, texts, width, percent, limit)))
    found = components(links).withColumnRenamed("node", "rep")
    named = classes.select("set_key", "rep").join(found, "rep", "left").select(
        "set_key", F.coalesce("component", "rep").alias("component_id"))
    # Sets of documents that stand alone share no key; a key of their own keeps them apart.
    own = F.coalesce("set_key", F.concat(F.lit("own "), F.coalesce(
        "doc_id", F.lit(0)).cast("string")).cast("binary"))
    final = rows.select("doc_id", "n_shingles", own.alias("set_key")).join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return final.select("doc_id", "n_shingles", component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
