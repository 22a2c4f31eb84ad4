"""Nearest neighbours by inner product over sharded small-world graphs.

Vectors are dealt to shards of bounded size. Each shard has a hierarchical navigable
small-world graph in flat arrays: levels drawn at random, on every level each node linked to
diverse near nodes of that level and back. A search walks down the levels and widens to a beam
on the lowest; the results of the shards are merged. Inner products are turned into
distances by one extra component that gives all vectors of a shard the same length; vectors
are dealt by length first, so that this component stays small.
"""

import pickle

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seasonwise.llm.common import cut_lineage, map_rows, written
from seasonwise.llm.vectors import vectors

SHARD = 8192
# Lengths within a shard differ by this factor at most.
LENGTHS = 1.2
QUERY_BLOCK = 256


class Graph:
    """Flat neighbour arrays per level over the vectors of one shard."""

    def __init__(self, points: np.ndarray, links: int = 16, candidates: int = 48, seed: int = 5):
        self.points = points
        norms = (points ** 2).sum(axis=1)
        longest = float(norms.max(initial=0))
        scale = 1 / np.sqrt(longest) if longest else 1.0
        extra = np.sqrt(np.maximum(longest - norms, 0))
        self.flat = (np.column_stack([points, extra]) * scale).astype(np.float32)
        level = np.minimum(np.random.default_rng(seed).geometric(
            1 - 1 / links, len(points)) - 1, 8)
        self.members = [np.arange(len(points), dtype=np.int32)]
        while True:  # levels as long as they thin out; the top one is scanned
            above = np.flatnonzero(level >= len(self.members)).astype(np.int32)
            if len(above) < links or len(self.members[-1]) <= 2 * links:
                break
            self.members.append(above)
        self.neighbours = [self._link(members, 2 * links if k == 0 else links, candidates)
                           for k, members in enumerate(self.members)]
        # Place of a node within a level.
        self.place = []
        for members in self.members:
            place = np.full(len(points), -1, dtype=np.int32)
            place[members] = np.arange(len(members), dtype=np.int32)
            self.place.append(place)

    def _link(self, members: np.ndarray, most: int, candidates: int) -> np.ndarray:
        """Neighbours (node numbers, -1 where none) of each member, in a flat array."""
        own = self.flat[members]
        n, width = len(members), min(candidates, len(members) - 1)
        if width < 1:
            return np.full((n, 1), -1, dtype=np.int32)
        forward = []
        for at in range(0, n, 256):
            block = own[at:at + 256]
            near = block @ own.T
            near[np.arange(len(block)), np.arange(at, at + len(block))] = -np.inf
            best = np.argpartition(-near, width - 1, axis=1)[:, :width]
            score = np.take_along_axis(near, best, axis=1)
            order = np.argsort(-score, axis=1, kind="stable")
            best, score = np.take_along_axis(best, order, 1), np.take_along_axis(score, order, 1)
            # Diverse: nearer to the node than to any neighbour taken before.
            between = own[best] @ own[best].transpose(0, 2, 1)
            kept = np.zeros(best.shape, dtype=bool)
            for c in range(width):
                crowd = np.where(kept, between[:, c, :], -np.inf).max(axis=1)
                kept[:, c] = (crowd < score[:, c]) & (kept.sum(axis=1) < most)
            # Few diverse ones: the nearest of the others fill up half of the room.
            others = np.cumsum(~kept, axis=1)
            kept |= others <= np.maximum(0, most // 2 - kept.sum(axis=1))[:, None]
            rows, columns = np.nonzero(kept)
            forward.append((rows + at, best[rows, columns], score[rows, columns]))
        source, target, score = map(np.concatenate, zip(*forward))
        # Links go both ways; own links come first, then the nearest of the links back.
        first = np.concatenate([source, target])
        second = np.concatenate([target, source])
        back = np.repeat([0, 1], len(source))
        order = np.lexsort((-np.concatenate([score, score]), back, first))
        first, second = first[order], second[order]
        _, once = np.unique(first.astype(np.int64) * n + second, return_index=True)
        once.sort()
        first, second = first[once], second[once]
        rank = np.arange(len(first)) - np.searchsorted(first, first)
        cap = most + most // 2
        fits = rank < cap
        flat = np.full((n, cap), -1, dtype=np.int32)
        flat[first[fits], rank[fits]] = members[second[fits]]
        return flat

    def _beam(self, level: int, queries: np.ndarray, entry: np.ndarray, beam: int, step: int):
        """Best ``beam`` nodes of a level for each query: ids and scores, best first."""
        table, place = self.neighbours[level], self.place[level]
        n = len(queries)
        row = np.arange(n)[:, None]
        seen = np.zeros((n, len(self.points) + 1), dtype=bool)
        seen[row, entry] = True
        ids = np.full((n, beam), -1, dtype=np.int64)
        score = np.full((n, beam), -np.inf, dtype=np.float32)
        done = np.ones((n, beam), dtype=bool)
        width = min(beam, entry.shape[1])
        begin = np.einsum("nkd,nd->nk", self.flat[entry], queries)
        order = np.argsort(-begin, axis=1, kind="stable")[:, :width]
        ids[:, :width] = np.take_along_axis(entry, order, 1)
        score[:, :width] = np.take_along_axis(begin, order, 1)
        done[:, :width] = ids[:, :width] < 0
        active = np.arange(n)
        while len(active):
            a = active[:, None]
            rank = np.where(done[active], np.inf, np.arange(beam))
            pick = np.argpartition(rank, step - 1, axis=1)[:, :step] if step < beam else \
                np.broadcast_to(np.arange(beam), rank.shape)
            fresh = ~done[a, pick]
            nodes = np.where(fresh, ids[a, pick], -1)
            done[a, pick] = True
            found = np.where((nodes >= 0)[:, :, None], table[place[nodes]], -1).reshape(
                len(active), -1).astype(np.int64)
            found.sort(axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
            found[seen[a, found]] = -1
            seen[a, found] = True
            seen[:, -1] = False
            near = np.einsum("nkd,nd->nk", self.flat[found], queries[active])
            near[found < 0] = -np.inf
            every = np.concatenate([score[active], near], axis=1)
            order = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
            order = np.take_along_axis(order, np.argsort(
                -np.take_along_axis(every, order, 1), axis=1, kind="stable"), 1)
            score[active] = np.take_along_axis(every, order, 1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], found], 1), order, 1)
            done[active] = np.take_along_axis(np.concatenate(
                [done[active], found < 0], 1), order, 1)
            active = active[~done[active].all(axis=1)]
        return ids, score

    def search(self, queries: np.ndarray, beam: int, step: int = 4) -> np.ndarray:
        """Node numbers (-1 where fewer) near each query by inner product, best first."""
        lengths = np.linalg.norm(queries, axis=1, keepdims=True)
        flat = np.column_stack([queries / lengths, np.zeros(len(queries))]).astype(np.float32)
        top = self.members[-1].astype(np.int64)
        entry = np.broadcast_to(top, (len(flat), len(top)))
        for level in range(len(self.members) - 1, 0, -1):
            entry, _ = self._beam(level, flat, entry, 8, 2)
        ids, _ = self._beam(0, flat, entry, min(beam, len(self.points)), step)
        return ids


def _distinct(points: DataFrame, keep: int) -> DataFrame:
    """Distinct vectors with the ``keep`` smallest ids of their copies, ascending.

    Copies are cut down share by share first, so that no task gathers all of a large group.
    """
    shares = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.pmod(F.xxhash64("vec_id"), F.lit(shares))
    few = points.groupBy("embedding", share.alias("share")).agg(
        F.slice(F.array_sort(F.collect_set("vec_id")), 1, keep).alias("ids"))
    return few.groupBy("embedding").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(
        F.collect_list("ids")))), 1, keep).alias("ids"))


def build_index(table: DataFrame, k: int = 20, vec_id: str = "vec_id",
                embedding: str = "embedding", shard: int = SHARD) -> DataFrame:
    """One row per shard: ``size, length, shard, graph`` (vectors, ids and neighbour arrays).

    Every usable vector is in exactly one shard; copies of a vector are one node that knows
    its ``k`` + 1 smallest ids, enough for ``k`` answers without the query itself. Shards hold
    about ``shard`` nodes whatever the size of the table.
    """
    nodes = cut_lineage(_distinct(vectors(table, vec_id, embedding), k + 1))
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v)
    length = F.round(F.log(squares) / (2 * np.log(LENGTHS))).cast("int")
    nodes = nodes.withColumns({"size": F.size("embedding"), "length": length})
    total = nodes.groupBy("size", "length").agg(
        F.expr(f"(count(*) + {shard - 1}) div {shard}").alias("shards"))
    dealt = (nodes.join(total, ["size", "length"])
             .withColumn("shard", F.expr("pmod(xxhash64(ids[0]), shards)")))
    n = total.agg(F.sum("shards")).first()[0] or 1
    keys = ["size", "length", "shard"]
    rows = (dealt.select(*keys, "ids", "embedding").repartition(n, *keys)
            .sortWithinPartitions(*keys, "ids"))

    def build(batches):
        at, held = None, []
        for batch in batches:
            for size, span, number, ids, vector in zip(*batch):
                if (size, span, number) != at:
                    if held:
                        yield *at, _packed(held)
                    at, held = (size, span, number), []
                held.append((ids, vector))
        if held:
            yield *at, _packed(held)

    return map_rows(rows, build, "size int, length int, shard long, graph binary", batch_rows=1)


def _packed(held: list) -> bytes:
    graph = Graph(np.array([v for _, v in held]))
    return pickle.dumps(([ids for ids, _ in held], graph), protocol=5)


def search(index: DataFrame, queries: DataFrame, k: int = 20, beam: int = 128,
           vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query.

    Queries travel in blocks to every shard and are answered there; the answers of the shards
    are merged. A query's own id is no answer. Score: inner product in double precision on the
    original vectors; ties to the smaller ``vec_id``. Unusable queries have no answers; rows of
    one ``vec_id`` count as one vector each time they differ.
    """
    asked = vectors(queries, vec_id, embedding).distinct()
    n = index.count()
    parallel = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = max(1, min(8, parallel // max(1, n)))
    copy = F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
    none = F.lit(None)
    # Every shard is answered by `shares` tasks; each task holds one graph at a time.
    graphs = index.withColumn("share", copy).select(
        "size", "length", "shard", "share", "graph", none.cast("long").alias("vec_id"),
        none.cast("array<double>").alias("embedding"))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(shares)).cast("int").alias("share")
    asked = asked.withColumn("size", F.size("embedding")).join(
        F.broadcast(index.groupBy("size").agg(
            F.collect_list(F.struct("length", "shard")).alias("all"))), "size")
    asked = asked.select("size", F.explode("all").alias("to"), own, "vec_id", "embedding")
    asked = asked.select("size", "to.length", "to.shard", "share",
                         none.cast("binary").alias("graph"), "vec_id", "embedding")
    rows = (graphs.union(asked).repartition(max(1, n * shares), "size", "length", "shard", "share")
            .sortWithinPartitions("size", "length", "shard", "share", F.asc_nulls_first("vec_id")))

    def answer(batches):
        ids, graph, held = None, None, []
        for batch in batches:
            for _, _, _, _, data, query, vector in zip(*batch):
                if data is not None:
                    yield from _answers(ids, graph, held, k, beam)
                    held, (ids, graph) = [], pickle.loads(data)
                else:
                    held.append((query, vector))
                    if len(held) == QUERY_BLOCK:
                        yield from _answers(ids, graph, held, k, beam)
                        held = []
        yield from _answers(ids, graph, held, k, beam)

    found = map_rows(rows, answer, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _answers(ids, graph, held, k, beam):
    if not held:
        return
    asked = np.array([v for _, v in held])
    found = graph.search(asked, max(beam, k + 1))
    for (query, _), vector, nodes in zip(held, asked, found):
        nodes = nodes[nodes >= 0]
        scores = np.array([np.dot(vector, graph.points[node]) for node in nodes])
        rows = [(-s, i) for s, node in zip(scores.tolist(), nodes.tolist())
                for i in ids[node] if i != query]
        rows.sort()
        yield from ((query, i, -s) for s, i in rows[:k])


def nearest(table: DataFrame, every: int = 20, k: int = 20, vec_id: str = "vec_id",
            embedding: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows to each row whose id is divisible by ``every``, of all rows.

    Null, zero and non-finite vectors and rows without id take no part; other columns are not
    looked at; vectors of another length are no candidates; an empty table gives no rows.
    """
    table = table.select(F.col(f"`{vec_id}`").alias("vec_id"),
                         F.col(f"`{embedding}`").alias("embedding"))
    index = written(build_index(table, k), "graphs")
    return search(index, table.filter(F.col("vec_id") % every == 0), k)
