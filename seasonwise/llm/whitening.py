"""Whitening of embeddings by a weighted covariance of their distinct vectors.

Vectors are put on an integer grid, equal grid vectors are grouped, and the groups carry the
fit: each counts once, or as often as it occurs. One weighted, centred matrix product gives the
covariance, its eigenvectors the whitening, which is applied once per distinct vector and joined
back to the rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonwise.functions.joins import salted_join
from seasonwise.llm.common import written

# Grid values beyond this size count as this size, so that they stay longs.
WIDEST = 1 << 62
LONG = 1 << 63
# A component whose share of the largest eigenvalue is not above this has no direction of its own.
FLAT = 1e-11
# A vector with a larger share of all rows is spread in the join back; so there are few of them.
HOT_SHARE = 0.001


def grid(table: DataFrame, embedding: str = "embedding", scale: int = 64,
         offset: int = 1_000_000) -> DataFrame:
    """Rows of ``table`` with a usable vector and ``x array<long>``: floor(scale * c) + offset.

    Usable: not null, without null or non-finite entries; zeros are as good as others.
    """
    column = F.col(f"`{embedding}`")
    finite = F.coalesce(column.isNotNull() & F.forall(
        column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))

    def place(c):
        whole = F.floor(F.lit(float(scale)) * c.cast("double"))
        return F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), whole)) + F.lit(offset)

    return table.filter(finite).withColumn("x", F.transform(column, place))


def whiten(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
           components: int = 16, weights: str = "one", scale: int = 64,
           offset: int = 1_000_000) -> DataFrame:
    """Whitened coordinates of every row of ``table`` with a usable vector.

    ``weights`` says how often a distinct grid vector counts in the fit: ``one``, or ``count``
    for as often as it occurs. Result, one row per row and component: ``vec_id``, ``component``
    from 1 by falling variance, ``n`` (weight of the fit list), ``deviation`` (sum over
    dimensions of (n*x - S)^2, S being the weighted sums), ``whitened``, ``explained`` (share of
    the variance), ``identity_error`` (largest entry of the covariance of ``whitened`` over the
    fit list, minus the identity).

    Null vectors and those with null or non-finite entries give no rows; neither do vectors of
    length 0 or an empty table. Repeated rows and rows without id each have their own result.
    Vectors of different length are different spaces: each length has a fit of its own, and the
    driver holds one square matrix per length. Components without variance (one distinct vector,
    constant or dependent dimensions) have a null ``whitened`` and stay out of
    ``identity_error``; without any variance ``explained`` and ``identity_error`` are null. A
    deviation that is no long is null. Entries beyond 2^62 on the grid count as 2^62. Other
    columns are not looked at.
    """
    if weights not in ("one", "count"):
        raise ValueError(f"unknown weights: {weights}")
    rows = grid(table.select(F.col(f"`{vec_id}`").alias("vec_id"),
                             F.col(f"`{embedding}`").alias("embedding")),
                "embedding", scale, offset).filter(F.size("x") > 0)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x", *_keys("x"))
    distinct = written(rows.groupBy("x").agg(F.count(F.lit(1)).alias("count"))
                       .select("x", "count", *_keys("x")), "grid-vectors")
    weight = F.lit(1).cast("long") if weights == "one" else F.col("count")
    vectors = distinct.select("x", "k1", "k2", weight.alias("weight"))

    fits = {}
    for length, (n, total, widest) in _sums(vectors).items():
        fits[length] = {"n": n, "sums": total, "widest": widest}
    for length, scatter in _scatter(vectors, fits, _centred).items():
        fit = fits[length]
        values, directions = np.linalg.eigh(scatter / float(fit["n"]))
        order = np.argsort(-values, kind="stable")[:components]
        values, trace = values[order], float(np.trace(scatter)) / float(fit["n"])
        real = values > max(values[0], 0.0) * FLAT
        spread = np.sqrt(np.where(real, values, 1.0))
        fit["matrix"] = np.where(real, directions[:, order] / spread, 0.0)
        fit["explained"] = [float(v / trace) if trace > 0 else None
                            for v in np.maximum(values, 0.0)]
        fit["real"] = real

    places = written(_apply(vectors, fits), "whitened-vectors")
    spread = places.select(F.col("whitened").alias("x"), "weight", "length")
    for length, scatter in _scatter(spread, fits, _whitened, _means(spread, fits)).items():
        fit = fits[length]
        real = fit["real"]
        error = np.abs(scatter / float(fit["n"]) - np.eye(len(real)))[np.ix_(real, real)]
        fit["error"] = float(error.max()) if real.any() else None

    found = _join_back(rows.select("vec_id", "k1", "k2"), distinct, places)
    schema = ("length int, component int, explained double, identity_error double, real boolean,"
              " n long")
    facts = table.sparkSession.createDataFrame(
        [(length, i + 1, fit["explained"][i], fit["error"], bool(fit["real"][i]), fit["n"])
         for length, fit in fits.items() for i in range(len(fit["real"]))], schema)
    # At most ``components`` rows per length: as small as the fits the driver has just held.
    long = found.select("vec_id", "length", "deviation",
                        F.posexplode("whitened").alias("_i", "whitened"))
    long = long.withColumn("component", F.col("_i") + 1)
    return long.join(F.broadcast(facts), ["length", "component"]).select(
        "vec_id", "component", "n", "deviation",
        F.when(F.col("real"), F.col("whitened")).alias("whitened"), "explained",
        "identity_error")


def _keys(x: str) -> list:
    """128 bits that stand for a vector in the join back."""
    return [F.xxhash64(F.lit(1), x).alias("k1"), F.xxhash64(F.lit(2), x).alias("k2")]


def _join_back(rows: DataFrame, distinct: DataFrame, places: DataFrame) -> DataFrame:
    """Rows with the result of their vector; vectors that many rows share are spread.

    At most 1/``HOT_SHARE`` vectors can be that frequent, so their list is bounded and sent to
    all tasks. Rows of such a vector meet its copies by a hash of their id; rows that repeat both
    are left to the adaptive planner.
    """
    total = distinct.agg(F.sum("count").alias("n")).scalar()
    hot = F.broadcast(distinct.filter(F.col("count") > F.greatest(
        F.lit(1000.0), F.lit(HOT_SHARE) * total)).select("k1", "k2", F.lit(True).alias("hot")))
    tagged = rows.join(hot, ["k1", "k2"], "left").withColumn("hot", F.col("hot").isNotNull())
    marked = places.join(hot, ["k1", "k2"], "left").withColumn("hot", F.col("hot").isNotNull())
    columns = ["vec_id", "length", "deviation", "whitened"]
    usual = tagged.filter(~F.col("hot")).drop("hot").join(
        marked.filter(~F.col("hot")).drop("hot"), ["k1", "k2"]).select(columns)
    crowded = salted_join(tagged.filter("hot").drop("hot"), marked.filter("hot").drop("hot"),
                          ["k1", "k2"], salt_by=["vec_id"]).select(columns)
    return usual.unionByName(crowded)


def _blocks(batches: Iterator[pa.RecordBatch], dtype) -> Iterator[tuple]:
    """(length, matrix, batch of equal length) of each batch, by length of ``x``."""
    for batch in batches:
        column = batch.column("x")
        sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False))
        for length in np.unique(sizes):
            part = batch if len(sizes) == (sizes == length).sum() else batch.filter(
                pa.array(sizes == length))
            flat = np.asarray(part.column("x").flatten().to_numpy(zero_copy_only=False), dtype)
            yield int(length), flat.reshape(part.num_rows, int(length)), part


def _weights(part: pa.RecordBatch) -> np.ndarray:
    return np.asarray(part.column("weight").to_numpy(zero_copy_only=False), np.int64)


def _sums(vectors: DataFrame) -> dict[int, tuple]:
    """Per length: weight of the fit list, weighted sums as whole numbers, widest entry.

    Sums go through Spark in two halves of 32 bits, which cannot overflow a decimal.
    """
    def run(batches):
        for batch in batches:
            for length, x, part in _blocks([batch], np.int64):
                w = _weights(part)
                halves = [((x >> 32), w), ((x & 0xFFFFFFFF), w)]
                sums = [[int(v) for v in _exact_sums(h, w)] for h, _ in halves]
                widest = max(abs(int(x.max())), abs(int(x.min())))
                for i in range(length):
                    yield pa.RecordBatch.from_pylist([{
                        "length": length, "i": i, "n": int(w.sum()), "high": str(sums[0][i]),
                        "low": str(sums[1][i]), "widest": widest}], schema=arrow)

    arrow = pa.schema([("length", pa.int32()), ("i", pa.int32()), ("n", pa.int64()),
                       ("high", pa.string()), ("low", pa.string()), ("widest", pa.int64())])
    parts = vectors.select("x", "weight").mapInArrow(
        run, "length int, i int, n long, high string, low string, widest long")
    whole = parts.groupBy("length", "i").agg(
        F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"),
        F.sum(F.col("low").cast("decimal(38,0)")).alias("low"), F.max("widest").alias("widest"))
    found = {}
    for row in whole.orderBy("length", "i").collect():
        n, total, widest = found.get(row["length"], (0, [], 0))
        total.append((int(row["high"]) << 32) + int(row["low"]))
        found[row["length"]] = (row["n"], total, max(widest, row["widest"]))
    return found


def _exact_sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted column sums, in whole numbers of any size if longs could overflow."""
    bound = int(np.abs(x).max()) * int(w.max()) * len(w)
    return (w @ x) if bound < LONG else (w.astype(object) @ x.astype(object))


def _offsets(x: np.ndarray, fit: dict) -> np.ndarray:
    """n*x - S, exact: longs where they suffice, else whole numbers of any size."""
    if 2 * fit["n"] * fit["widest"] < LONG:
        return fit["n"] * x - np.array(fit["sums"], np.int64)
    return fit["n"] * x.astype(object) - np.array(fit["sums"], object)


def _centred(length: int, x: np.ndarray, fits: dict) -> np.ndarray:
    """x - S/n with one rounding: the difference is taken in whole numbers."""
    return _offsets(x, fits[length]).astype(np.float64) / float(fits[length]["n"])


def _whitened(length: int, x: np.ndarray, fits: dict) -> np.ndarray:
    return x


def _scatter(vectors: DataFrame, fits: dict, centre, means: dict | None = None) -> dict:
    """Per length of the original vectors the weighted sum of products of centred vectors.

    Tasks send one row of the matrix per dimension; these meet in one sum per row.
    """
    own = "length" in vectors.columns

    def run(batches):
        sums = {}
        for batch in batches:
            for width, x, part in _blocks([batch], np.float64 if own else np.int64):
                lengths = (np.asarray(part.column("length").to_numpy(zero_copy_only=False))
                           if own else np.full(len(x), width))
                w = _weights(part).astype(np.float64)
                for length in np.unique(lengths):
                    chosen = lengths == length
                    c = centre(int(length), x[chosen], fits)
                    if means is not None:
                        c = c - means[int(length)]
                    sums[int(length)] = sums.get(int(length), 0.0) + (c * w[chosen, None]).T @ c
        for length, matrix in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(matrix), length, np.int32)),
                 pa.array(np.arange(len(matrix), dtype=np.int32)),
                 pa.array(list(matrix), pa.list_(pa.float64()))], ["length", "i", "row"])

    kept = ["x", "weight", *(["length"] if own else [])]
    parts = vectors.select(*kept).mapInArrow(run, "length int, i int, row array<double>")
    cells = parts.select("length", "i", F.posexplode("row").alias("j", "v"))
    sums = cells.groupBy("length", "i", "j").agg(F.sum("v").alias("v"))
    matrices = {}
    for row in (sums.groupBy("length", "i")
                .agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("r")).collect()):
        width = len(row["r"])
        matrix = matrices.setdefault(row["length"], np.zeros((width, width)))
        matrix[row["i"]] = [cell["v"] for cell in row["r"]]
    return {length: (m + m.T) / 2 for length, m in matrices.items()}


def _means(places: DataFrame, fits: dict) -> dict[int, np.ndarray]:
    """Weighted means of the whitened coordinates, which are 0 but for rounding."""
    cells = places.select("length", "weight", F.posexplode("x").alias("j", "v"))
    found = {}
    for row in cells.groupBy("length", "j").agg(
            F.sum(F.col("v") * F.col("weight")).alias("v")).collect():
        fit = fits[row["length"]]
        mean = found.setdefault(row["length"], np.zeros(len(fit["real"])))
        mean[row["j"]] = row["v"] / float(fit["n"])
    return found


def _apply(vectors: DataFrame, fits: dict) -> DataFrame:
    """``k1, k2, weight, length, deviation, whitened`` of each distinct vector."""
    def run(batches):
        for batch in batches:
            for length, x, part in _blocks([batch], np.int64):
                fit = fits[length]
                gaps = _offsets(x, fit)
                places = (gaps.astype(np.float64) / float(fit["n"])) @ fit["matrix"]
                yield pa.RecordBatch.from_arrays(
                    [part.column("k1"), part.column("k2"), part.column("weight"),
                     pa.array(np.full(len(x), length, np.int32)), _squares(gaps),
                     pa.array(list(places), pa.list_(pa.float64()))],
                    ["k1", "k2", "weight", "length", "deviation", "whitened"])

    return vectors.mapInArrow(
        run, "k1 long, k2 long, weight long, length int, deviation long, whitened array<double>")


def _squares(gaps: np.ndarray) -> pa.Array:
    """Exact sums of squares per row; null where they are no long."""
    if gaps.dtype != object:
        peak = max(abs(int(gaps.max())), abs(int(gaps.min())))
        if peak * peak * gaps.shape[1] < LONG:
            return pa.array((gaps * gaps).sum(axis=1), pa.int64())
        gaps = gaps.astype(object)
    sums = (gaps * gaps).sum(axis=1)
    return pa.array([int(s) if s < LONG else None for s in sums], pa.int64())
