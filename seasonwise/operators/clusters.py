"""Clusters of products with similar monthly profiles.

Profiles are fitted on an integer grid by ``kmeans``, which gives the same clusters for any layout
of the data; clusters are numbered by their smallest product code. The number of clusters is the
one with the highest Euclidean silhouette, found by ``silhouette`` for any number of products.
"""

from functools import reduce
from operator import add

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seasonwise.functions.ranks import with_position
from seasonwise.operators import kmeans, silhouette
from seasonwise.operators.clean import attach_hierarchy
from seasonwise.operators.series import fill_gaps, product_totals
from seasonwise.schemas import HIERARCHY
from seasonwise.session import written

MONTHS = [f"m{month}" for month in range(1, 13)]
K_RANGE = range(3, 9)
MAX_ITERATIONS = 10
POINTS_PER_TASK = 4096


def product_months(sales: DataFrame) -> DataFrame:
    """Gap-filled months of every product: (product_code, month_start, month, turnover)."""
    totals = product_totals(sales.drop(*HIERARCHY))
    return fill_gaps(totals, "month_start", ["product_code"]).select(
        "product_code", "month_start", F.month("month_start").alias("month"), "turnover")


def monthly_profiles(months: DataFrame) -> DataFrame:
    """One row per product: mean turnover of each calendar month, 0 where there is none."""
    return months.groupBy("product_code").agg(*[
        F.coalesce(F.avg(F.when(F.col("month") == i, F.col("turnover"))), F.lit(0.0))
        .alias(name) for i, name in enumerate(MONTHS, start=1)])


def standardised_profiles(profiles: DataFrame) -> DataFrame:
    """Each product's twelve values as deviations from its mean in population deviations."""
    mean = reduce(add, [F.col(m) for m in MONTHS]) / len(MONTHS)
    centred = profiles.withColumn("_mean", mean).select(
        "product_code", *[(F.col(m) - F.col("_mean")).alias(m) for m in MONTHS])
    spread = F.sqrt(reduce(add, [F.col(m) * F.col(m) for m in MONTHS]) / len(MONTHS))
    return centred.withColumn("_std", spread).select("product_code", *[
        F.when(F.col("_std") == 0, F.lit(0.0)).otherwise(F.try_divide(m, "_std")).alias(m)
        for m in MONTHS])


class ProfileClusters:
    """Centres for each k, bounds of their silhouettes, and the points they were fitted on."""

    def __init__(self, points: DataFrame, fit: kmeans.Fit, bounds: dict, k_range):
        self.points, self.fit, self.bounds, self.k_range = points, fit, bounds, list(k_range)

    @property
    def best_k(self) -> int | None:
        """The k with the highest silhouette, the smallest one on ties; None if none has one.

        After ``fit_clusters`` that is the k of the plain silhouette of all pairs.
        """
        return silhouette.best(self.bounds)

    @property
    def certain(self) -> bool:
        """Whether the bounds leave no other k."""
        return silhouette.certain(self.bounds)

    def scores(self) -> DataFrame:
        """(k, silhouette, chosen); a k that could not be fitted has no silhouette.

        The silhouette is the middle of its bounds, which ``bounds`` holds; they are equal where
        several k had to be compared by all pairs.
        """
        best = self.best_k
        return self.points.sparkSession.createDataFrame(
            [(k, sum(self.bounds[k]) / 2 if k in self.bounds else None, k == best)
             for k in sorted(self.k_range)], "k int, silhouette double, chosen boolean")

    def centres(self, k: int) -> list[list[float]]:
        """Centres of standardised profiles, in the order of ``raw_labels``."""
        return [[v / kmeans.SCALE for v in c] for c in self.fit.centres[k]]

    def raw_labels(self, k: int) -> DataFrame:
        """(product_code, raw): number of the nearest centre, from 0."""
        return self.points.select(F.col("id").alias("product_code"),
                                  kmeans.nearest("x", self.fit.centres[k]).alias("raw"))

    def labels(self, k: int | None = None) -> DataFrame:
        """(product_code, cluster): the nearest centre of each product, numbered from 1.

        Without any fit (too few different profiles) all products are cluster 1.
        """
        k = k or self.best_k
        if k is None:
            return self.points.select(F.col("id").alias("product_code"),
                                      F.lit(1).alias("cluster"))
        return self.fit.labels(self.points, k).withColumnRenamed("id", "product_code")

    def all_labels(self) -> DataFrame:
        """(product_code, k, cluster) of every k that was fitted."""
        return self.fit.all_labels(self.points).withColumnRenamed("id", "product_code")

    def release(self) -> None:
        """Give points that were kept back; labels can still be computed, from the written points."""
        self.points.unpersist()


def tasks(points: int, cores: int) -> int:
    """A whole number of tasks a core, of at most about ``POINTS_PER_TASK`` points: none waits for
    the few tasks of a last round."""
    return cores * max(1, -(-points // (POINTS_PER_TASK * cores)))


def fit_clusters(profiles: DataFrame, k_range=K_RANGE, max_iterations: int = MAX_ITERATIONS,
                 keep: bool = False) -> ProfileClusters:
    """Fit every k and rate it by its Euclidean silhouette.

    Runs when called: a job per seed, iteration and level of the silhouette, each one pass over
    the profiles for all k, and one over all pairs of profiles for the k that its bounds do not
    rule out. They are written once to the shared folder, from where labels are read,
    too, and cached meanwhile, and with ``keep`` until ``release``. A k that is not below the number
    of products, or has not as many different profiles, is listed without a silhouette.
    """
    points = kmeans.grid_points(standardised_profiles(profiles), "product_code", MONTHS)
    # A few megabytes that are much work: they are dealt by number to all cores, not by their size.
    # The cores are known once a job has run, and all executors may not be there even then.
    points = written(points, "points")
    parts = tasks(points.count(), points.sparkSession.sparkContext.defaultParallelism)
    points = points.repartition(parts, "id").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fit = kmeans.fit(points, k_range, max_iterations)
        bounds = silhouette.rate(points, fit, silhouette.worthwhile(fit.n))
        bounds = silhouette.settled(points, fit, bounds)
    finally:
        if not keep:
            points.unpersist()
    return ProfileClusters(points, fit, bounds, k_range)


def _points(standardised: DataFrame) -> DataFrame:
    square = reduce(add, [F.col(m) * F.col(m) for m in MONTHS])
    return standardised.select("product_code", F.array(*MONTHS).alias("x"), square.alias("xx"))


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v)


def cluster_sums(standardised: DataFrame, labels: DataFrame) -> DataFrame:
    """``k, cluster, n, centre, spread`` of any labels ``product_code, k, cluster``.

    ``spread`` is the mean squared length; a few rows, whatever the number of products.
    """
    return (standardised.join(labels, "product_code").groupBy("k", "cluster").agg(
        F.count("*").alias("n"), F.array(*[F.avg(m) for m in MONTHS]).alias("centre"),
        F.avg(reduce(add, [F.col(m) * F.col(m) for m in MONTHS])).alias("spread")))


def silhouettes(standardised: DataFrame, labels: DataFrame) -> DataFrame:
    """Squared Euclidean silhouette of given labels, for every ``k`` at once: ``k, silhouette``.

    The mean squared distance of a point to a cluster follows from the cluster's centre and
    spread, so each point meets at most k rows. A single point in its cluster counts 0.
    """
    sums = cluster_sums(standardised, labels)
    every = sums.groupBy("k").agg(F.collect_list(F.struct("cluster", "n", "centre", "spread"))
                                  .alias("clusters"))
    points = _points(standardised).join(labels, "product_code").join(F.broadcast(every), "k")
    far = points.select("k", "product_code", F.col("cluster").alias("own"), "x", "xx",
                        F.explode("clusters").alias("c"))
    far = far.withColumn("centre", F.col("c.centre"))
    distance = F.greatest(F.lit(0.0), F.col("xx") + F.col("c.spread") - 2 * _dot("x", "centre"))
    inside = F.col("c.cluster") == F.col("own")
    rated = far.groupBy("k", "product_code").agg(
        F.max(F.when(inside, F.col("c.n"))).alias("n"),
        F.max(F.when(inside, distance)).alias("within"),
        F.min(F.when(~inside, distance)).alias("other"))
    own = F.col("within") * F.col("n") / (F.col("n") - 1)
    value = F.when(F.col("n") == 1, 0.0).otherwise(
        F.try_divide(F.col("other") - own, F.greatest("other", own)))
    return rated.withColumn("s", F.coalesce(F.when(F.col("n") > 1, value), F.lit(0.0))).groupBy(
        "k").agg(F.avg("s").alias("silhouette"))


def chosen_k(scores: DataFrame) -> DataFrame:
    """The k with the highest silhouette, the smallest one on ties."""
    return scores.agg(F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("k"))


def nearest_labels(standardised: DataFrame, labels: DataFrame) -> DataFrame:
    """One assignment to the nearest centre of given labels, numbered by smallest product.

    Centres of at most a few clusters are sent to every task; the earlier cluster wins a tie.
    """
    centres = (cluster_sums(standardised, labels.withColumn("k", F.lit(0)))
               .agg(F.sort_array(F.collect_list(F.struct("cluster", "centre"))).alias("cs")))
    far = _points(standardised).withColumn("cs", centres.scalar())
    far = far.select("product_code", "x", F.explode("cs").alias("c")).select(
        "product_code", "x", F.col("c.cluster").alias("raw"), F.col("c.centre").alias("centre"))
    gap = F.aggregate(F.zip_with("x", "centre", lambda p, q: (p - q) * (p - q)), F.lit(0.0),
                      lambda t, v: t + v)
    assigned = far.groupBy("product_code").agg(
        F.min_by("raw", F.struct(F.round(gap, 9), "raw")).alias("raw"))
    order = Window.partitionBy(F.lit(1)).orderBy("first")
    number = (assigned.groupBy("raw").agg(F.min("product_code").alias("first"))
              .withColumn("cluster", F.row_number().over(order)).select("raw", "cluster"))
    return assigned.join(F.broadcast(number), "raw").select("product_code", "cluster")


def cluster_table(labels: DataFrame, hierarchy: DataFrame,
                  rows: int | None = None) -> DataFrame:
    """Products with hierarchy and cluster by product code: all, or the first ``rows``."""
    table = (attach_hierarchy(labels, hierarchy)
             .select(*HIERARCHY, "product_code", "cluster").orderBy("product_code"))
    return table if rows is None else table.limit(rows)


def cluster_profiles(labels: DataFrame, months: DataFrame) -> DataFrame:
    """Mean turnover per cluster and calendar month, in original units."""
    return (months.join(labels, "product_code").groupBy("cluster", "month")
            .agg(F.avg("turnover").alias("mean_turnover")))


def cluster_members(labels: DataFrame, hierarchy: DataFrame, level: str) -> DataFrame:
    """Number of products of each group (or subgroup) inside each cluster, most first."""
    counted = (attach_hierarchy(labels, hierarchy).filter(F.col(level).isNotNull())
               .groupBy("cluster", level)
               .agg(F.count_distinct("product_code").alias("n_products")))
    return with_position(counted, ["cluster"], [-F.col("n_products"), F.col(f"`{level}`")]).orderBy(
        "cluster", "position")
