"""Clusters of vectors: assignment, quotas, affinities, and how many there should be.

Centroids are few (k of them, of d components). They reach the workers as one broadcast matrix whose size is
checked; beyond ``LARGEST_MATRIX`` bytes it is sent in slices, each a pass of its own over the vectors' batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vector as V

LARGEST_MATRIX = 256 << 20

# Seeds of the sampler's and the elbow search's clustering, its iterations, and the numbers of clusters tried.
SAMPLER_SEED, ELBOW_SEED, ITERATIONS = 420, 560, 100
ELBOW_KS = (5, 10, 50, 100, 500, 1000, 5000, 10000)
# Fixed value: sensitivity of the knee.
SENSITIVITY = 0.01


def mean_vectors(vectors: DataFrame, key: str, column: str = "embedding", digits: int | None = None) -> DataFrame:
    """(cluster, centroid): the mean vector of each key."""
    mean = F.avg(F.col("x").cast("double"))
    parts = vectors.select(F.col(key).alias("cluster"), F.posexplode(column).alias("pos", "x")).groupBy("cluster", "pos").agg((mean if digits is None else F.round(mean, digits)).alias("x"))
    return parts.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p")).select("cluster", F.col("p.x").alias("centroid"))


def _matrix(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = centroids.orderBy("cluster").collect()
    return np.array([r["cluster"] for r in rows], np.int64), np.array([r["centroid"] for r in rows], float)


def _slices(spark: SparkSession, centroids: DataFrame):
    ids, matrix = _matrix(centroids)
    step = max(1, LARGEST_MATRIX // max(1, 8 * matrix.shape[-1] if matrix.size else 8))
    return [spark.sparkContext.broadcast((ids[i : i + step], matrix[i : i + step])) for i in range(0, len(ids), step)]


def _batch_vectors(batch: pa.RecordBatch, length: int) -> np.ndarray:
    """The batch's vectors as a matrix; an error if one has another length."""
    vec = batch.column("vec")
    if vec.null_count or len(batch) and (np.asarray(vec.value_lengths()) != length).any():
        raise ValueError(f"a vector that has not {length} components")
    return np.asarray(vec.flatten()).reshape(batch.num_rows, length)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(c)))
    step = max(1, (1 << 22) // max(1, c.shape[0]))
    for lo in range(0, len(x), step):
        part = x[lo : lo + step]
        out[lo : lo + step] = (part * part).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * part @ c.T
    return out


def assigned(vectors: DataFrame, centroids: DataFrame, column: str = "embedding", carry: bool = False) -> DataFrame:
    """(docid, cluster, distance): the nearest centroid of every vector by L2, ties to the smaller cluster. carry: and ``vec``, the vector.

    Vectors null, or with null or non-finite components, take no part; one of another length than the centroids is an
    error. Without centroids: cluster -1.
    """
    parts = _slices(vectors.sparkSession, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _batch_vectors(batch, parts[0].value[1].shape[1]) if parts else np.zeros((batch.num_rows, 0))
            best, cluster = np.full(len(x), np.inf), np.full(len(x), -1, np.int64)
            for part in parts:
                ids, c = part.value
                d = _distances(x, c)
                at = d.argmin(1) if len(x) else np.zeros(0, int)
                near = ((x - c[at]) ** 2).sum(1)  # again, without cancellation
                closer = near < best
                best, cluster = np.where(closer, near, best), np.where(closer, ids[at], cluster)
            more = [batch.column("vec")] if carry else []
            yield pa.record_batch([batch.column("docid"), pa.array(cluster), pa.array(best), *more], names=["docid", "cluster", "distance", "vec"][: 3 + len(more)])

    return V.usable(vectors, column).select("docid", V.doubles(F.col(column)).alias("vec")).mapInArrow(run, "docid string, cluster long, distance double" + ", vec array<double>" * carry)


def nearest_documents(vectors: DataFrame, centroids: DataFrame, column: str = "embedding") -> DataFrame:
    """(cluster, docid, distance): of every centroid the nearest vector of the whole corpus, ties to the smaller id.

    A batch sends one row for each centroid; the rest is an aggregate. Rows without an id, and vectors as in
    ``assigned``, take no part.
    """
    parts = _slices(vectors.sparkSession, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not parts:
                continue
            x, names = _batch_vectors(batch, parts[0].value[1].shape[1]), np.array(batch.column("docid").to_pylist(), object)
            order = np.argsort(names, kind="stable")
            x, names = x[order], names[order]
            for part in parts:
                ids, c = part.value
                at = _distances(x, c).argmin(0)
                yield pa.record_batch([pa.array(ids), pa.array(names[at].tolist(), pa.string()), pa.array(((x[at] - c) ** 2).sum(1))], names=["cluster", "docid", "distance"])

    near = V.usable(vectors, column).where(F.col("docid").isNotNull()).select("docid", V.doubles(F.col(column)).alias("vec")).mapInArrow(run, "cluster long, docid string, distance double")
    return near.groupBy("cluster").agg(F.min(F.struct("distance", "docid")).alias("n")).select("cluster", "n.docid", "n.distance")


def sizes(assignment: DataFrame, ordinal: str) -> DataFrame:
    """(cluster, size, first_seen)."""
    return assignment.groupBy("cluster").agg(F.count("*").alias("size"), F.min(ordinal).alias("first_seen"))


def quotas(cluster_sizes: DataFrame, n_train: int, compat: bool = False) -> DataFrame:
    """(cluster, size, quota): how many documents to draw from each cluster.

    One each, and the rest by size, rounded down; what rounding leaves goes to the largest clusters, one each. A
    quota never exceeds its cluster. compat: an empty rest gives every cluster one more, as the original slip did.
    """
    totals = cluster_sizes.agg(F.count("*").alias("_k"), F.sum("size").alias("_n"))
    k, n = totals.first()
    if n_train < (k or 0):
        raise ValueError(f"{n_train} documents for {k} clusters")
    base = cluster_sizes.withColumn("quota", (1 + F.floor(F.lit(n_train - (k or 0)) * F.col("size") / F.lit(n or 1))).cast("long"))
    # one row a cluster: clusters are as few as their centroids
    w = W.orderBy(F.desc("size"), F.desc("first_seen"))
    ranked = base.withColumns({"_place": F.row_number().over(w), "_rest": F.lit(n_train) - F.sum("quota").over(W.partitionBy(F.lit(1)))})
    bonus = (F.col("_place") <= F.col("_rest")).cast("long") if n_train != k else F.lit(0)
    if compat and n_train != k:
        bonus = F.when(F.col("_rest") == 0, 1).otherwise(bonus)
    return ranked.select("cluster", "size", F.least(F.col("quota") + bonus, F.col("size")).alias("quota"))


def _few(centroids: DataFrame) -> DataFrame:
    """``centroids``, broadcast if the matrix is within ``LARGEST_MATRIX`` bytes; else the join is left to the planner."""
    numbers = centroids.agg(F.coalesce(F.sum(F.size("centroid")), F.lit(0))).first()[0]
    return F.broadcast(centroids) if 8 * numbers <= LARGEST_MATRIX else centroids


def affinities(assignment: DataFrame, vectors: DataFrame, centroids: DataFrame, column: str = "embedding") -> DataFrame:
    """(cluster, docid, cos): every vector's cosine to its own centroid."""
    own = assignment.select("docid", "cluster").join(vectors.select("docid", F.col(column).alias("_v")), "docid").join(_few(centroids), "cluster")
    return own.select("cluster", "docid", V.cosine(F.col("_v"), F.col("centroid")).alias("cos"))


def softmax(affinity: DataFrame, temperature: float = 1.0) -> DataFrame:
    """(cluster, docid, p): shares that sum to 1 in a cluster. Sums are joined back: no cluster is one task's window."""
    weighted = affinity.withColumn("_w", F.exp(F.col("cos") / F.lit(temperature)))
    total = weighted.groupBy("cluster").agg(F.sum("_w").alias("_total"))
    return weighted.join(total, "cluster").select("cluster", "docid", (F.col("_w") / F.col("_total")).alias("p"))


def cosine_sse(affinity: DataFrame) -> DataFrame:
    """(sse): sum of squared cosine distances to the own centroid."""
    return affinity.agg(F.sum(F.pow(1 - F.col("cos"), 2)).alias("sse"))


def fit_centroids(vectors: DataFrame, k: int, seed: int = SAMPLER_SEED, iterations: int = ITERATIONS, column: str = "embedding") -> DataFrame:
    """(cluster, centroid) by k-means; vectors are cached while it iterates."""
    points = V.usable(vectors, column).select(array_to_vector(V.doubles(F.col(column))).alias("features")).cache()
    try:
        model = KMeans(k=k, maxIter=iterations, tol=0.0, seed=seed).fit(points)
    finally:
        points.unpersist()
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "cluster long, centroid array<double>")


def elbow_curve(vectors: DataFrame, ks: tuple[int, ...] = ELBOW_KS, seed: int = ELBOW_SEED, iterations: int = ITERATIONS, save=None, key: str = "docid", column: str = "embedding") -> DataFrame:
    """(k, sse) for each k that the vectors can fill: the sum of squared cosine distances to the own centroid.

    All ks start from the vectors whose keys have the least hash, and share the scans of ``kmeans.lloyd``; the vectors are dealt
    out evenly, to each core a part at least, and cached meanwhile. save: called with the curve so far after each k, in the order of ks.
    """
    from . import kmeans

    spark = vectors.sparkSession
    points = V.usable(vectors, column).select(V.doubles(F.col(column)).alias("vec"))
    points = points.repartition(max(spark.sparkContext.defaultParallelism, points.rdd.getNumPartitions())).cache()  # a file's only row group is one task
    try:
        n = points.count()
        ks = tuple(k for k in ks if k <= n)
        begin = kmeans.starts(vectors, max(ks, default=0), seed, key, column)
        fits = kmeans.lloyd(points, [kmeans.Problem(begin[:k]) for k in ks], iterations) if ks else []
    finally:
        points.unpersist()
    curve = [(k, f.cosine_sse) for k, f in zip(ks, fits, strict=True)]
    for i in range(len(curve) if save else 0):
        save(spark.createDataFrame(curve[: i + 1], "k int, sse double"))
    return spark.createDataFrame(curve, "k int, sse double")


def knee(curve: DataFrame, sensitivity: float = SENSITIVITY) -> DataFrame:
    """(knee): the k where a falling convex curve bends, null if it nowhere does.

    Both axes to [0, 1], the curve flipped, and its height over the diagonal: a local maximum is the knee if the
    height falls below the maximum's threshold before it rises to another one.
    """
    w, every = W.orderBy("k"), W.partitionBy(F.lit(1))  # a curve has as many rows as there are ks
    scaled = lambda c: (F.col(c) - F.min(c).over(every)) / (F.max(c).over(every) - F.min(c).over(every))
    height = curve.select("k", scaled("k").alias("x"), scaled("sse").alias("y")).select("k", "x", (1 - F.col("y") - F.col("x")).alias("d"))
    near = height.select("k", "x", "d", F.lag("d").over(w).alias("before"), F.lead("d").over(w).alias("after"), F.count("*").over(every).alias("n"))
    top = (F.col("d") >= F.col("before")) & (F.col("d") >= F.col("after")) & ((F.col("d") > F.col("before")) | (F.col("d") > F.col("after")))
    # the mean step of an axis scaled to [0, 1] is one over the number of steps
    marked = near.select("k", "d", F.when(top, F.col("k")).alias("top"), F.when(top, F.col("d") - F.lit(sensitivity) / (F.col("n") - 1)).alias("least"))
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    last = marked.select("k", "d", F.last("top", True).over(upto).alias("top"), F.last("least", True).over(upto).alias("least"))
    return last.where(F.col("d") < F.col("least")).agg(F.min("top").alias("knee"))
