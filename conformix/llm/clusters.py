"""Centroid clustering of integer vectors by equal-average equal-variance search with an exact integer finish."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conformix.llm.common import materialise

#: Components of a vector, factor before they become integers, clusters, rounds, and the salt of the starting choice.
DIM, SCALE, CLUSTERS, ROUNDS, SALT = 64, 256, 40, 5, "2"
#: Integer components stay below this, so that 64 squared differences fit 64 bits.
LARGEST = 1 << 26
#: Vectors that are compared at once.
BLOCK = 4096
_SLACK = 1e-9


def _deviation(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return np.linalg.norm(x - mean[:, None], axis=1)


class Codebook:
    """Centroids in order of their component mean.

    For vectors of d components with means m and deviations v (norm of the vector less its mean),
    distance >= d * (m - m')**2 + (v - v')**2. The scan goes outward from a vector's own mean, so the first centroid whose
    mean alone rules it out ends it; others are ruled out by both terms. Both tests carry a slack above the error of
    doubles, and what they leave is compared by its exact integer distance, ties going to the smaller number.
    """

    def __init__(self, centroids: np.ndarray):
        means = centroids.sum(axis=1) / centroids.shape[1]
        self.number = np.argsort(means, kind="stable")
        self.rows, self.means = centroids[self.number], means[self.number]
        self.deviations = _deviation(self.rows, self.means)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of each row's nearest centroid, and how many distances were computed."""
        n, k, dim = len(x), len(self.rows), x.shape[1]
        means = x.sum(axis=1) / dim
        deviations = _deviation(x, means)
        best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
        right = np.searchsorted(self.means, means)
        left, live, computed = right - 1, np.arange(n), 0
        while len(live):
            lo, hi, m = left[live], right[live], means[live]
            below = np.where(lo >= 0, m - self.means[np.maximum(lo, 0)], np.inf)
            above = np.where(hi < k, self.means[np.minimum(hi, k - 1)] - m, np.inf)
            down, gap = below <= above, np.minimum(below, above)
            gap = np.maximum(gap - _SLACK * (np.abs(m) + 1), 0)
            bound = dim * gap * gap * (1 - _SLACK)
            open_ = bound <= best[live]
            live, down, bound = live[open_], down[open_], bound[open_]
            at = np.where(down, left[live], right[live])
            left[live] -= down
            right[live] += ~down
            spread = np.abs(deviations[live] - self.deviations[at])
            spread = np.maximum(spread - _SLACK * (deviations[live] + self.deviations[at] + np.abs(means[live]) + 1), 0)
            near = bound + spread * spread * (1 - _SLACK) <= best[live]
            i, c = live[near], at[near]
            distance, number = ((x[i] - self.rows[c]) ** 2).sum(axis=1), self.number[c]
            better = (distance < best[i]) | ((distance == best[i]) & (number < who[i]))
            best[i[better]], who[i[better]] = distance[better], number[better]
            computed += len(i)
        return who, best, computed


def _blocks(column: pa.ChunkedArray | pa.Array, dim: int):
    """(place, matrix) of the integer vectors of an Arrow column, some at a time."""
    for start in range(0, len(column), BLOCK):
        part = column.slice(start, BLOCK)
        x = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), dim)
        if len(x) and np.abs(x).max() >= LARGEST:
            raise ValueError(f"integer components have to be below {LARGEST}, else squared distances exceed 64 bits")
        yield start, x


def integer_vectors(df: DataFrame, dim: int = DIM, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x) of rows whose vector has exactly `dim` components, none null or non-finite; x is floor(scale * component)."""
    v = F.col(vector).cast("array<double>")
    good = (F.size(v) == dim) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(F.coalesce(good, F.lit(False))).select(F.col(key).alias("id"), F.transform(v, lambda c: F.floor(c * float(scale))).alias("x"))


def _partial(centroids: np.ndarray):
    """Task function: count and component sums of each cluster over the task's vectors, one row a cluster."""
    k, dim = centroids.shape

    def run(batches):
        book, counts, sums = Codebook(centroids), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            for _, x in _blocks(b.column(0), dim):
                who, _, _ = book.nearest(x)
                order = np.argsort(who, kind="stable")
                found, first = np.unique(who[order], return_index=True)
                counts += np.bincount(who, minlength=k)
                sums[found] += np.add.reduceat(x[order], first, axis=0)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at]), pa.array(list(sums[at]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _assign(centroids: np.ndarray):
    def run(batches):
        book, dim = Codebook(centroids), centroids.shape[1]
        for b in batches:
            for start, x in _blocks(b.column(1), dim):
                who, best, _ = book.nearest(x)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(x)), pa.array(who, pa.int32()), pa.array(best)], ["id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, salt: str = SALT, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Kept are vectors of exactly `dim` components, none null or non-finite, as integers floor(scale * component). The k of
    them with the smallest sha256 of `salt:key` start as centroids 0, 1, ...; each round assigns every vector to the nearest
    centroid and moves every centroid with vectors to the exact floor of their mean; a last assignment follows. Driver and
    tasks exchange only k centroids: a task adds up its own vectors, and Spark adds those sums by cluster.

    Nulls: null vectors are not kept; a null key has no hash and starts a centroid only if fewer than k others are there.
    Ties: nearest centroids to the smaller number, equal hashes (repeated keys) by their components. Repeated rows count
    one each. Fewer than k vectors: as many clusters; none, as with an empty table: no rows. Other columns are not read.
    Scaled components of LARGEST or more raise ValueError, since distances would not fit 64 bits.
    """
    kept = materialise(integer_vectors(vectors, dim, scale, key, vector), "vectors")
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    first = kept.select(name.alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    centroids = np.array([r["x"] for r in first], np.int64).reshape(len(first), dim)
    types = {f.name: f.dataType for f in kept.schema}
    out = T.StructType([T.StructField("id", types["id"]), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not len(centroids):
        empty = kept.select("id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
        return empty.withColumnRenamed("id", key)
    for _ in range(rounds):
        parts = kept.select("x").mapInArrow(_partial(centroids), "cluster int, n long, sums array<long>")
        added = parts.groupBy("cluster").agg(F.sum("n"), *[F.sum(F.col("sums")[i]) for i in range(dim)])
        for c, n, *sums in added.collect():  # k rows at most
            centroids[c] = [s // n for s in sums]
    assigned = materialise(kept.select("id", "x").mapInArrow(_assign(centroids), out), "clusters")
    inertia = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, s, sum(inertia.values()), digest[c]) for c, s in inertia.items()]
    about = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # k rows: bounded, so broadcast
    return assigned.join(F.broadcast(about), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
