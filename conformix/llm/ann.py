"""Nearest neighbours by a blocked int8 matrix join with error bounds and exact recomputation."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conformix.llm.common import materialise, tasks

#: Vectors of a block on either side of a tile.
QUERY_BLOCK, BASE_BLOCK = 1024, 4096


def clean_vectors(df: DataFrame, key: str, vector: str, *more: str) -> DataFrame:
    """(id, v) and further columns of rows whose vector is not null, not empty, not zero and has finite components only."""
    v = F.col(vector).cast("array<double>")
    good = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return df.where(F.col(key).isNotNull() & good & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))).select(F.col(key).alias("id"), v.alias("v"), *more)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes with a scale a row; the norms of the reproduced rows and of what is lost."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def product(codes_a: np.ndarray, codes_b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows; float32 holds them exactly while dim * 127 * 127 < 2**24, else float64."""
    kind = np.float32 if codes_a.shape[1] * 16129 < 1 << 24 else np.float64
    return codes_a.astype(kind) @ codes_b.astype(kind).T


def tile_top(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int):
    """(query id, id, score) of each query's k best rows of one tile, exact: a pair is left out of the float
    recomputation only if its upper bound is below the k-th largest lower bound of its query."""
    cq, sq, nq, eq = quantise(q)
    cx, sx, nx, ex = quantise(x)
    about = product(cq, cx) * sq[:, None] * sx[None, :]
    slack = eq[:, None] * (nx + ex)[None, :] + nq[:, None] * ex[None, :] + 1e-9 * (nq + eq)[:, None] * (nx + ex)[None, :]
    same = q_ids[:, None] == x_ids[None, :]
    about[same] = -np.inf
    low = about - slack
    floor = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(q), -np.inf)
    live = (about + slack >= floor[:, None]) & ~same
    for i in range(len(q)):
        at = np.flatnonzero(live[i])
        exact = (x[at] * q[i]).sum(axis=1)
        best = np.lexsort((x_ids[at], -exact))[:k]
        yield q_ids[i], x_ids[at[best]], exact[best]


def _blocks(rows: DataFrame, n: int, name: str) -> DataFrame:
    """(block, ids, vectors): rows dealt by a hash of their id over n blocks of bounded size."""
    packed = rows.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(n))).groupBy(name).agg(F.collect_list(F.struct("id", "v")).alias("r"))
    return packed.select(name, F.col("r.id").alias(f"{name}_id"), F.col("r.v").alias(f"{name}_v"))


def search(queries: DataFrame, base: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of base with the largest inner product, ties to the smaller id.

    Both sides are packed into blocks; each base block meets each query block in one tile (an equi-join on the tile's
    number), tiles are dealt over all tasks, and each hands on k pairs a query at most, which heaps then merge.
    A query is no candidate for itself. Vectors that are null, empty, zero or hold null or non-finite components take no
    part, nor do those whose length is not the one of the query; fewer than k candidates give fewer rows; repeated rows of
    an id count as one row each as candidates and as one query; empty tables give no rows.
    """
    spark = base.sparkSession
    q, x = clean_vectors(queries, key, vector).dropDuplicates(["id"]), clean_vectors(base, key, vector)
    # vectors of each length are a matrix of their own
    n_q, n_x = max(1, -(-q.count() // QUERY_BLOCK)), max(1, -(-x.count() // BASE_BLOCK))
    qb, xb = _blocks(q, n_q, "qb"), _blocks(x, n_x, "xb").repartition(n_x, "xb")
    tiles = xb.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long"))))
    tiles = tiles.repartition(min(max(tasks(spark), n_x), n_q * n_x), "qb", "xb").join(qb.hint("merge"), "qb")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pydict()
                sides = []
                for s in ("qb", "xb"):
                    byl: dict[int, list] = {}
                    for j, v in zip(r[f"{s}_id"][0], r[f"{s}_v"][0]):
                        byl.setdefault(len(v), []).append((j, v))
                    sides.append({n: (np.array([y for y, _ in z], np.int64), np.array([y for _, y in z], float)) for n, z in byl.items()})
                for n in sides[0].keys() & sides[1].keys():
                    (qi, qv), (xi, xv) = sides[0][n], sides[1][n]
                    out = list(tile_top(qv, qi, xv, xi, k))
                    yield pa.RecordBatch.from_arrays([pa.array([int(o[0]) for o in out]), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.list_(pa.float64()))], ["query_id", "ids", "scores"])

    parts = tiles.mapInArrow(run, "query_id long, ids array<long>, scores array<double>")

    def merge(batches):
        heap: dict[int, list] = {}
        for b in batches:
            for i, ids, scores in zip(*(c.to_pylist() for c in b.columns)):
                held = heap.setdefault(i, [])
                for j, s in zip(ids, scores):
                    (heapq.heappush if len(held) < k else heapq.heappushpop)(held, (s, -j))
        rows = [(i, r, -j, s) for i, h in heap.items() for r, (s, j) in enumerate(sorted(h, reverse=True), 1)]
        cols = list(zip(*rows)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], ["query_id", "rank", "vec_id", "score"])

    return parts.repartition(max(tasks(spark), n_q), "query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")
