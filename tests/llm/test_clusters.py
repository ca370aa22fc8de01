"""Integer clustering against plain arithmetic."""

import hashlib
import random

import numpy as np
import pytest

from conformix.llm import clusters

SCHEMA = "vec_id long, embedding array<float>, cluster string, id int"


def brute(rows, k, rounds, dim):
    """(vec_id, cluster, distance, cluster_inertia, inertia, digest) by comparing every vector with every centroid."""
    kept = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    name = lambda i: (i is None, "" if i is None else hashlib.sha256(f"2:{i}".encode()).hexdigest())
    centroids = [x for _, x in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = {}
        for _, x in kept:
            own.setdefault(near(x)[1], []).append(x)
        for n, xs in own.items():
            centroids[n] = [sum(c) // len(xs) for c in zip(*xs)]
    got = [(i, near(x)) for i, x in kept]
    inertia = {}
    for _, (d, n) in got:
        inertia[n] = inertia.get(n, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), digest[n]) for i, (d, n) in got), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("k,rounds", [(7, 3), (200, 1), (1, 2)])
def test_equals_brute_force(spark, k, rounds):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(5, 8))
    rows = [(i, (centre[i % 5] + 0.3 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(120)]
    rows += [(120, None), (121, [0.5] * 7), (122, [0.5] * 9), (123, [None] + [0.1] * 7), (124, [float("nan")] * 8), (125, [float("inf")] + [0.0] * 7), (126, []), (None, [0.25] * 8)]
    rows += [rows[4], rows[4], (4, [1.0] * 8), (130, [0.0] * 8), (131, [0.0] * 8), (132, [-0.001] * 8)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)
    got = clusters.cluster(df, k=k, rounds=rounds, dim=8)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert rows_of(got) == brute(rows, k, rounds, 8)


def test_empty_table(spark):
    for rows in ([], [(1, None, "x", 1)]):
        out = clusters.cluster(spark.createDataFrame(rows, SCHEMA))
        assert out.count() == 0 and "centroid_sha256" in out.columns


def test_search_is_exact_and_computes_few_distances():
    rng = random.Random(1)
    for scale in (3, 300, clusters.LARGEST - 1):
        c = np.array([[rng.randint(-scale, scale) + (j % 7) * scale // 3 for _ in range(16)] for j in range(40)], np.int64).clip(-scale, scale)
        c = np.concatenate((c, c[:5]))
        x = np.array([[v + rng.randint(-1, 1) * (scale // 50) for v in c[rng.randrange(40)]] for _ in range(500)], np.int64)
        who, best, computed = clusters.Codebook(c).nearest(x)
        whole = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        assert (best == whole.min(axis=1)).all() and (who == whole.argmin(axis=1)).all()
        assert computed < len(x) * len(c) / (2 if scale > 3 else 1)


def test_components_out_of_range(spark):
    df = spark.createDataFrame([(1, [1e30] * 64, "x", 1)], SCHEMA)
    with pytest.raises(Exception, match="exceed 64 bits"):
        clusters.cluster(df).collect()
