"""Centroid clustering against plain assignment, and the bounds and the order it rests on."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from jobdelta.llm import centroids, queries

SCHEMA = "vec_id long, embedding array<double>, v string, key int, cluster string, ids long"


def brute(rows, k=16, rounds=3, dims=64):
    """Sorted result rows of (vec_id, list), with Python's integers."""
    kept = [(i, np.clip(np.floor(64 * np.array(e, dtype=np.float64)), -(1 << 27), 1 << 27).astype(np.int64)) for i, e in rows
            if e is not None and len(e) == dims and all(x is not None and np.isfinite(x) for x in e)]
    if not kept:
        return []
    key = lambda x: (hashlib.sha256(f"1:{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[1].astype("<i4").tobytes())
    c = np.stack([v for _, v in sorted(kept, key=key)[:k]])
    x = np.stack([v for _, v in kept])
    for turn in range(rounds + 1):
        d = np.stack([((x - own) ** 2).sum(axis=1) for own in c], axis=1)
        at = d.argmin(axis=1)
        if turn < rounds:
            c = np.stack([np.array([int(s) // int((at == j).sum()) for s in x[at == j].sum(axis=0)]) if (at == j).any() else c[j] for j in range(len(c))])
    d = d[np.arange(len(x)), at]
    own = [int(d[at == j].sum()) for j in range(len(c))]
    return sorted(((i, int(a), int(s), own[a], int(d.sum()), hashlib.sha256(",".join(map(str, c[a].tolist())).encode()).hexdigest()) for (i, _), a, s in zip(kept, at, d)), key=str)


def got(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, e, "v", 1, "c", 2) for i, e in rows], SCHEMA)


def lumps(seed, n, dims=64, of=12):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 3, (of, dims))
    return [(i, (middles[i % of] + rng.normal(0, 0.05, dims)).tolist()) for i in range(n)]


def test_agrees_with_brute_force(spark):
    rows = lumps(1, 700) + [(9, [0.5] * 64)] * 300  # a very common vector
    assert got(centroids.cluster_vectors(table(spark, rows).repartition(5), block=32)) == brute(rows)


def test_vectors_that_are_left_out_and_extremes(spark):
    rows = lumps(2, 40) + [(100, None), (101, []), (102, [0.1] * 63), (103, [0.1] * 65), (104, [0.1] * 63 + [None]), (105, [float("nan")] + [0.0] * 63),
                           (106, [float("inf")] + [0.0] * 63), (107, [1e300] + [-1e300] * 63), (108, [2.0e6] * 64), (None, [0.25] * 64), (5, [0.25] * 64), (5, [0.25] * 64), (109, [-0.0] * 64)]
    assert got(centroids.cluster_vectors(table(spark, rows))) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    rows = lumps(3, n)
    assert got(centroids.cluster_vectors(table(spark, rows))) == brute(rows)


def test_other_parameters(spark):
    rows = lumps(4, 300, dims=8)
    assert got(centroids.cluster_vectors(table(spark, rows), centroids=5, rounds=1, dimensions=8)) == brute(rows, 5, 1, 8)


def test_neighbours_on_the_curve_are_neighbours():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3), axis=-1).reshape(-1, 3)
    keys = [bytes(k) for k in centroids.hilbert_keys(side, 3)]
    assert len(set(keys)) == len(side)
    line = side[sorted(range(len(side)), key=keys.__getitem__)]
    assert (np.abs(np.diff(line, axis=0)).sum(axis=1) == 1).all()


def test_candidates_keep_the_nearest_and_leave_far_ones_out():
    rng = np.random.default_rng(5)
    for _ in range(200):
        c = rng.integers(-50, 50, (9, 4))
        lo = rng.integers(-50, 40, 4)
        hi = lo + rng.integers(0, 12, 4)
        x = rng.integers(lo, hi + 1, (60, 4))
        at = set(centroids.candidates(lo, hi, c).tolist())
        assert set(((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1).tolist()) <= at
    rows = np.array([v for _, v in lumps(6, 1200)])
    v = np.floor(64 * rows).astype(np.int64)
    c = v[:12]
    lo, hi = v.min(axis=0), v.max(axis=0)
    keys = [bytes(k) for k in centroids.hilbert_keys(((v - lo) << 4) // (hi - lo + 1), 4)]
    v = v[sorted(range(len(v)), key=keys.__getitem__)]
    left = [len(centroids.candidates(b.min(axis=0), b.max(axis=0), c)) for b in np.split(v, 75)]
    assert Counter(left)[1] > 50  # most blocks lie in one lump and compare nothing


def test_query_and_its_twin(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    twin = con.execute(f"select vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 from ({queries.ORACLES['op12_centroids']})").fetchall()
    found = got(queries.QUERIES["op12_centroids"](spark, sf))
    assert found == sorted(twin, key=str) == brute(con.execute("select vec_id, embedding from embeddings").fetchall())
