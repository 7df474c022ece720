"""Centroid clustering against plain rounds in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tallymark.llm.centroids import cluster, digest, first_centroids, loosening, report, whole

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k=8, rounds=10, dims=64, seed=3):
    """(vec_id, cluster, distance) of every usable row, and the centroids."""
    kept = []
    for i, e in rows:
        if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e):
            kept.append((i, [math.floor(1024 * float(np.float32(x))) for x in e]))
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(c))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            if members := [v for (_, v), o in zip(kept, own) if o == j]:
                c[j] = [sum(x) // len(members) for x in zip(*members)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    return out, c


def check(spark, rows, schema=SCHEMA, extra=(), k=8, rounds=10):
    found = cluster(spark.createDataFrame([(*r, *extra) for r in rows], schema).repartition(3), k=k, rounds=rounds)
    expected, centroids = plain([r[:2] for r in rows], k, rounds)
    text = lambda rows: sorted(map(repr, rows))
    assert text(tuple(r) for r in found.assigned.collect()) == text(expected)
    assert found.centroids.tolist() == centroids
    return found, expected


def blobs(n, spread, seed=1, centres=5):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(centres)]
    return [(i, [m + rng.gauss(0, spread) for m in middle[i % centres]]) for i in range(n)]


def test_blobs_and_what_is_skipped(spark):
    found, expected = check(spark, blobs(400, 0.3))
    assert found.scanned[0] == 400 and sum(found.scanned[1:]) < 10 * 400 * 0.8
    rows = report(found).collect()
    total = sum(d for _, _, d in expected)
    per = {}
    for _, j, d in expected:
        per[j] = per.get(j, 0) + d
    for r in rows:
        assert r.inertia == total and r.cluster_inertia == per[r.cluster]
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, found.centroids[r.cluster].tolist())).encode()).hexdigest()
    assert digest(np.array([1, -2])) == hashlib.sha256(b"1,-2").hexdigest()


def test_ties_copies_and_large_components(spark):
    corners = [[float(b >> i & 1) for i in range(3)] + [0.0] * 61 for b in range(8)]
    check(spark, [(i, corners[i % 8]) for i in range(60)] + [(i, corners[0]) for i in range(40)])
    check(spark, [(i, [v * 30_000 for v in corners[i % 8]]) for i in range(30)] + [(90, [1e5] * 64), (91, [-1e5] * 64)], rounds=3)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    ok = [0.25] * 64
    odd = [(1, None), (2, []), (3, [1.0]), (4, [nan, *ok[1:]]), (5, [inf, *ok[1:]]), (6, [None, *ok[1:]]), (7, ok * 2)]
    extra = ("x", 1, 2.0, True)
    schema = SCHEMA + ", v string, cluster int, u double, part boolean"
    check(spark, [*odd, (None, ok), (8, ok), (8, ok), (8, [-0.25] * 64), (None, [0.0001] * 64)], schema, extra)
    none = cluster(spark.createDataFrame([], SCHEMA))
    assert report(none).collect() == []
    only = cluster(spark.createDataFrame(odd, SCHEMA))
    assert only.assigned.collect() == [] and report(only).collect() == []
    # components whose squared distances pass a long take no part
    assert whole(spark.createDataFrame([(1, [1e30] * 64), (2, ok)], SCHEMA)).collect()[0].vec_id == 2


@pytest.mark.parametrize("seed", range(3))
def test_loosening_bounds_every_member(seed):
    rng = np.random.default_rng(seed)
    gained = 0
    for _ in range(60):
        k, dims = rng.integers(2, 6), rng.integers(2, 5)
        old = rng.integers(-50, 50, (k, dims))
        new = old + rng.integers(-20, 20, (k, dims))
        radius = rng.uniform(0, 40, k)
        bound = loosening(old, new, radius)
        for i in range(k):
            towards = rng.normal(size=(400, dims))
            towards /= np.linalg.norm(towards, axis=1)[:, None]
            x = old[i] + towards * radius[i] * rng.uniform(0, 1, 400)[:, None] ** 0.2
            for j in set(range(k)) - {i}:
                fell = np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)
                assert fell.max() <= bound[i] + 1e-6
            drift = max(np.linalg.norm(new[j] - old[j]) for j in set(range(k)) - {i})
            gained += bound[i] < drift * 0.999
    assert gained > 30  # often less than the full move


def test_start_by_hash(spark):
    rows = [(i, [float(i)] * 64) for i in range(30)]
    first = first_centroids(whole(spark.createDataFrame(rows, SCHEMA)))
    keys = sorted(range(30), key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())[:8]
    assert first[:, 0].tolist() == [1024 * i for i in keys]
