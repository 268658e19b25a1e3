"""Exponion search against plain rounds over all centroids."""

import hashlib
import math

import numpy as np
import pytest
from compare import assert_same

from lectern.llm import centroid_clustering as cc
from lectern.llm import queries

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, n long, distance double"


def plain(rows, clusters, rounds, dimension):
    kept = [(i, [max(-cc.LIMIT, min(cc.LIMIT, math.floor(256 * x))) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), np.array(v, ">i4").tobytes(), v) for i, v in kept if i is not None)
    at = [v for *_, v in starts[:clusters]]
    if not at:
        return []
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(at))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        at = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else c for k, c in enumerate(at)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = {k: sum(d for _, d, c in found if c == k) for k in range(len(at))}
    return [(i, k, d, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, at[k])).encode()).hexdigest()) for i, d, k in found]


def check(spark, rows, clusters=5, rounds=4, dimension=3):
    table = spark.createDataFrame([(i, v, 1, 9, 9, 9.0) for i, v in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in cc.cluster(table, clusters, rounds, dimension).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain(rows, clusters, rounds, dimension)))
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_plain(spark, seed):
    r = np.random.default_rng(seed)
    rows = [(i, (r.normal(0, 2, 3) + 3 * (i % 4)).tolist()) for i in range(300)]
    assert len(check(spark, rows)) == 300
    check(spark, rows, clusters=20, rounds=6)


def test_ties(spark):
    """Vectors on a small grid are equally far from several centroids, and some centroids are equal."""
    rows = [(i, [(i % 3) / 256, (i // 3 % 3) / 256, 0.0]) for i in range(120)]
    for clusters in (2, 9, 30):
        check(spark, rows, clusters=clusters)


def test_edges(spark):
    good = [(i, [float(i), 1.0, -0.001]) for i in range(4)]
    odd = [(10, None), (11, []), (12, [1.0]), (13, [1.0, None, 2.0]), (14, [math.nan, 0.0, 0.0]), (15, [math.inf, 0.0, 0.0]), (16, [1.0] * 4)]
    assert len(check(spark, good + odd + [(None, [1.0, 1.0, 1.0]), (2, [9.0, 9.0, 9.0]), (2, [9.0, 9.0, 9.0])])) == 7
    assert len(check(spark, [(1, [0.0, 0.0, 0.0])])) == 1
    assert len(check(spark, [*good, (9, [1e38, -1e38, 0.0]), (8, [5e4, 1.0, 1.0])])) == 6
    assert not check(spark, odd)
    assert not check(spark, [])
    assert not check(spark, [(None, [1.0, 1.0, 1.0])])
    check(spark, good, rounds=0)


def test_few_distances_are_computed():
    """On separated groups most vectors are settled by their bounds, and the rest scan a part of the centroids."""
    r = np.random.default_rng(3)
    middle = r.integers(-20_000, 20_000, (40, 8))
    group = r.integers(0, 40, 5000)
    x = middle[group] + r.integers(-300, 300, (5000, 8))
    at = cc.Centroids(middle + r.integers(-200, 200, (40, 8)))
    a, upper, lower, scanned = at.assign(x, group, np.full(5000, np.inf), np.zeros(5000))
    assert (a == at.squared(x, np.arange(40)).argmin(1)).all() and scanned < 5000 * 12
    moved = cc.Centroids(middle, at.at)
    b, *_, scanned = moved.assign(x, a, upper, lower)
    assert (b == moved.squared(x, np.arange(40)).argmin(1)).all() and scanned < 1000


def test_same_as_sql(spark, sf_dir, duck):
    assert_same(queries.op12_centroid_clustering(spark, sf_dir), duck.sql(queries.ORACLE_SQL["op12_centroid_clustering"]))
