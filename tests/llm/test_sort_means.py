"""Sort-means against a plain k-means in Python's integers."""

import hashlib
import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm.sort_means import LONG, nearest, rounded_down, sort_means

FIELDS = "vec_id long, embedding array<double>, cluster string, distance double, v int"


def brute(rows, k=8, rounds=10, dim=64):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, m) in zip(kept, found, strict=True) if m == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    out = []
    for (i, _), (d, j) in zip(kept, found, strict=True):
        own = sum(d for d, m in found if m == j)
        out.append((i, j, min(d, LONG), own, sum(d for d, _ in found), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, "x", 1.5, 3) for i, v in rows], FIELDS)
    return sorted(map(tuple, sort_means(frame, **options).collect()), key=str)


def test_clusters(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(i % 5, 0.8) for _ in range(64)]) for i in range(300)]
    assert run(spark, rows) == brute(rows)


def test_edge_rows(spark):
    """Unsound vectors, repeated rows and ids, null ids, vectors of equal distance."""
    r = random.Random(6)
    rows = [(i % 30, [float(r.randrange(-2, 3)) for _ in range(64)]) for i in range(90)]
    rows += [rows[3]] * 40 + [(None, [0.5] * 64)] * 3 + [(7, None), (8, []), (9, [1.0] * 63), (10, [None] + [1.0] * 63), (11, [math.nan] * 64), (12, [math.inf] + [0.0] * 63)]
    assert run(spark, rows) == brute(rows)


def test_few_vectors_and_none(spark):
    rows = [(1, [1.0] * 64), (2, [1.0] * 64), (3, [-3.25] * 64)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == []


def test_wide_components(spark):
    """Integers that do not fit 64 bits when squared."""
    rows = [(i, [float(i % 4) * 1e6] * 64) for i in range(12)]
    assert run(spark, rows) == brute(rows)
    huge = run(spark, [(i, [1e15 * i + 1] * 64) for i in range(12)], n_clusters=2)
    assert max(r[2] for r in huge) == LONG and {r[1] for r in huge} == {0, 1}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=3, max_size=3), min_size=1, max_size=30), st.lists(st.lists(st.integers(-3, 3), min_size=3, max_size=3), min_size=1, max_size=6), st.randoms())
def test_scan_finds_the_nearest(vectors, centroids, chance):
    x, c = np.array(vectors), np.array(centroids)
    before = np.array([chance.randrange(len(c)) for _ in vectors])
    cluster, distance = nearest(x, before, c)
    want = [min((int(((v - m) ** 2).sum()), j) for j, m in enumerate(c)) for v in x]
    assert list(zip(distance.tolist(), cluster.tolist(), strict=True)) == want


def test_rounded_down(spark):
    rows = spark.createDataFrame([(-0.5,), (1.9,), (-2.0,), (1e300,)], "x double").select(rounded_down(F.col("x")).alias("y")).collect()
    assert [r.y for r in rows] == [-1.0, 1.0, -2.0, 1e300]
