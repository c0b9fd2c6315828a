"""Clusters against plain rounds."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import queries, yinyang

SCHEMA = "vec_id long, embedding array<float>, cluster string, v int, distance int"


def plain(rows, k=8, rounds=10, seed=3):
    """(id, cluster, distance, own inertia, inertia, digest) by all distances in every round."""
    good = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centers = [v for _, v in sorted(good, key=key)[:k]]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centers)) for _, v in good]

    for _ in range(rounds):
        at = nearest()
        for n in range(len(centers)):
            if own := [v for (_, v), (_, c) in zip(good, at) if c == n]:
                centers[n] = tuple(sum(x) // len(own) for x in zip(*own))
    at = nearest()
    inertia = [sum(d for d, c in at if c == n) for n in range(len(centers))]
    return sorted(((i, c, d, inertia[c], sum(inertia), hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(good, at)), key=repr)


def found(spark, rows, **more):
    data = [(i, None if v is None else [None if x is None else float(x) for x in v], "c", 1, 2) for i, v in rows]
    return sorted((tuple(r) for r in yinyang.cluster(spark.createDataFrame(data, SCHEMA).repartition(3), **more).collect()), key=repr)


def vectors(n, seed, digits=3):
    return np.random.default_rng(seed).normal(size=(n, 64)).round(digits).astype("f4").tolist()


def test_nulls_odd_lengths_ties_and_repeats(spark):
    base = vectors(12, 1, 0)
    rows = [(i, base[i % 12]) for i in range(60)] + [(60, None), (61, []), (62, base[0][:63]), (63, base[0] + [1.0]), (64, [None] + base[0][1:]), (65, [math.nan] + base[0][1:]), (66, [math.inf] + base[0][1:])]
    rows += [(None, base[3]), (None, base[4]), (5, base[7]), (5, base[5])]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, k=3, rounds=4, seed=1, groups=3) == plain(rows, 3, 4, 1)


def test_few_none_and_equal_vectors(spark):
    three = list(enumerate(vectors(3, 2)))
    assert found(spark, three) == plain(three)
    same = [(i, three[0][1]) for i in range(40)]
    assert found(spark, same) == plain(same)
    assert found(spark, []) == [] and found(spark, [(1, None)]) == []


def test_distances_beyond_a_long_are_the_greatest_long(spark):
    rows = [(0, [0.0] * 64), (1, [1e38] * 64), (2, [-1e38] * 64), (3, [5e5] + [0.0] * 63)]
    got = {r[0]: r[2] for r in found(spark, rows, k=1, rounds=0)}
    assert max(got.values()) == (1 << 63) - 1
    assert min(got.values()) == 0


@pytest.mark.parametrize("groups", [1, 2, 5])
def test_bounds_agree_with_all_distances_and_save_most(groups):
    rng = np.random.default_rng(groups)
    middle = rng.integers(-400, 400, (20, 64))
    v = (middle[rng.integers(0, 20, 3000)] + rng.integers(-150, 150, (3000, 64))).astype("i8")
    centers, before, state = v[:20].copy(), None, None
    parts = yinyang.grouped(centers, groups)
    asked = 0
    for _ in range(8):
        bounds = yinyang.Bounds(centers, before, parts)
        state = bounds.begin(v) if before is None else bounds.move(v, *state)
        every = ((v[:, None] - centers[None]) ** 2).sum(axis=2)
        assert (state[0] == every.argmin(axis=1)).all()
        assert (state[1] >= np.sqrt(every.min(axis=1))).all()
        for g, own in enumerate(parts):
            others = np.where(own[None] == state[0][:, None], np.inf, np.sqrt(every[:, own]))
            assert (state[2][:, g] <= others.min(axis=1)).all()
        asked += bounds.measured
        before = centers
        centers = np.array([v[state[0] == c].sum(axis=0) // max(1, (state[0] == c).sum()) if (state[0] == c).any() else centers[c] for c in range(20)])
    assert asked < 0.6 * 8 * 20 * 3000


def test_small_table_as_sql_and_plain_rounds(spark, sf_dir, same_as_sql):
    assert same_as_sql("op12_yinyang") > 0
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted((tuple(r) for r in queries.op12_yinyang(spark, sf_dir).collect()), key=repr) == plain(rows)


def test_long_lists_and_doubles(spark):
    rows = [(i, v + v) for i, v in enumerate(vectors(30, 9))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert yinyang.cluster(frame).count() == 0
    assert yinyang.cluster(frame, dims=128, k=4).select(F.count_distinct("cluster")).first()[0] > 1
