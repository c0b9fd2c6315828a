"""Exact vector search against all products."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import vectors


def plain(rows, queries, k):
    out = set()
    for q, v, s in queries:
        scored = [(0.0 if s * t <= 0 else round(float(np.dot(v, w)) / (s * t) ** 0.5, 6) + 0.0, i) for i, w, t in rows]
        out |= {(q, i, x, n) for n, (x, i) in enumerate(sorted(scored, key=lambda p: (-p[0], p[1]))[:k], 1)}
    return out


@pytest.mark.parametrize("small", [1 << 16, 10])
def test_blocks_of_both_sides(spark, monkeypatch, small):
    monkeypatch.setattr(vectors, "SMALL_QUERIES", small)
    monkeypatch.setattr(vectors, "BLOCK", 8)
    monkeypatch.setattr(vectors, "ROWS", 16)
    rng = np.random.default_rng(2)
    make = lambda n, at: [(at + i, rng.integers(-3, 4, 6).astype(float).tolist(), float(rng.integers(0, 4))) for i in range(n)]
    rows, queries = make(100, 0), make(30, 1000)
    schema = "id long, vector array<double>, scale double"
    found = vectors.dense_topk(spark, spark.createDataFrame(rows, schema).repartition(3), spark.createDataFrame(queries, schema).withColumnRenamed("id", "query_id"), 5)
    assert {tuple(r[c] for c in ("query_id", "id", "score", "rank")) for r in found.collect()} == plain(rows, queries, 5)


def test_every_vector_as_a_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.lit(1.0).alias("scale"))
    held = [(r[0], np.array(r[1]), 1.0) for r in rows.collect()]
    found = vectors.dense_topk(spark, rows, rows.withColumnRenamed("id", "query_id"), 3)
    got = {(r["query_id"], r["rank"]): r["score"] for r in found.collect()}
    m = np.array([v for _, v, _ in held])
    best = -np.sort(-np.round(m @ m.T, 6), axis=1)[:, :3]
    assert len(got) == 3 * len(held)
    assert all(got[i, n + 1] == pytest.approx(best[row, n], abs=2e-6) for row, (i, _, _) in enumerate(held) for n in range(3))


def test_no_queries_and_no_rows(spark):
    schema = "id long, vector array<double>, scale double"
    one, none = spark.createDataFrame([(1, [1.0], 1.0)], schema), spark.createDataFrame([], schema)
    asked = lambda df: df.withColumnRenamed("id", "query_id")
    assert vectors.dense_topk(spark, one, asked(none), 2).count() == 0
    assert vectors.dense_topk(spark, none, asked(one), 2).count() == 0


def test_few_scores_are_put_in_order(monkeypatch):
    """Of a pair of blocks only what may be among the best is sorted; ties go to the least id, also those that rounding makes."""
    rng = np.random.default_rng(1)
    q, m = rng.normal(size=(20, 8)), rng.normal(size=(500, 8))
    m[100:110] = m[:10] + 1e-9
    ids = np.arange(20), np.arange(500)[::-1].copy()
    sizes, sort = [], np.lexsort
    monkeypatch.setattr(vectors.np, "lexsort", lambda keys: sizes.append(len(keys[0])) or sort(keys))
    found = list(zip(*(x.tolist() for x in vectors.block_best(ids, (q.ravel(), m.ravel()), (np.ones(20), np.ones(500)), 3, 6))))
    assert sum(sizes) < 20 * 20
    score = np.round(q @ m.T, 6) + 0.0
    assert found == [(i, j, s) for i in range(20) for s, j in sorted(zip(score[i].tolist(), ids[1].tolist()), key=lambda x: (-x[0], x[1]))[:3]]


def test_a_corpus_that_was_cut_once_serves_searches(spark):
    """Cut and written before, a corpus gives the same rows; queries of a known number are not counted again."""
    rows = spark.range(300).select("id", F.array(F.sin("id"), F.cos("id")).alias("vector"), F.lit(1.0).alias("scale"))
    asked = rows.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    plain = sorted(map(tuple, vectors.dense_topk(spark, rows, asked, 3).collect()))
    held = vectors.cut(spark, rows)
    assert "c_ids" in held.columns and len(plain) == 18
    assert sorted(map(tuple, vectors.dense_topk(spark, held, asked, 3, most=6).collect())) == plain


def test_useful_chunks_are_told_once(spark):
    from lodestone.functions import rules
    from lodestone.operators import retrieval

    texts = [(i, "s", f"words of chunk {i} " * 60) for i in range(6)] + [(6, "s", rules.USELESS[0] + " and more"), (7, "s", None)]
    corpus = spark.createDataFrame(texts, "chunk_id long, source string, text string")
    scored = spark.range(8).select(F.lit(1).alias("query_id"), F.col("id").alias("chunk_id"), (F.col("id") * 1.0).alias("score"))
    chunks = retrieval.useful(corpus)
    assert chunks.columns == ["chunk_id", "source", "passage"] and chunks.agg(F.max(F.length("passage"))).first()[0] == 512
    plain, told = retrieval.candidates(scored, corpus, 5, True), retrieval.candidates_of(scored, chunks.drop("passage"), 5, True)
    assert plain.columns == told.columns and sorted(map(tuple, plain.collect())) == sorted(map(tuple, told.collect()))
