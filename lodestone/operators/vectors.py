"""Embeddings and exact inner-product search."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.storage import written

DIMS = 64
#: Query vectors and corpus vectors that are scored together.
BLOCK, ROWS = 512, 2048
#: Query sets up to so many vectors are broadcast: 32 MB at 64 dimensions.
SMALL_QUERIES = 1 << 16


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """v by its length; a zero vector stays."""
    from lodestone.functions.text import let

    return let(F.sqrt(dot(v, v)), lambda n: F.transform(v, lambda x: x / F.when(n == 0, 1.0).otherwise(n)))


class HashEmbedder:
    """Deterministic embeddings without a model: signed counts of hashed tokens, left as whole numbers."""

    def __init__(self, dims: int = DIMS):
        self.dims, self.known = dims, {}

    def place(self, token: str) -> tuple[int, int]:
        if token not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            digest = hashlib.md5(token.encode()).hexdigest()
            self.known[token] = int(digest[:8], 16) % self.dims, 1 if int(digest[8], 16) < 8 else -1
        return self.known[token]

    def encode(self, token_lists: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(token_lists), self.dims), "i8")
        for row, ts in zip(out, token_lists):
            for t in ts:
                i, sign = self.place(t)
                row[i] += sign
        return out


def embed(df: DataFrame, id_col: str, tokens: Column, embedder=HashEmbedder) -> DataFrame:
    """(id, counts, norm2): whole-number vectors and their squared lengths; embedder() is made once a task."""

    def run(batches):
        model = embedder()
        for batch in batches:
            m = model.encode([t or [] for t in batch.column(1).to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype="i4") * m.shape[1]), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array((m * m).sum(axis=1))], ["id", "counts", "norm2"])

    return df.select(F.col(id_col).alias("id"), tokens.alias("tokens")).mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, counts array<bigint>, norm2 bigint")


def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
    """Rows (id, vector, scale) as blocks: name_ids, name_values (their vectors, one after another), name_scales."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                columns = part.column(0), part.column(1).flatten(), part.column(2)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns], [f"{name}_{c}" for c in ("ids", "values", "scales")])

    kinds = ", ".join(f"{name}_{c} array<{t}>" for c, t in (("ids", "bigint"), ("values", "double"), ("scales", "double")))
    return df.select(F.col("id").cast("long"), F.col("vector").cast("array<double>"), F.col("scale").cast("double")).mapInArrow(run, kinds)


def block_best(ids: tuple, values: tuple, scales: tuple, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best of one block of rows for each query of another; each argument is (of queries, of rows)."""
    q, m = (v.reshape(len(i), -1) for v, i in zip(values, ids))
    product, k = q @ m.T, min(k, len(m))
    if not (np.all(scales[0] == 1) and np.all(scales[1] == 1)):
        root = np.sqrt(scales[0][:, None] * scales[1][None, :])
        product = np.divide(product, root, out=np.zeros_like(product), where=root > 0)
    # What is below the k-th greatest by more than rounding can make up for is out; only the rest is rounded and put in order.
    least = np.partition(product, len(m) - k, axis=1)[:, len(m) - k, None] - 2 * 10.0**-digits
    rows, columns = np.nonzero(~(product < least))
    score = np.round(product[rows, columns], digits) + 0.0
    order = np.lexsort((ids[1][columns], -score, rows))
    place = np.arange(len(order)) - np.searchsorted(rows, np.arange(len(q)))[rows]
    chosen = order[place < k]
    return ids[0][rows[chosen]], ids[1][columns[chosen]], score[chosen]


def cut(spark: SparkSession, corpus: DataFrame) -> DataFrame:
    """corpus (id, vector, scale) as dense_topk() takes it; written once, it serves many searches."""
    # A small table is one file and one task, but its pairs of blocks are many: the blocks are dealt to all cores.
    return blocks(corpus, ROWS, "c").repartition(2 * spark.sparkContext.defaultParallelism)


def dense_topk(spark: SparkSession, corpus: DataFrame, queries: DataFrame, k: int, digits: int = 6, most: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k rows of corpus (id, vector, scale) of greatest inner product with each query (query_id, vector, scale), exactly.

    Products are divided by both scales' root, rounded, and ties go to the least id. Both sides are cut into blocks of rows, every block of queries
    meets every block of the corpus, and a pair of blocks keeps its k best a query, so k rows a query and pair are shuffled. Up to SMALL_QUERIES queries
    are broadcast; more are written once and joined from there, so that no side has to fit anywhere. corpus may have been cut() before; a caller
    that knows a bound of the number of queries gives it as most, else they are counted.
    """
    asked = blocks(queries.withColumnRenamed("query_id", "id"), BLOCK, "q")
    if (queries.count() if most is None else most) <= SMALL_QUERIES:
        asked = F.broadcast(asked)
    else:
        asked = written(asked, "queries")
    pairs = (corpus if "c_ids" in corpus.columns else cut(spark, corpus)).crossJoin(asked)

    def run(batches):
        for batch in batches:
            held = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for row in range(batch.num_rows):
                sides = [tuple(held[f"{side}_{c}"][row].values.to_numpy() for side in "qc") for c in ("ids", "values", "scales")]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in block_best(*sides, k, digits)], ["query_id", "id", "score"])

    found = pairs.mapInArrow(run, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
