"""Token-id files: Parquet list columns sorted by document, with chosen encodings and row groups.

Columns: doc_id, part and part_start (ids of the same part before the document), n_tokens and
ids. The small columns can be read without the ids, and the page index of the sorted doc_id lets a
reader skip the pages of other documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import range_of, tidy
from lodestone.llm.encoding import BYTE_BPE, batches_of, shared_encoder

#: Ids come from a small vocabulary, so they are dictionary-encoded; the columns that count upwards are delta-encoded by the version 2 writer.
WRITER = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#part_start": "false",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.page.size": str(256 << 10),
}
TOKENS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("part_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
NAMES = [f.name for f in TOKENS]


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str = BYTE_BPE, end_id: int | None = 0, parts: int | None = None) -> DataFrame:
    """Rows of TOKENS in ascending doc_id order, partition by partition.

    Null text is empty; equal ids are in no particular order; null ids come first. Only documents are
    shuffled, by range of doc_id, so one source or group of copies is not one task.
    """

    def run(batches):
        from pyspark import TaskContext

        part, before, encoder = TaskContext.get().partitionId(), 0, shared_encoder(tokenizer_path)
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0)
            for i, some in batches_of(texts):
                coded = encoder.encode(some, end_id)
                counts = np.array([len(c) // 4 for c in coded], "i8")
                ends = np.cumsum(counts)
                values = pa.array(np.frombuffer(b"".join(coded), "<i4"))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype("i4")), values)
                yield pa.RecordBatch.from_arrays([ids.slice(i, len(some)).cast(pa.int64()), pa.array(np.full(len(some), part, "i4")), pa.array(before + ends - counts), pa.array(counts), lists], NAMES)
                before += int(ends[-1])

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The ranges come from the ids alone; repartitionByRange() would read the texts once more to sample them.
    found = docs.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 100_000)).first()[0]
    dealt = docs.repartitionById(parts, F.greatest(range_of(F.col("doc_id"), sorted(set(found or []))[: parts - 1]), F.lit(0)))
    return dealt.sortWithinPartitions("doc_id").mapInArrow(tidy(run), TOKENS)


def write_tokens(tokens: DataFrame, path: str, row_group_bytes: int = 16 << 20, mode: str = "errorifexists") -> None:
    """Writes what encode_documents() gives, in its order."""
    tokens.write.options(**WRITER, **{"parquet.block.size": str(row_group_bytes)}).mode(mode).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; select columns or filter by doc_id and only those pages are read."""
    return spark.read.schema(TOKENS).parquet(path)


def with_starts(tokens: DataFrame) -> DataFrame:
    """tokens with start: ids of all documents before each one.

    The totals of the parts are one row for each file, which bounds the broadcast and the running sum.
    """
    from pyspark.sql import Window

    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = totals.select(F.col("part").alias("of_part"), F.coalesce(F.sum("part_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return tokens.join(F.broadcast(before), F.col("part") == F.col("of_part")).withColumn("start", F.col("before") + F.col("part_start"))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b].astype("<u4", copy=False).tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = with_starts(read_tokens(spark, path)).select("doc_id", "start", "n_tokens", "ids")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
