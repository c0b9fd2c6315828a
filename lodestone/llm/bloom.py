"""Bloom filters as DataFrames: a row for each bucket of 32,768 bits, as 512 longs; made and probed by built-in functions.

Both bits of a key lie in one bucket, so that probing is one lookup by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, unused

BUCKET = 1 << 15


def size_for(rows: int, bits_per_row: int, max_bytes: int) -> int:
    """A power of two of bits, never more than max_bytes of them nor less than a bucket."""
    return max(BUCKET, min(1 << max(1, rows * bits_per_row - 1).bit_length(), max_bytes * 8))


def positions(key: Column, bits: int) -> list[Column]:
    """The positions of a key, from 0 to bits - 1."""
    first = F.xxhash64(key)
    bucket = F.pmod(first, F.lit(bits // BUCKET)) * BUCKET
    return [bucket + F.shiftright(first, s).bitwiseAND(BUCKET - 1) for s in (33, 48)]


def from_positions(found: DataFrame, bits: int, label: str) -> DataFrame:
    """(bucket, words): the filter with the bits of a position column set, written to the shared folder."""
    at = F.col("position")
    word = F.expr("shiftleft(1L, cast(position & 63 as int))")
    some = found.select(F.shiftright(at, 6).alias("word"), word.alias("bits"))
    # Each word once more without bits, so that the words of a bucket are all there.
    none = found.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = some.unionByName(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    held = words.groupBy(F.shiftright("word", 9).alias("bucket")).agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("held"))
    return materialize(held.select("bucket", F.transform("held", lambda x: x["bits"]).alias("words")), label)


def of_keys(keys: DataFrame, key: str, bits: int) -> DataFrame:
    return from_positions(keys.where(F.col(key).isNotNull()).select(F.explode(F.array(*positions(F.col(key), bits))).alias("position")), bits, "bloom")


def probe(df: DataFrame, bloom: DataFrame, key: Column, bits: int, into: str = "maybe") -> DataFrame:
    """df with a column that is false only for keys that were not put in. The filter is broadcast; size_for() bounds it.

    No column of df may be called into.
    """
    columns, spots = df.columns, positions(key, bits)
    bucket, words = unused("_bucket", columns), unused("_words", columns)
    part = F.broadcast(bloom.select(F.col("bucket").alias(bucket), F.col("words").alias(words)))
    out = df.join(part, F.shiftright(spots[0], 15) == F.col(bucket), "left")
    hits = [F.getbit(F.get(words, F.shiftright(at, 6).bitwiseAND(511).cast("int")), at.bitwiseAND(63).cast("int")) == 1 for at in spots]
    return out.select(*columns, F.coalesce(hits[0] & hits[1], F.lit(False)).alias(into))
