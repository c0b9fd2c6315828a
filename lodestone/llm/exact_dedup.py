"""Exact dedup by two-pass Bloom filtering; DataFrame functions only.

Pass one turns every text into a digest and sets, in a Bloom filter, the bits that at least two
rows want. Pass two probes it: a row with an unset bit is unique for certain and passes straight
through, only the others are grouped by digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import bloom
from lodestone.llm.common import heavy_join, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalized(text: Column) -> Column:
    """The text that must agree: A-Z in lower case, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_filter_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Texts are equal when identical after lower-casing A-Z; of equal texts the largest id stays.
    Null and empty texts are equal to each other. Repeated rows with the largest id are all kept.
    A null id never wins over another; a group with null ids only has a null keep_id and kept false.
    Other columns are ignored. The broadcast filter never exceeds max_filter_bytes; beyond
    that, more rows than needed are grouped, with the same result.
    """
    digests = materialize(df.select(F.col(id_col).alias("doc_id"), F.sha2(normalized(F.col(text_col)), 256).alias("text_sha256")), "digests")
    rows = digests.count()
    bits = bloom.size_for(rows, bits_per_row, max_filter_bytes)
    digest = F.col("text_sha256")
    wanted = digests.select(F.explode(F.array(*bloom.positions(digest, bits))).alias("position"))
    twice = wanted.groupBy("position").agg(F.count("*").alias("n")).where("n > 1")
    probed = bloom.probe(digests, bloom.from_positions(twice, bits, "bloom"), digest, bits, "possible")
    possible = F.col("possible")

    single = probed.where(~possible).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    several = probed.where(possible).select("doc_id", "text_sha256")
    groups = materialize(several.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"), "groups")

    found = heavy_join(several, groups, "text_sha256", F.col("group_size"), rows)
    found = found.select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "text_sha256")
    every = single.unionByName(found)
    return every.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")


ORACLE = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, coalesce(d.doc_id = g.keep_id, false) AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""
