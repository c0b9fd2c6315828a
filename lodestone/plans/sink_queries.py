"""Queries that write with the sinks and read back, and that segment units with a stub model."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import functions as F

from lodestone.functions import classify
from lodestone.functions.storage import ensure_checkpoint_dir
from lodestone.operators import segmentation
from lodestone.plans.registry import query, table
from lodestone.plans.retrieval_queries import corpus
from lodestone.sources import sinks, web


def fresh(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("json_round_trip", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def json_round_trip(spark, sf_dir):
    docs, path = table(spark, sf_dir, "documents"), fresh(spark, "json")
    sinks.write_json(docs, path)
    return spark.read.schema(docs.schema).json(path)


def chunks(spark, sf_dir):
    """Documents as chunks; those with an even id have a vector."""
    vector = F.when(F.col("chunk_id") % 2 == 0, F.array(F.length("text").cast("double")))
    return corpus(spark, sf_dir).withColumn("embedding", vector).withColumnRenamed("text", "chunk_text")


@query("artifact_report", "SELECT source, count(*) AS n_chunks, count(*) FILTER (doc_id % 2 = 0) AS n_vectors, sum(length(text))::BIGINT AS n_chars, count(*) AS n_metadata, count(*) FILTER (doc_id % 2 = 0) AS n_matrix FROM documents GROUP BY source")
def artifact_report(spark, sf_dir):
    """The artifacts of every source, reread: the report beside the rows of the metadata and the matrix."""
    path = fresh(spark, "artifacts")
    sinks.write_artifacts(chunks(spark, sf_dir), path)
    held = spark.read.parquet(f"{path}/chunks").select("chunk_id", F.col("source").cast("string").alias("source"))
    metadata = spark.read.schema("chunk_id long, source string, chunk_text string").json(f"{path}/metadata").groupBy("source").agg(F.count("chunk_text").alias("n_metadata"))
    matrix = spark.read.parquet(f"{path}/matrix").join(held, "chunk_id").groupBy("source").agg(F.count("embedding").alias("n_matrix"))
    return spark.read.parquet(f"{path}/report").join(metadata, "source").join(matrix, "source", "left").na.fill(0, ["n_matrix"])


@query("unified_corpus", "SELECT 'pdf' AS source_type, doc_id AS chunk_id, length(text)::BIGINT AS n_chars, length(text)::DOUBLE AS first FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'website', page_id, length(html)::BIGINT, 1.0::DOUBLE FROM pages")
def unified_corpus(spark, sf_dir):
    """The corpus of chunks and pages with vectors, joined with its index after both were written."""
    path = fresh(spark, "unified")
    web_part = table(spark, sf_dir, "pages").select(F.col("page_id").alias("chunk_id"), F.lit("website").alias("source_type"), F.col("html").alias("chunk_text"), F.array(F.lit(1.0)).alias("embedding"), F.col("url").alias("source_url"))
    sinks.write_corpus([chunks(spark, sf_dir).withColumn("source_type", F.lit("pdf")).withColumn("chunk_id", F.col("chunk_id") * 2), web_part.withColumn("chunk_id", F.col("chunk_id") * 2 + 1)], path)
    both = spark.read.parquet(f"{path}/corpus").join(spark.read.parquet(f"{path}/index"), "chunk_id")
    return both.select(F.col("source_type").cast("string").alias("source_type"), F.shiftright("chunk_id", 1).alias("chunk_id"), F.length("chunk_text").cast("long").alias("n_chars"), F.get("embedding", F.lit(0)).alias("first"))


@query("build_once", "SELECT source, count(*) AS n, 1 AS builds FROM documents GROUP BY source")
def build_once(spark, sf_dir):
    """A table asked for twice is built once."""
    path, builds = fresh(spark, "built"), []

    def build():
        builds.append(1)
        return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))

    sinks.built_once(spark, path, build)
    return sinks.built_once(spark, path, build).withColumn("builds", F.lit(len(builds)))


@query("line_list", "SELECT url FROM pages")
def line_list(spark, sf_dir):
    """Addresses written under a comment and read as a list of lines."""
    path = fresh(spark, "lines")
    sinks.write_lines(table(spark, sf_dir, "pages"), "url", path, ["addresses", "http://not.an.address/of/the/list"])
    return spark.read.text(path).select(web.parse_url_line(F.col("value")).alias("url")).where("url is not null")


class StubSegmenter:
    """Replies by the number in unit_id: to some at once, to some after a repair, to some never as asked."""

    def complete(self, prompts: list[str]) -> list[str]:
        return [self.reply(p) for p in prompts]

    def reply(self, prompt: str) -> str:
        unit = re.search(r"^unit_id: (\w+)$", prompt, re.M)[1]
        n, content = int(unit[1:]), prompt.split("\n\ncontent:\n", 1)[1].split("\n\nYour reply was:\n")[0]
        half = len(content) // 2
        parts = [{"segment_index": 1, "title": "b", "content_type": "other", "content": content[half:]}, {"segment_index": 0, "title": "a", "content_type": "other", "content": content[:half], "metadata": {"title": "own"}}]
        repaired = "cannot be used" in prompt
        if n % 6 == 1 and not repaired:
            return "no object"
        if n % 6 == 2 and not repaired:
            parts[0]["segment_index"] = 0
        if n % 6 == 3:
            parts[0]["content"] = "zzyzx quux words that the unit lacks"
        return "```json\n" + json.dumps({"unit_id": "u0" if n % 6 == 4 and not repaired else unit, "is_multi_topic": True, "reasoning_brief": "", "segments": parts}) + "\n```"


def segmented(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    units = docs.select("doc_id", F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("unit_id"), F.when(F.col("doc_id") % 2 == 0, "scholarly_paper_pdf").otherwise("website_page").alias("document_type"), F.lit("pdf").alias("source_type"), "source", none.alias("url"), F.col("source").alias("title"), none.alias("section"), F.col("text").alias("content"))
    wants = (F.length("content") >= 1000) | classify.is_noisy(F.col("content"))
    return segmentation.segment_units(units, wants, StubSegmenter)


NOISE = "(length(text) - length(replace(text, concat(chr(10), chr(10)), ''))) / 2 > 25 OR (length(text) - length(replace(text, '•', ''))) + (length(text) - length(replace(text, '- ', ''))) / 2 > 40"


@query("segment_route", f"SELECT doc_id, CASE WHEN NOT (length(text) >= 1000 OR {NOISE}) THEN 'single' WHEN doc_id % 6 = 3 THEN 'fallback' WHEN doc_id % 6 IN (1, 2) OR doc_id % 6 = 4 THEN 'repaired' ELSE 'model' END AS route FROM documents")
def segment_route(spark, sf_dir):
    return segmented(spark, sf_dir).select("doc_id", "route")


@query("segment_merge", f"SELECT doc_id, 'own' AS title, source, length(trim(substr(text, 1, (length(text) // 2)::INT), chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)))::BIGINT AS n_chars FROM documents WHERE (length(text) >= 1000 OR {NOISE}) AND doc_id % 6 <> 3")
def segment_merge(spark, sf_dir):
    """The first segment of every usable reply: what it says of itself, and what is known of its unit."""
    s = F.get("segments", F.lit(0))
    rows = segmented(spark, sf_dir).where("route in ('model', 'repaired')").select("doc_id", s["metadata"]["title"].alias("title"), s["metadata"]["source"].alias("source"), F.length(s["content"]).cast("long").alias("n_chars"))
    return rows
