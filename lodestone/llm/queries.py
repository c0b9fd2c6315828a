"""The registered query of each operator, and SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bagminhash, exact_dedup, frequency_filter, fuzzy_lines, html_extract, language_id, merge_dropout, packing, secret_scan, token_files, winnowing, yinyang
from lodestone.llm.common import shared_dir, table


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(token_files.encode_documents(table(spark, sf_dir, "documents")), path)
    return token_files.digest(spark, path)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), keep_ids=False, cache_chunks=900_000).drop("ids")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secret_scan(table(spark, sf_dir, "documents")))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.recode(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.learn(docs))
    return found.select("doc_id", (language_id.remainder() == 2).alias("held_out"), "lang_pred", "score")


def op7_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_dedup(table(spark, sf_dir, "documents"))


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.dedup_lines(table(spark, sf_dir, "documents"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited_fingerprints(table(spark, sf_dir, "documents"))


def op11_frequency_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency_filter.lm_score(table(spark, sf_dir, "documents"))


def op12_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_html_extract, op3_exact_dedup, op4_language_id, op5_token_files, op6_packing, op7_bagminhash, op8_fuzzy_lines, op9_winnowing, op10_secret_scan, op11_frequency_filter, op12_yinyang)}
ORACLE_SQL = {"op3_exact_dedup": exact_dedup.ORACLE, "op12_yinyang": yinyang.oracle()}
