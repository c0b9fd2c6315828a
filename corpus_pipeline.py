"""From documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last
return the columns of documents. run() writes and rereads every stage's result in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bagminhash, fuzzy_lines, language_id, packing, secret_scan
from lodestone.llm.common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; null texts and texts without a letter go."""
    found = language_id.identify(docs, language_id.learn(docs), carry=["text", "lang", "source", "n_chars"])
    return found.where("lang_pred <> 'und'").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand elsewhere; documents of which nothing but white space is left go."""
    found = fuzzy_lines.dedup_lines(docs, carry=["lang", "source"])
    left = found.where(F.col("text").isNull() | (F.col("n_kept") == F.col("n_lines")) | F.col("text").rlike(r"(?U)\S"))
    return left.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return bagminhash.drop_near_copies(docs.select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    found = secret_scan.secret_scan(docs, carry=["lang", "source"])
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_copies), ("secret_scan", secrets), ("packing", sequences)]
#: SQL can express neither the models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, as packing.pack_documents() gives them, from all documents.

    Null texts and texts without a letter go in the first stage. Rows that repeat an id are documents of their own but
    in near-dedup, which keeps or drops all rows of an id; rows with a null id are never dropped as copies. An empty table has no pieces. Columns
    beyond those of documents are ignored.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
