"""Writers: JSON, artifacts of documents, the unified corpus with its index, tables that are built once, lists of lines.

All paths are Hadoop paths; parents are made by Spark's writers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line in UTF-8, null fields included."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_artifacts(chunks: DataFrame, path: str, source: str = "source", vector: str = "embedding", mode: str = "overwrite") -> None:
    """Under path: chunks (all columns) and metadata (no vectors), both in a folder a source; matrix (chunk_id and vector); report (a row a source)."""
    chunks.write.mode(mode).partitionBy(source).parquet(f"{path}/chunks")
    write_json(chunks.drop(vector), f"{path}/metadata", mode)
    chunks.select("chunk_id", vector).where(F.col(vector).isNotNull()).write.mode(mode).parquet(f"{path}/matrix")
    report = chunks.groupBy(source).agg(F.count("*").alias("n_chunks"), F.count(vector).alias("n_vectors"), F.sum(F.length("chunk_text")).alias("n_chars"))
    report.write.mode(mode).parquet(f"{path}/report")


def write_corpus(parts: list[DataFrame], path: str, vector: str = "embedding", mode: str = "overwrite") -> None:
    """Chunks of all parts as one corpus, in a folder a source type, without rows that lack a vector; and the index of their vectors."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    both = both.where(F.size(vector) > 0)
    both.drop(vector).write.mode(mode).partitionBy("source_type").parquet(f"{path}/corpus")
    both.select("chunk_id", vector).write.mode(mode).parquet(f"{path}/index")


def built_once(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; where none was written whole, build() is called and written there first."""
    if not exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_lines(df: DataFrame, column: str, path: str, comments: list[str], mode: str = "overwrite") -> None:
    """A text file a partition; the first holds the comments, each after a # sign."""
    head = df.sparkSession.createDataFrame([(f"# {c}",) for c in comments], "value string").coalesce(1)
    head.unionByName(df.select(F.col(column).cast("string").alias("value"))).write.mode(mode).text(path)
