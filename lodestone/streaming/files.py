"""Streams over the files of a table: read what is new, run to the end, tell what was read, written and dropped."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: State that a processor keeps in several variables needs this store.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with these settings, which go back to what they were."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What was written to a Parquet table so far: no rows where nothing was."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def stream_table(spark: SparkSession, path: str, schema: StructType | None = None, files_a_batch: int | None = None) -> DataFrame:
    """A Parquet table, one file or a folder of them, as a stream of its files."""
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    # A stream takes a plain path for a folder; as a pattern it may name a file as well.
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def in_order(df: DataFrame, at: str, path: str, rows: int) -> bool:
    """Whether df has more than so many rows; if so it is written under path/in as files of about as many, in order of at, which a stream that takes
    a file a batch reads in that order: so what it has to hold back does not grow with the table."""
    spark, files = df.sparkSession, -(-df.count() // rows)
    if files <= 1:
        return False
    with settings(spark, {"spark.sql.adaptive.enabled": "false"}):
        df.repartitionByRange(files, at).write.parquet(f"{path}/ranges")
    for part in sorted(spark.read.parquet(f"{path}/ranges").inputFiles()):
        spark.read.schema(df.schema).parquet(part).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return True


def drain(df: DataFrame, out: str, checkpoint: str, mode: str = "append", partition_by: tuple[str, ...] = (), conf: dict[str, str] | None = None) -> dict[str, int]:
    """Runs a stream over all that is there and not yet taken, appending to Parquet at out; waits for its end.

    Returns rows read, rows dropped as later than the watermark, and batches. The file sink and the checkpoint make a rerun, after a
    failure or without new files, leave every row once.
    """
    with settings(df.sparkSession, conf or {}):
        query = df.writeStream.format("parquet").outputMode(mode).partitionBy(*partition_by).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()
    told = query.recentProgress
    return {"read": sum(p["numInputRows"] for p in told), "late": sum(s["numRowsDroppedByWatermark"] for p in told for s in p["stateOperators"]), "batches": len(told)}
