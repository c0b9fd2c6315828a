"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row.

    A column used inside a higher-order function's lambda is evaluated for every element;
    binding it as a lambda variable first avoids that.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="lodestone-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return made


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """df written to Parquet in the shared folder and reread: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() gave, once all that is made of them is written."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


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


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that have run; it does so once the driver's JVM has collected what refers to them."""
    gc.collect()
    spark._jvm.System.gc()


_HELD: dict = {}


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """What make() gives, kept for all tasks of one operator that run in a worker process.

    A worker lives through the stages of a pipeline, so what another operator has kept is dropped first.
    """
    if name not in _HELD:
        _HELD.clear()
        give_back()
        _HELD[name] = make()
    return _HELD[name]


def give_back() -> None:
    """Returns freed memory to the system; called at the end of a task, as an idle worker would hold it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """run, a function from batches to batches, that gives memory back when it ends."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def carried(df: DataFrame, names: list[str], taken: list[str]) -> str:
    """DDL of columns that an operator passes on unchanged; they may not be called like its own."""
    if clash := set(names) & set(taken):
        raise ValueError(f"columns {sorted(clash)} are the operator's own")
    kinds = dict(df.dtypes)
    return "".join(f"`{c}` {kinds[c]}, " for c in names)


def unused(name: str, columns: list[str]) -> str:
    """name, with underscores before it while a column is called so."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


#: A key that holds at least one row in so many is heavy; there can be no more than so many heavy keys.
HEAVY_SHARE = 1000
#: Rows of a few longs that may be broadcast whole.
SMALL_ROWS = 200_000


def heavy_join(df: DataFrame, values: DataFrame, key: str, count: Column, rows: int, at_most: int | None = None, how: str = "left") -> DataFrame:
    """df joined, left or inner, to values, whose rows are unique by key and tell how many of the rows rows of df hold it.

    The values of heavy keys, at most HEAVY_SHARE rows, are broadcast, so that only rows of
    keys that are not heavy are shuffled by key. Where the caller knows that there are at_most SMALL_ROWS values, all
    are broadcast. values should be materialized: it is read twice, for an inner join three times, and df twice. Inner joins make rows
    of matches alone, so rows of df without one cost no more than the probe.
    """
    if at_most is not None and at_most <= SMALL_ROWS:
        return df.join(F.broadcast(values), key, how)
    own = [c for c in values.columns if c != key]
    heavy = F.broadcast(values.where(count * HEAVY_SHARE >= rows).withColumn("_heavy", F.lit(True)))
    light = values.where(count * HEAVY_SHARE < rows)
    if how == "inner":
        rest = df.join(F.broadcast(values.where(count * HEAVY_SHARE >= rows).select(key)), key, "left_anti").join(light, key)
        return df.join(F.broadcast(values.where(count * HEAVY_SHARE >= rows)), key).unionByName(rest)
    marked = df.join(heavy, key, "left")
    rest = marked.where(F.col("_heavy").isNull()).drop("_heavy", *own).join(light, key, "left")
    return marked.where(F.col("_heavy")).drop("_heavy").unionByName(rest)


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most key, by binary search; -1 for null."""
    if not bounds:
        return F.when(key.isNull(), -1).otherwise(0)
    array, steps = F.lit(bounds).cast("array<bigint>"), [1 << i for i in reversed(range(len(bounds).bit_length()))]
    found = F.aggregate(F.lit(steps), F.lit(0), lambda lo, s: F.when((lo + s <= len(bounds)) & (F.get(array, lo + s - 1) <= key), lo + s).otherwise(lo))
    return F.when(key.isNull(), -1).otherwise(found)
