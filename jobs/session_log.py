"""Keeps a log of ended sessions and its daily figures up to date as files of accesses come in.

    python -m jobs.session_log --events PATH --out PATH --checkpoint PATH [--config FILE]

Reads event files (event_id, ts, user_id) that earlier runs with the same checkpoint have not taken. Accesses go through stores of live sessions,
which end them by idle time or, where a store is full, by eviction. Writes under --out:

    sessions/day=...    a row for each ended session, by the day of its end; only added to
    daily/day=...       figures of a day's sessions; the days that a run may have added to are written anew

The checkpoint holds which files were taken and the sessions that are still live. A rerun without new files adds nothing; a run that follows
a broken one takes up where that left off, and the file sink leaves every session once.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.streaming import files, store

log = logging.getLogger("session_log")
CONFIG = Path(__file__).with_suffix(".json")
SESSIONS = "shard long, session long, start timestamp_ntz, end timestamp_ntz, n long, turns array<bigint>, reason string, day date"
DAILY = "sessions long, evicted long, turns long, longest_s double, last_end timestamp_ntz, day date"
DYNAMIC = {"spark.sql.sources.partitionOverwriteMode": "dynamic"}


def take_new(spark: SparkSession, events: str, out: str, checkpoint: str, config: dict) -> dict[str, int]:
    """Runs the stream over new files to its end."""
    rows = files.stream_table(spark, events, spark.read.parquet(events).select("event_id", "ts", "user_id").schema)
    ended = store.ended_sessions(rows, "user_id", "event_id", "ts", config["shards"], config["most"], config["ttl_s"], config["turns"], config["delay"])
    return files.drain(ended.withColumn("day", F.to_date("end")), f"{out}/sessions", checkpoint, partition_by=("day",), conf=files.ROCKSDB)


def sessions_of(spark: SparkSession, out: str) -> DataFrame:
    return files.read_written(spark, f"{out}/sessions", SESSIONS)


def daily(spark: SparkSession, out: str) -> DataFrame:
    return files.read_written(spark, f"{out}/daily", DAILY)


def refresh(spark: SparkSession, out: str, ttl_s: int) -> int:
    """Writes anew the days from the last one known on, less the idle limit: no session ends earlier than that after a run."""
    mark = daily(spark, out).agg(F.max("last_end")).first()[0]
    rows = sessions_of(spark, out)
    if mark is not None:
        rows = rows.where(F.col("day") >= F.to_date(F.lit(mark) - F.make_dt_interval(secs=F.lit(ttl_s))))
    length = (F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 1e6
    figures = rows.groupBy("day").agg(F.count("*").alias("sessions"), F.count_if(F.col("reason") == "evicted").alias("evicted"), F.sum("n").alias("turns"), F.max(length).alias("longest_s"), F.max("end").alias("last_end"))
    with files.settings(spark, DYNAMIC):
        figures.select("sessions", "evicted", "turns", "longest_s", "last_end", "day").repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{out}/daily")
    return figures.count()


def run(spark: SparkSession, events: str, out: str, checkpoint: str, config: dict) -> dict[str, int]:
    """The whole job; returns how many accesses it read, how many came too late, and how many days it wrote."""
    told = take_new(spark, events, out, checkpoint, config)
    log.info("read %d accesses from %s in %d batches, %d of them later than %s", told["read"], events, told["batches"], told["late"], config["delay"])
    told["days"] = refresh(spark, out, config["ttl_s"])
    told["sessions"] = sessions_of(spark, out).count()
    log.info("%s/sessions has %d ended sessions, %d days of %s/daily were written", out, told["sessions"], told["days"], out)
    return told


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("events", "out", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=CONFIG, type=Path)
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("session_log").getOrCreate()
    try:
        run(spark, args.events, args.out, args.checkpoint, json.loads(args.config.read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
