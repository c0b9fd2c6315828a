"""The jobs over growing input, run again, and beside each other."""

from __future__ import annotations

import datetime
import json
import logging

import pytest
from comparison import oracle_rows, rows_of
from pyspark.sql import functions as F

from jobs import evidence_report, session_log
from lodestone.plans.stream_queries import sql_sessions

CONFIG = {"shards": 2, "most": 1, "ttl_s": 3600, "turns": 3, "delay": "600 seconds"}


@pytest.fixture
def incoming(spark, sf_dir, tmp_path):
    """Puts the events with numbers from lo to hi into the folder as a further file."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    names = iter("abcdef")

    def put(lo, hi):
        events.where((F.col("event_id") >= lo) & (F.col("event_id") < hi)).coalesce(1).write.parquet(str(tmp_path / "staged" / next(names)))
        (tmp_path / "events").mkdir(exist_ok=True)
        for part in (tmp_path / "staged").glob("*/part-*.parquet"):
            part.rename(tmp_path / "events" / part.name)
        return str(tmp_path / "events")

    return put


def expected(sf_dir, below):
    sql = sql_sessions(f"(SELECT * FROM events WHERE event_id < {below})", CONFIG["shards"], CONFIG["most"], CONFIG["ttl_s"], CONFIG["turns"], 600)
    return oracle_rows(sql, sf_dir, ["session", "start", "end", "n", "turns", "reason"])


def log_of(spark, out):
    return rows_of(session_log.sessions_of(spark, out).select("session", "start", "end", "n", F.array_join("turns", ","), "reason").collect())


def days_of(spark, out):
    found = session_log.daily(spark, out).select("day", "sessions", "evicted", "turns", "last_end").collect()
    plain = session_log.sessions_of(spark, out).groupBy("day").agg(F.count("*"), F.count_if(F.col("reason") == "evicted"), F.sum("n"), F.max("end")).collect()
    assert rows_of(found) == rows_of(plain)
    return len(found)


def test_session_log_takes_only_what_is_new(spark, sf_dir, tmp_path, incoming, caplog):
    caplog.set_level(logging.INFO, "session_log")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.streaming.stateStore.providerClass")}
    events = incoming(0, 500)
    assert session_log.run(spark, events, out, checkpoint, CONFIG)["read"] == 500
    assert log_of(spark, out) == expected(sf_dir, 500)
    first_days = days_of(spark, out)
    files = {p.name for p in (tmp_path / "out" / "sessions").rglob("*.parquet")}

    told = session_log.run(spark, events, out, checkpoint, CONFIG)
    assert told["read"] == 0 and log_of(spark, out) == expected(sf_dir, 500)
    assert {p.name for p in (tmp_path / "out" / "sessions").rglob("*.parquet")} <= files

    incoming(500, 1000)
    told = session_log.run(spark, events, out, checkpoint, CONFIG)
    assert (told["read"], told["late"]) == (500, 0) and told["days"] < days_of(spark, out)
    assert log_of(spark, out) == expected(sf_dir, 1000)
    assert any(r[5] == "evicted" for r in log_of(spark, out)) and days_of(spark, out) > first_days

    incoming(20, 40)
    assert session_log.run(spark, events, out, checkpoint, CONFIG)["late"] == 20
    assert log_of(spark, out) == expected(sf_dir, 1000)
    assert {k: spark.conf.get(k, None) for k in before} == before
    assert "read 500 accesses" in caplog.text and "ended sessions" in caplog.text


def test_session_log_over_no_events(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/events.parquet").limit(0).write.parquet(str(tmp_path / "events"))
    told = session_log.run(spark, str(tmp_path / "events"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), CONFIG)
    assert (told["read"], told["sessions"], told["days"]) == (0, 0, 0)


def tree(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_evidence_report_reruns_and_leaves_other_sets_alone(spark, tmp_path):
    docs = [(1, "a", "alpha beta gamma delta"), (2, "b", "iota iota epsilon"), (3, "a", None), (4, "c", "zeta eta theta alpha beta"), (5, "c", "References alpha beta gamma")]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(str(tmp_path / "docs"))
    spark.createDataFrame([(1, "alpha beta"), (2, "the epsilon"), (3, "nothing here")], "item_id long, text string").write.parquet(str(tmp_path / "one"))
    spark.createDataFrame([(9, "theta")], "item_id long, text string").write.parquet(str(tmp_path / "two"))
    config = json.loads(evidence_report.CONFIG.read_text()) | {"k": 2, "hits_at": [1, 2]}
    paths = [str(tmp_path / p) for p in ("docs", "one", "two", "out")]
    told = evidence_report.run(spark, paths[0], paths[1], paths[3], config)
    assert told["documents"] == 4  # one is of no use
    held = tree(tmp_path / "out" / "evidence" / "question_set=benchmark")
    evidence_report.run(spark, paths[0], paths[2], paths[3], config | {"question_set": "two"})
    assert tree(tmp_path / "out" / "evidence" / "question_set=benchmark") == held
    read = lambda part: rows_of(spark.read.parquet(f"{paths[3]}/{part}").collect())
    rows, figures = read("evidence"), read("summary")
    evidence_report.run(spark, paths[0], paths[1], paths[3], config)
    assert (read("evidence"), read("summary")) == (rows, figures)
    got = spark.read.parquet(f"{paths[3]}/summary").where("question_set = 'benchmark'").select("intent", "questions", "unanswered", "hits_at_1", "hits_at_2").collect()
    assert sorted(map(tuple, got)) == [("synthesis", 1, 0, 0, 0), ("topic_specific", 2, 1, 1, 1)]
    first = spark.read.parquet(f"{paths[3]}/evidence").where("query_id = 1 and rank = 1").first()
    assert first["holds"] and first["snippet"] == "alpha beta gamma delta"


def test_nothing_else_is_needed():
    for job in (evidence_report, session_log):
        source = open(job.__file__, encoding="utf-8").read()
        assert "llm" not in source and "corpus_pipeline" not in source
    assert datetime.timedelta(seconds=json.loads(session_log.CONFIG.read_text())["ttl_s"]) == datetime.timedelta(hours=1)
