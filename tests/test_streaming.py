"""Session state and windows over streams."""

from __future__ import annotations

import datetime

import numpy as np
import pandas as pd
import pyarrow as pa

from lodestone.streaming import files, sessions, store


def run(spark, frame, mode: str, name: str, tmp_path):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_session_state(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [("a", t + datetime.timedelta(seconds=i), i) for i in range(12)] + [("b", t, 0), ("b", t + datetime.timedelta(seconds=4000), 1)]
    spark.createDataFrame(rows, "session string, at timestamp, turn int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session string, at timestamp, turn int").parquet(str(tmp_path / "in"))
    found = {r["session"]: tuple(r) for r in run(spark, sessions.session_state(stream), "update", "session_state", tmp_path)}
    assert found["a"] == ("a", 10, 11, False)
    assert found["b"] == ("b", 1, 1, True)


def test_windows_agree_with_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stamped = events.withColumn("ts", events["ts"].cast("timestamp"))
    stamped.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(stamped.schema).parquet(str(tmp_path / "events"))
    streamed = run(spark, sessions.activity(stream), "complete", "activity", tmp_path)
    assert sorted(map(str, streamed)) == sorted(map(str, sessions.activity(stamped).collect()))


def ended(spark, tmp_path, name, parts):
    """Rows of ended sessions after each part was added as a file and taken."""
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
        found = store.ended_sessions(files.stream_table(spark, str(tmp_path / name / "in")), "user_id", "event_id", "ts", 1, 2, 3600, 3)
        told = files.drain(found, str(tmp_path / name / "out"), str(tmp_path / name / "checkpoint"), conf=files.ROCKSDB)
        assert told["read"] == len(rows)
    out = spark.read.parquet(str(tmp_path / name / "out"))
    return sorted((r["session"], r["start"], r["n"], tuple(r["turns"]), r["reason"]) for r in out.collect())


def test_sessions_do_not_depend_on_how_the_stream_is_cut(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    at = [(0, 1), (60, 2), (120, 1), (180, 3), (240, 1), (300, 1), (4000, 2), (4100, 3), (4200, 1), (20000, 9), (40000, 9)]
    rows = [(i, t + datetime.timedelta(seconds=s), u) for i, (s, u) in enumerate(at)] + [(99, None, 1), (98, t, None)]
    whole = ended(spark, tmp_path, "whole", [rows])
    swapped = [rows[:3] + rows[4:5], rows[3:4] + rows[5:8], rows[8:]]  # one comes late, but not too late
    assert ended(spark, tmp_path, "cut", swapped) == whole
    naive = lambda s: t + datetime.timedelta(seconds=s)
    assert whole == sorted([(2, naive(60), 1, (1,), "evicted"), (1, naive(0), 4, (2, 4, 5), "idle"), (3, naive(180), 1, (3,), "idle"), (2, naive(4000), 1, (6,), "evicted"), (3, naive(4100), 1, (7,), "idle"), (1, naive(4200), 1, (8,), "idle"), (9, naive(20000), 1, (9,), "idle")])


def test_interval_join_is_the_same_on_batch_and_stream(spark, sf_dir, tmp_path):
    def sides(read):
        rows = read(f"{sf_dir}/events.parquet")
        return [rows.where(f"event_type = '{k}'").selectExpr("user_id", f"event_id as {k}", f"ts as {k}_at") for k in ("purchase", "view")]

    def joined(read):
        return store.interval_join(*sides(read), "user_id", "purchase_at", "view_at", "1 day", "10 minutes").select("purchase", "view")

    files.drain(joined(lambda p: files.stream_table(spark, p)), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    streamed = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert streamed == sorted(map(tuple, joined(spark.read.parquet).collect())) and len(streamed) > 5


def test_waiting_accesses_are_kept_in_batches():
    """A shard's list of waiting accesses has a row a batch, not a row an access."""
    class State:
        def __init__(self):
            self.rows = []

        def appendValue(self, row):
            self.rows.append(row)

        def appendList(self, rows):
            self.rows += rows

        put = lambda self, rows: setattr(self, "rows", list(rows))
        get = lambda self: iter(self.rows)
        clear = lambda self: self.rows.clear()
        iterator = lambda self: iter(())
        updateValue = removeKey = lambda *_: None

    class Handle:
        listTimers = lambda self: iter(())
        registerTimer = deleteTimer = lambda *_: None

    class Mark:
        at = 0
        getCurrentWatermarkInMs = lambda self: self.at

    kept, mark = store.SessionStore(5, 1, 3), Mark()
    kept.handle, kept.waiting, kept.live = Handle(), State(), State()
    parts = [pd.DataFrame({"at": range(n, n + 5000), "event": range(5000), "session": 1}) for n in (10**9, 10**9 + 5000)]
    assert list(kept.handleInputRows((0,), iter(parts), mark)) == [] and len(kept.waiting.rows) == 2
    mark.at = 1_000_004  # the first 4001 accesses have passed, and none of their sessions is idle yet
    assert list(kept.handleExpiredTimer((0,), mark, None)) == [] and len(kept.waiting.rows) == 1
    mark.at = 10**7
    (out,) = kept.handleExpiredTimer((0,), mark, None)
    assert out["n"].tolist() == [5999] and kept.waiting.rows == []


def test_sessions_by_columns_are_those_by_access():
    rng = np.random.default_rng(1)
    for _ in range(150):
        most, ttl, users, n, turns = (int(rng.integers(*x)) for x in ((1, 6), (1, 60), (1, 12), (0, 120), (1, 5)))
        rows = np.stack([rng.integers(0, 400, n), np.arange(n), rng.integers(0, users, n)], axis=1)
        rows = rows[np.lexsort(rows.T[::-1])]
        held, out, before = {store.by_access: [], store.by_columns: []}, {store.by_access: [], store.by_columns: []}, -1
        for mark in [*sorted(rng.integers(0, 401, 2).tolist()), int(rng.integers(390, 500))]:
            for work in held:
                live, found = work(held[work], rows[(rows[:, 0] > before) & (rows[:, 0] <= mark)], mark, most, ttl, turns)
                held[work] = list(live.items())
                out[work] += found.to_pylist()
            before = mark
        assert held[store.by_access] == held[store.by_columns]
        assert sorted(map(str, out[store.by_access])) == sorted(map(str, out[store.by_columns]))


def test_accesses_are_packed_and_added_to_the_list_at_once():
    """The state store reads the whole list again for each value that is added, so a batch adds all its values in one call."""
    at = pa.array([5, 9, 7, 8], pa.timestamp("us"))
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 0, 1]), pa.array([2, 3, 4, 5]), pa.array([10, 11, 12, 13]), pa.array([5, 9, 7, 8]), at], ["shard", "session", "event", "at", "time"])
    (rows,) = store.packed(iter([batch]))
    assert [(r["shard"], np.frombuffer(r["accesses"], "i8").tolist()) for r in rows.to_pylist()] == [(0, [5, 10, 2, 7, 12, 4]), (1, [9, 11, 3, 8, 13, 5])]
    assert rows.column(2).cast(pa.int64()).to_pylist() == [7, 9]
    calls, timers = [], []

    class Waiting:
        appendValue = None
        appendList = lambda self, rows: calls.append(list(rows))

    class Handle:
        listTimers = lambda self: iter(timers)
        registerTimer = lambda self, x: timers.append(x)
        deleteTimer = lambda self, x: timers.remove(x)

    class Mark:
        getCurrentWatermarkInMs = lambda self: 0

    kept = store.SessionStore(5, 1, 3)
    kept.handle, kept.waiting = Handle(), Waiting()
    assert list(kept.handleInputRows((0,), iter([rows.to_pandas()] * 3), Mark())) == []
    assert len(calls) == 1 and len(calls[0]) == 6 and timers == [1]


def test_a_large_table_comes_as_files_in_order_of_time(spark, tmp_path):
    rows = spark.range(100).selectExpr("id as event_id", "timestamp_micros((id * 37) % 100 * 1000000) as ts")
    assert not files.in_order(rows, "ts", str(tmp_path / "small"), 100)
    assert files.in_order(rows, "ts", str(tmp_path / "large"), 30)
    held = sorted((tmp_path / "large" / "in").glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    parts = [[r["ts"] for r in spark.read.parquet(str(p)).collect()] for p in held]
    assert len(parts) == 4 and sum(map(len, parts)) == 100 and all(max(a) < min(b) for a, b in zip(parts, parts[1:]))
    places = [r[0] for r in spark.range(2).selectExpr(f"pmod(hash(id), {store.partitions(spark, 2)})").collect()]
    assert len(set(places)) == 2
