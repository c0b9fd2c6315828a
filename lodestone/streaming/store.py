"""A store of live sessions over a stream of accesses: idle ones expire, the one used least recently makes room, the last turns are kept.

Accesses are dealt to shards, each a store of its own like one server's memory. They wait until the watermark has passed them and
are then taken in order of event time, so that results do not depend on how files and batches cut the stream. A shard's state is
its waiting accesses and at most `most` live sessions.
"""

from __future__ import annotations

from collections import Counter, OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.functions import rules

#: Accesses that are unpacked at once, and that a row of the waiting list holds.
SLICE = 10_000
#: Stores of up to so many sessions are worked out by whole columns, a step for each other session; larger ones access by access.
SMALL_STORE = 16
#: Accesses that are worked out together.
TOGETHER = 500_000
CLOSED = "shard long, session long, start long, end long, n long, turns array<bigint>, reason string"


class SessionStore(StatefulProcessor):
    """State of one shard. Emits a row for each session that ends: by idle time over the limit, or evicted."""

    def __init__(self, most: int, ttl_s: float, turns: int):
        self.most, self.ttl, self.turns = most, int(ttl_s * 1e6), turns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # A row of it is a batch of accesses, 24 bytes each: a list of single ones would be read and written row by row.
        self.waiting = handle.getListState("waiting", "accesses binary")
        self.live = handle.getMapState("live", "session long", "start long, last long, n long, turns array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, fresh = timerValues.getCurrentWatermarkInMs() * 1000, []
        for part in rows:
            if len(part):
                fresh += [(x,) for x in part["accesses"]] if "accesses" in part else [(part[["at", "event", "session"]].to_numpy("i8").tobytes(),)]
        # Once a batch: the state store reads a whole list again for each value that is added to it.
        self.waiting.appendList(fresh)
        first = min((int(np.frombuffer(x, "i8")[::3].min()) for (x,) in fresh), default=mark)
        if first > mark:  # what waits is read once it is due
            self.wake(first // 1000 + 1)
        else:
            yield from self.advance(key, mark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.advance(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass

    def wake(self, due: int) -> None:
        """One timer, at the earlier of due and what is set."""
        timers = list(self.handle.listTimers())
        for timer in timers:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(min([due, *timers]))

    def advance(self, key, mark: int) -> Iterator[pd.DataFrame]:
        """Takes in order the accesses up to the watermark, then ends what is idle by then."""
        rows = np.frombuffer(b"".join(r[0] for r in self.waiting.get()), "i8").reshape(-1, 3)
        ready, later = rows[rows[:, 0] <= mark], rows[rows[:, 0] > mark]
        ready = ready[np.lexsort(ready.T[::-1])]
        held = sorted(((k[0], tuple(v)) for k, v in self.live.iterator()), key=lambda x: (x[1][1], x[1][3][-1]))
        before, work = dict(held), by_columns if self.most <= SMALL_STORE else by_access
        for start in range(0, max(len(ready), 1), TOGETHER):
            some, on = ready[start : start + TOGETHER], start + TOGETHER < len(ready)
            live, out = work(held, some, int(some[-1, 0]) if on else mark, self.most, self.ttl, self.turns)
            held = list(live.items())
            for at in range(0, out.num_rows, SLICE):
                found = out.slice(at, SLICE).to_pandas()
                found.insert(0, "shard", int(key[0]))
                yield found
        for session in before.keys() - live.keys():
            self.live.removeKey((session,))
        for session, value in live.items():
            if before.get(session) != value:
                self.live.updateValue((session,), value)
        if len(ready):
            self.waiting.put([(later[i : i + SLICE].tobytes(),) for i in range(0, len(later), SLICE)]) if len(later) else self.waiting.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = [int(later[:, 0].min()) // 1000 + 1] if len(later) else []
        due += [(next(iter(live.values()))[1] + self.ttl) // 1000 + 1] if live else []
        if due:
            self.handle.registerTimer(max(min(due), mark // 1000 + 1))


def partitions(spark: SparkSession, shards: int) -> int:
    """So many partitions of state that shards meet in none where that can be: each costs a store and a worker in every batch, however many of them are empty."""
    tried = range(shards, 4 * shards + 1)
    places = spark.range(shards).select([F.pmod(F.hash("id"), F.lit(n)) for n in tried]).collect()
    return min(tried, key=lambda n: (max(Counter(r[n - shards] for r in places).values()), n))


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, session, event, at, time) as a row a shard and batch: (shard, accesses, time), accesses as they wait, and the latest time."""
    for batch in batches:
        shards = batch.column(0).to_numpy()
        rows = np.stack([batch.column(i).to_numpy() for i in (3, 2, 1)], axis=1)
        found, last = np.unique(shards), []
        for shard in found:
            last.append(int(np.flatnonzero(shards == shard)[np.argmax(rows[shards == shard, 0])]))
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([rows[shards == s].tobytes() for s in found], pa.binary()), batch.column(4).take(pa.array(last, pa.int64()))], ["shard", "accesses", "time"])


def ended(session: int, value: tuple, reason: str) -> tuple:
    start, last, n, turns = value
    return session, start, last, n, list(turns), reason


def expire(live: OrderedDict, out: list, now: int, ttl: int) -> None:
    """Ends the sessions whose idle time is over the limit; live is in order of last access."""
    while live and now - next(iter(live.values()))[1] > ttl:
        out.append(ended(*live.popitem(last=False), "idle"))


def take(live: OrderedDict, out: list, at: int, event: int, session: int, most: int, ttl: int, turns: int) -> None:
    """One access: it goes on with its session, or begins one and makes room for it."""
    expire(live, out, at, ttl)
    start, _, n, held = live.pop(session, (at, at, 0, ()))
    if not n and len(live) >= most:
        out.append(ended(*live.popitem(last=False), "evicted"))
    live[session] = start, at, n + 1, (*held, event)[-turns:]


#: What an advance gives: live sessions in order of last access, and a table of those that ended.
Advanced = tuple[OrderedDict, pa.Table]
ENDED = pa.schema([("session", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("n", pa.int64()), ("turns", pa.list_(pa.int64())), ("reason", pa.string())])


def by_access(held: list[tuple[int, tuple]], ready: np.ndarray, mark: int, most: int, ttl: int, turns: int) -> Advanced:
    """From live sessions (session, (start, last, n, turns)) in order of last access and accesses (at, event, session) in order, up to mark: one access after another."""
    live, out = OrderedDict(held), []
    for start in range(0, len(ready), SLICE):
        for at, event, session in ready[start : start + SLICE].tolist():
            take(live, out, at, event, session, most, ttl, turns)
    expire(live, out, mark, ttl)
    return live, pa.table([list(c) for c in zip(*out)] or [[] for _ in ENDED], schema=ENDED)


def pushed_out(at: np.ndarray, before: np.ndarray, after: np.ndarray, most: int, ttl: int) -> np.ndarray:
    """Whether each access, if its session's last, is followed by so many other sessions before its idle time is over; before, after: its session's neighbouring accesses."""
    ends = np.minimum(after, np.searchsorted(at, at + ttl, "right"))
    out, i = np.zeros(len(at), bool), np.flatnonzero(ends - np.arange(len(at)) > most)
    j, others = i + 1, np.zeros(len(i), "i8")
    while len(i) > most:
        others += before[j] < i  # the first access of its session after i
        j += 1
        out[i[others == most]] = True
        on = np.flatnonzero((others < most) & (j < ends[i]))
        i, j, others = i[on], j[on], others[on]
    for one, start, n in zip(i, j, others):  # few, but each may go on for long
        while n < most and start < ends[one]:
            n += np.count_nonzero(before[start : min(start + SLICE, ends[one])] < one)
            start += SLICE
        out[one] = n >= most
    return out


def by_columns(held: list[tuple[int, tuple]], ready: np.ndarray, mark: int, most: int, ttl: int, turns: int) -> Advanced:
    """by_access() without a step for each access: a live session counts as an access at its last one."""
    carried = np.array([(v[1], 0, k) for k, v in held], "i8").reshape(-1, 3)
    at, event, session = np.concatenate([carried, ready]).T.copy()
    total, old = len(at), len(held)
    order = np.argsort(session, kind="stable")
    same = session[order[1:]] == session[order[:-1]]
    before, after = np.full(total, -1), np.full(total, total)
    before[order[1:][same]], after[order[:-1][same]] = order[:-1][same], order[1:][same]
    evicted = pushed_out(at, before, after, most, ttl)
    ends = evicted | (np.concatenate([at, [mark]])[after] - at > ttl)
    firsts = np.flatnonzero(np.concatenate([np.ones(min(1, total), bool), ~same | ends[order[:-1]]]))
    stops = np.append(firsts[1:], total)[: len(firsts)]
    first, last, n = order[firsts], order[stops - 1], stops - firsts
    start, end, known = at[first], at[last], np.flatnonzero(first < old)
    start[known] = np.array([held[i][1][0] for i in first[known]], "i8")
    said = {int(g): held[first[g]][1] for g in known}  # of a session that was live, its turns so far, and of its accesses all but the first
    counts = n.copy()
    counts[known] += np.array([said[int(g)][2] - 1 for g in known], "i8")

    def turns_of(g: int) -> list[int]:
        own = event[order[firsts[g] + (g in said) : stops[g]]][-turns:].tolist()
        return [*(said[g][3] if g in said else ()), *own][-turns:]

    gone, stay = np.flatnonzero(ends[last]), np.flatnonzero(~ends[last])
    live = OrderedDict((int(session[last[g]]), (int(start[g]), int(end[g]), int(counts[g]), tuple(turns_of(int(g))))) for g in stay[np.argsort(last[stay])])
    odd = [g for g in gone.tolist() if g in said] if len(said) else []
    plain = np.setdiff1d(gone, odd)
    kept = np.minimum(n[plain], turns)
    offsets = np.concatenate([[0], np.cumsum(kept)])
    places = np.arange(offsets[-1]) - np.repeat(offsets[:-1], kept) + np.repeat(stops[plain] - kept, kept)
    lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(event[order[places]])), pa.array([turns_of(g) for g in odd], pa.list_(pa.int64()))]
    tables = []
    for some, held_turns in zip((plain, np.array(odd, "i8")), lists):
        reason = pa.DictionaryArray.from_arrays(pa.array(evicted[last[some]].astype("i4")), ["idle", "evicted"]).cast(pa.string())
        tables.append(pa.table([session[last[some]], start[some], end[some], counts[some], held_turns, reason], schema=ENDED))
    return live, pa.concat_tables(tables)


def stamped(events: DataFrame, at: str) -> Column:
    """Event time with a zone; that of a table without one is taken as the session's."""
    return F.col(at).cast("timestamp")


def ended_sessions(events: DataFrame, session: str, event: str, at: str, shards: int, most: int = rules.MAX_SESSIONS, ttl_s: float = rules.SESSION_TTL_S, turns: int = rules.SESSION_TURNS, delay: str = "10 minutes", pack: bool = False) -> DataFrame:
    """A stream of accesses to a stream of ended sessions: shard, session, start, end, n, turns (the last ones' events), reason.

    Sessions are longs, dealt to shards by remainder; a null session or time is left out. Accesses later than delay are dropped and counted in
    the stream's progress; those that the watermark has not passed yet wait in the state.
    pack: for streams of which nothing comes late. Accesses then reach the store thousands to a row, as PySpark takes 10 us for each row; late ones would not be seen.
    """
    when = stamped(events, at)
    rows = events.where(F.col(session).isNotNull() & when.isNotNull()).select(F.pmod(F.col(session), F.lit(shards)).alias("shard"), F.col(session).alias("session"), F.col(event).alias("event"), F.unix_micros(when).alias("at"), when.alias("time"))
    if pack:
        rows = rows.mapInArrow(packed, "shard long, accesses binary, time timestamp")
    found = rows.withWatermark("time", delay).groupBy("shard").transformWithStateInPandas(SessionStore(most, ttl_s, turns), CLOSED, "Append", "EventTime")
    micros = [F.timestamp_micros(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")]
    return found.select("shard", "session", *micros, "n", "turns", "reason")


def interval_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, within: str, delay: str) -> DataFrame:
    """Rows of left with the rows of right of the same key that came at most `within` before; batch and stream.

    Both sides carry watermarks on a stream, so that each keeps only what may still be joined. Columns but the key must differ.
    """
    sides = []
    for df, at in ((left, left_at), (right, right_at)):
        df = df.withColumn(f"_{at}", stamped(df, at))
        sides.append(df.withWatermark(f"_{at}", delay) if df.isStreaming else df)
    a, b = sides[0], sides[1].withColumnRenamed(key, "_key")
    near = (F.col(f"_{right_at}") <= F.col(f"_{left_at}")) & (F.col(f"_{right_at}") >= F.col(f"_{left_at}") - F.expr(f"interval {within}"))
    return a.join(b, (F.col(key) == F.col("_key")) & near).drop("_key", f"_{left_at}", f"_{right_at}")
