"""Session state over streams: what each session's last turns were, with expiry."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.functions import rules

OUTPUT = "session string, turns int, last_turn long, expired boolean"
STATE = "turns string, last double"


def ring(key, batches: Iterator[pd.DataFrame], state: GroupState, most: int, ttl_s: float) -> Iterator[pd.DataFrame]:
    """Keeps the session's last turns; a turn that comes after too long an idle time starts anew."""
    if state.hasTimedOut:
        state.remove()
        return
    turns, last = ([], None)
    if state.exists:
        saved = state.get
        turns, last = json.loads(saved[0]), saved[1]
    expired = False
    rows = pd.concat(list(batches)).sort_values(["at", "turn"])
    for r in rows.itertuples():
        at = r.at.timestamp()
        if last is not None and at - last > ttl_s:
            turns, expired = [], True
        turns, last = (turns + [int(r.turn)])[-most:], at
    state.update((json.dumps(turns), float(last)))
    state.setTimeoutDuration(int(ttl_s * 1000))
    yield pd.DataFrame({"session": [key[0]], "turns": [len(turns)], "last_turn": [turns[-1]], "expired": [expired]})


def session_state(turns: DataFrame, most: int = rules.SESSION_TURNS, ttl_s: float = rules.SESSION_TTL_S) -> DataFrame:
    """A streaming frame of (session, at, turn) to one row a session and trigger: turns held, the last one, whether an idle time ended the one before.

    Idle time is that between events; sessions that nobody calls go by processing time.
    """
    return turns.groupBy("session").applyInPandasWithState(lambda k, b, s: ring(k, b, s, most, ttl_s), OUTPUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def watermarked(events: DataFrame, at: str) -> bool:
    """Whether the column has a watermark already."""
    return "spark.watermarkDelayMs" in events.schema[at].metadata


def activity(events: DataFrame, at: str = "ts", late: str = "10 minutes", width: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Counts of events by kind in windows of event time, for batch and stream; events later than the watermark are left out of a stream."""
    marked = events.withWatermark(at, late) if events.isStreaming and not watermarked(events, at) else events
    return marked.groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")
