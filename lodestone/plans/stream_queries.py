"""Queries that run a stream to its end and return what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions.storage import ensure_checkpoint_dir
from lodestone.plans.registry import query, table
from lodestone.streaming import files, store
from lodestone.streaming import sessions as windows

SHARDS, MOST, DELAY_S = 2, 5, 600
#: Events that a batch takes from a large table.
FILE_ROWS = 3_000_000


def sql_sessions(source: str, shards: int = SHARDS, most: int = MOST, ttl_s: int = 3600, turns: int = 10, delay_s: int = DELAY_S) -> str:
    """Ended sessions by self-joins: an access ends its session when it is the last for over ttl_s, or when so many others came before its next."""
    return f"""WITH ev AS (SELECT event_id, user_id, user_id % {shards} AS shard, epoch_us(ts) AS us FROM {source} WHERE user_id IS NOT NULL AND ts IS NOT NULL),
m AS (SELECT ((SELECT max(us) FROM ev) // 1000 - {delay_s * 1000}) * 1000 AS mark), o AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY us, event_id) AS i FROM ev, m WHERE us <= mark),
others AS (SELECT a.shard, a.i, b.user_id, min(b.i) AS first, min(b.us) AS first_at FROM o a JOIN o b ON a.shard = b.shard AND b.i > a.i AND b.us <= a.us + {ttl_s * 1000000} AND b.user_id <> a.user_id GROUP BY ALL),
pushed AS (SELECT shard, i, first AS gone FROM (SELECT *, row_number() OVER (PARTITION BY shard, i ORDER BY first) AS n FROM others) q WHERE n = {most}),
nx AS (SELECT o.*, gone, lead(o.i) OVER w AS next_i, lead(us) OVER w AS next_at FROM o LEFT JOIN pushed USING (shard, i) WINDOW w AS (PARTITION BY user_id ORDER BY o.i)),
x AS (SELECT *, gone IS NOT NULL AND (next_i IS NULL OR gone < next_i) AS evicted FROM nx),
y AS (SELECT *, evicted OR coalesce(next_at - us > {ttl_s * 1000000}, mark - us > {ttl_s * 1000000}) AS ends FROM x),
z AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS number FROM y),
g AS (SELECT shard, user_id AS session, number, min(us) AS s, max(us) AS e, count(*) AS n, list(event_id ORDER BY i)[-{turns}:] AS turns, bool_or(evicted) AS evicted, bool_or(ends) AS ended FROM z GROUP BY ALL)
SELECT shard, session, make_timestamp(s) AS start, make_timestamp(e) AS "end", n, array_to_string(turns, ',') AS turns, CASE WHEN evicted THEN 'evicted' ELSE 'idle' END AS reason FROM g WHERE ended"""


@query("stream_sessions", sql_sessions("events"))
def stream_sessions(spark, sf_dir):
    """Sessions that ended in stores of five, over the events as a stream: by idle time or pushed out. One batch takes all, or batches come in order of time, so none is late."""
    at = f"{ensure_checkpoint_dir(spark)}/stream-sessions-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    if files.in_order(events, "ts", at, FILE_ROWS):
        stream = files.stream_table(spark, f"{at}/in", events.schema, 1)
    else:
        stream = files.stream_table(spark, f"{sf_dir}/events.parquet")
    found = store.ended_sessions(stream, "user_id", "event_id", "ts", SHARDS, MOST, delay=f"{DELAY_S} seconds", pack=True)
    files.drain(found, f"{at}/out", f"{at}/checkpoint", conf=files.ROCKSDB | {"spark.sql.shuffle.partitions": str(store.partitions(spark, SHARDS))})
    return spark.read.parquet(f"{at}/out").withColumn("turns", F.array_join("turns", ","))


ARRIVAL = "epoch_us(ts) + CASE WHEN event_id % 50 = 0 THEN 10800000000 WHEN event_id % 7 = 0 THEN 400000000 ELSE 0 END"


@query(
    "stream_late_events",
    f"""WITH a AS (SELECT event_id, ts, event_type, value, ntile(5) OVER (ORDER BY {ARRIVAL}, event_id) AS batch FROM events),
m AS (SELECT batch, (max(max(epoch_us(ts))) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 1000 - 600000) * 1000 AS mark FROM a GROUP BY batch),
k AS (SELECT a.*, mark IS NOT NULL AND epoch_us(ts) <= mark AS late FROM a JOIN m USING (batch)), w AS (SELECT ((SELECT max(epoch_us(ts)) FROM a) // 1000 - 600000) * 1000 AS mark)
SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM k, w WHERE NOT late AND epoch_us(date_trunc('hour', ts)) + 3600000000 <= w.mark GROUP BY 1, 2
UNION ALL SELECT NULL, 'late', count(*), NULL FROM k WHERE late""",
)
def stream_late_events(spark, sf_dir):
    """Counts of closed hours over events that arrive in five files, some after the watermark; the last row counts those left out.

    Events pass a check for repeats first, which is where late ones are dropped and counted one by one.
    """
    at = f"{ensure_checkpoint_dir(spark)}/stream-late-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events")
    moved = F.unix_micros(F.col("ts").cast("timestamp")) + F.when(F.col("event_id") % 50 == 0, 10_800_000_000).when(F.col("event_id") % 7 == 0, 400_000_000).otherwise(0)
    dealt = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", F.ntile(5).over(Window.orderBy(moved, "event_id")).alias("batch"))
    dealt.write.parquet(f"{at}/dealt")
    dealt = spark.read.parquet(f"{at}/dealt")
    for batch in range(1, 6):
        dealt.where(F.col("batch") == batch).drop("batch").coalesce(1).write.mode("append").parquet(f"{at}/in")
        once = files.stream_table(spark, f"{at}/in", dealt.drop("batch").schema).withWatermark("ts", "10 minutes").dropDuplicatesWithinWatermark(["event_id"])
        told = files.drain(windows.activity(once), f"{at}/out", f"{at}/checkpoint")
        late = told["late"] if batch == 1 else late + told["late"]
    hours = spark.read.parquet(f"{at}/out").withColumn("start", F.col("start").cast("timestamp_ntz"))
    return hours.unionByName(spark.createDataFrame([(None, "late", late, None)], hours.schema))


@query(
    "stream_attribution",
    "SELECT p.event_id AS purchase_id, c.event_id AS click_id, p.user_id, round((epoch_us(p.ts) - epoch_us(c.ts)) / 1000000, 3) AS wait_s FROM events p JOIN events c ON p.user_id = c.user_id AND p.event_type = 'purchase' AND c.event_type = 'click' AND c.ts <= p.ts AND c.ts >= p.ts - INTERVAL 6 HOUR",
)
def stream_attribution(spark, sf_dir):
    """Purchases with the clicks of the same user in the six hours before, two streams joined by interval."""
    at = f"{ensure_checkpoint_dir(spark)}/stream-attribution-{uuid.uuid4().hex}"

    def side(kind: str, name: str, when: str):
        rows = files.stream_table(spark, f"{sf_dir}/events.parquet").where(F.col("event_type") == kind)
        return rows.select("user_id", F.col("event_id").alias(name), F.col("ts").alias(when))

    found = store.interval_join(side("purchase", "purchase_id", "bought"), side("click", "click_id", "clicked"), "user_id", "bought", "clicked", "6 hours", "10 minutes")
    wait = F.unix_micros(F.col("bought").cast("timestamp")) - F.unix_micros(F.col("clicked").cast("timestamp"))
    files.drain(found.select("purchase_id", "click_id", "user_id", F.round(wait / 1e6, 3).alias("wait_s")), f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out")
