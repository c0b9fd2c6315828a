"""Queries over conversations, activity and replies of models."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import models, sessions
from lodestone.plans.registry import query, table
from lodestone.streaming import sessions as stream

TURNS = """turns AS (SELECT q.conv_id, q.turn, q.text AS question, coalesce(a.text, '') AS answer FROM conversations q LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user')"""


def turns(spark, sf_dir):
    """Each user's question with the answer that follows it."""
    rows = table(spark, sf_dir, "conversations")
    said = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")).join(said, ["conv_id", "turn"], "left").na.fill("", ["answer"])


@query("session_window", f"WITH {TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM turns) SELECT conv_id, turn, question FROM r WHERE n <= 2")
def session_window(spark, sf_dir):
    return sessions.last_turns(turns(spark, sf_dir), "conv_id", "turn", 2).select("conv_id", "turn", "question")


@query(
    "session_summary",
    f"""WITH {TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM turns), l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::VARCHAR AS i FROM r WHERE n <= 3)
SELECT conv_id, concat('Previous conversation:', chr(10), string_agg(concat('  Q', i, ': ', question, chr(10), '  A', i, ': ', substr(answer, 1, 200), CASE WHEN length(answer) > 200 THEN '...' ELSE '' END, chr(10), '  Sources: s', turn::VARCHAR, ', t'), chr(10) ORDER BY turn)) AS summary FROM l GROUP BY conv_id""",
)
def session_summary(spark, sf_dir):
    rows = turns(spark, sf_dir).withColumn("sources", F.array(F.concat(F.lit("s"), F.col("turn").cast("string")), F.lit("t")))
    return sessions.summary(rows, "conv_id", "turn", "question", "answer", "sources")


@query("session_last_turn", f"WITH {TURNS} SELECT conv_id, max(turn) AS turn, arg_max(question, turn) AS question, count(*) AS n FROM turns GROUP BY conv_id")
def session_last_turn(spark, sf_dir):
    return turns(spark, sf_dir).groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("question", "turn").alias("question"), F.count("*").alias("n"))


@query("session_ttl", "WITH l AS (SELECT event_id, epoch_us(ts) / 1000000 - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000000 AS idle_s FROM events) SELECT event_id, round(idle_s, 3) AS idle_s, coalesce(idle_s > 3600, true) AS fresh FROM l")
def session_ttl(spark, sf_dir):
    return sessions.expired_before(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("event_id", F.round("idle_s", 3).alias("idle_s"), "fresh")


@query("session_lru", "SELECT user_id, max(ts) AS last FROM events GROUP BY user_id ORDER BY last DESC, user_id LIMIT 50")
def session_lru(spark, sf_dir):
    """The fifty sessions accessed last: a cap that is the feature."""
    return sessions.most_recent(table(spark, sf_dir, "events"), "user_id", "ts", 50)


@query("events_session_window", "WITH l AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 3600000000, true) AS fresh FROM events), n AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM l) SELECT user_id, session, min(ts) AS start, max(ts) AS \"end\", count(*) AS n FROM n GROUP BY user_id, session")
def events_session_window(spark, sf_dir):
    return sessions.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")


@query("events_hourly", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_hourly(spark, sf_dir):
    return stream.activity(table(spark, sf_dir, "events"))


@query("chain_turns", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE role <> 'system'")
def chain_turns(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role <> 'system'")
    return rows.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("place"))


@query(
    "coref_prompt",
    f"""WITH {TURNS}, b AS (SELECT t.conv_id, t.turn, t.question, (SELECT string_agg(concat('Q: ', p.question, chr(10), 'A: ', substr(p.answer, 1, 300)), chr(10) ORDER BY p.turn) FROM (SELECT * FROM turns p WHERE p.conv_id = t.conv_id AND p.turn < t.turn ORDER BY p.turn DESC LIMIT 3) p) AS said FROM turns t)
SELECT conv_id, turn, CASE WHEN said IS NULL THEN question ELSE concat('Conversation so far:', chr(10), said, chr(10), 'Rewrite so that it stands alone: ', question) END AS prompt FROM b""",
)
def coref_prompt(spark, sf_dir):
    rows = turns(spark, sf_dir)
    before = sessions.turns_before(rows, "conv_id", "turn", F.struct("question", "answer"))
    return rows.withColumn("before", before).select("conv_id", "turn", sessions.coref_prompt(F.col("question"), F.col("before")).alias("prompt"))


REPLY = "CASE conv_id % 4 WHEN 0 THEN 'I would reuse it' WHEN 1 THEN 'MERGE, please' WHEN 2 THEN 'Full or merge' ELSE text END"


@query("strategy_parse", f"SELECT conv_id, turn, CASE WHEN contains(upper(t), 'FULL') THEN 'FULL' WHEN contains(upper(t), 'REUSE') THEN 'REUSE' WHEN contains(upper(t), 'MERGE') THEN 'MERGE' ELSE 'FULL' END AS strategy FROM (SELECT conv_id, turn, {REPLY} AS t FROM conversations) q")
def strategy_parse(spark, sf_dir):
    i = F.col("conv_id") % 4
    reply = F.when(i == 0, "I would reuse it").when(i == 1, "MERGE, please").when(i == 2, "Full or merge").otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", sessions.strategy(reply).alias("strategy"))


PATTERNS = [("thand", "Thand"), ("ción", "Cion"), ("the ", "The"), ("heit", "Heit"), ("thands", "Thand")]


@query(
    "session_entities",
    f"""WITH {TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM turns), l AS (SELECT conv_id, turn, lower(concat(question, ' ', substr(answer, 1, 500))) AS t FROM r WHERE n <= 3),
p AS (SELECT unnest({[p for p, _ in PATTERNS]!r}) AS pattern, unnest({[e for _, e in PATTERNS]!r}) AS entity), f AS (SELECT conv_id, entity, min(turn) AS turn FROM l JOIN p ON contains(t, pattern) GROUP BY conv_id, entity) SELECT * FROM f""",
)
def session_entities(spark, sf_dir):
    named = spark.createDataFrame([(i, p, e) for i, (p, e) in enumerate(PATTERNS)], "place int, pattern string, entity string")
    text = F.concat("question", F.lit(" "), F.substring("answer", 1, 500))
    found = sessions.entities(turns(spark, sf_dir), "conv_id", "turn", text, named)
    return found.select("conv_id", "entity", F.col("first.turn").alias("turn"))


SUBS = "CASE item_id % 3 WHEN 0 THEN '[\"one\", \"two\"]' WHEN 1 THEN 'Here: [\"only\"]' ELSE text END"


@query("decompose_parse", f"SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 2 ELSE 1 END AS n, CASE WHEN item_id % 3 = 0 THEN 'one' ELSE text END AS first FROM benchmark")
def decompose_parse(spark, sf_dir):
    i = F.col("item_id") % 3
    reply = F.when(i == 0, '["one", "two"]').when(i == 1, 'Here: ["only"]').otherwise(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", models.subquestions(reply, F.col("text")).alias("s")).select("item_id", F.size("s").alias("n"), F.get("s", F.lit(0)).alias("first"))


@query("expand_gate", "SELECT item_id, len(string_split_regex(trim(text), '\\s+')) <= 12 AS expand FROM benchmark")
def expand_gate(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", models.short_enough(F.col("text")).alias("expand"))


@query("consistency_parse", "SELECT item_id, CASE item_id % 3 WHEN 0 THEN false ELSE true END AS is_consistent, CASE item_id % 3 WHEN 0 THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS confidence FROM benchmark")
def consistency_parse(spark, sf_dir):
    i = F.col("item_id") % 3
    reply = F.when(i == 0, 'It says {"is_consistent": false, "confidence": 0.5}').when(i == 1, "{broken").otherwise(F.col("text"))
    found = models.consistency(reply)
    return table(spark, sf_dir, "benchmark").select("item_id", found["is_consistent"].alias("is_consistent"), found["confidence"].alias("confidence"))


class StubModel:
    """Replies to the prompts of a conversation by rule, without a model."""

    def complete(self, prompts: list[str]) -> list[str]:
        return [self.reply(p) for p in prompts]

    def reply(self, prompt: str) -> str:
        last = prompt.rsplit(": ", 1)[-1]
        if prompt.startswith("Conversation so far"):
            return prompt.rsplit("Rewrite so that it stands alone: ", 1)[-1]
        if prompt.startswith("Last question"):
            return ("FULL", "MERGE", "REUSE")[len(prompt) % 3]
        if prompt.startswith("Write three"):
            return " ".join(reversed(last.split(" ")))
        if prompt.startswith("Split into"):
            words = last.split(" ")
            return json.dumps([" ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])])
        if prompt.startswith("Is the answer"):
            return json.dumps({"is_consistent": len(prompt) % 2 == 0, "confidence": 0.5})
        return "There is no evidence." if "(No evidence)" in prompt else prompt.split("]\n", 1)[-1][:300]


def conversations(spark, sf_dir):
    """(answers, evidence) of every user's turn, over the documents as corpus."""
    from lodestone.operators import conversation
    from lodestone.plans.classify_queries import INTENTS
    from lodestone.plans.retrieval_queries import CorpusRetriever

    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("session"), "turn", F.col("text").alias("question"))
    named = spark.createDataFrame([(i, p, e) for i, (p, e) in enumerate(PATTERNS)], "place int, pattern string, entity string")
    return conversation.ask(asked, CorpusRetriever(spark, sf_dir), StubModel, INTENTS, named)


@query("retrieve_v2")
def retrieve_v2(spark, sf_dir):
    """Evidence of every user's turn in its conversation: strategy, passages, sub-questions, evidence of the turn before, supplements, spread over sources."""
    return conversations(spark, sf_dir)[1].select("query_id", "place", "rank", "chunk_id", "source", "score", "layer")


@query("ask_turns")
def ask_turns(spark, sf_dir):
    """Every user's turn asked in its conversation: resolved, answered from evidence, and checked unless refused."""
    return conversations(spark, sf_dir)[0]
