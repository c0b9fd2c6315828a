"""Queries over judged answers. Labels stand in for verdicts by a fixed rule, the same in both engines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import classify, rules
from lodestone.operators import evaluation, models
from lodestone.plans.classify_queries import any_match
from lodestone.plans.registry import query, table

JUDGED = """judged AS (SELECT doc_id, concat('type', (doc_id % 5)::VARCHAR) AS kind, CASE doc_id % 4 WHEN 0 THEN 'refuse' WHEN 1 THEN 'partial_answer' ELSE 'answer' END AS expected,
CASE WHEN doc_id % 13 = 0 THEN -1 ELSE greatest(0, quality * 2 - toxic) END AS factual_accuracy, CASE WHEN doc_id % 13 = 0 THEN -1 ELSE quality + (doc_id % 2)::INT END AS completeness,
CASE WHEN doc_id % 13 = 0 THEN -1 ELSE greatest(0, quality * 2 - (doc_id % 5 = 0)::INT) END AS appropriate_behavior, CASE WHEN doc_id % 13 = 0 THEN -1 ELSE 2 - 2 * toxic END AS hallucination,
CASE WHEN doc_id % 13 = 0 THEN -1 ELSE (doc_id % 11 = 0)::INT END AS is_refusal, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 3 = 0 END AS raw_hit3, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 2 = 0 END AS raw_hit5,
(doc_id % 10)::INT AS chain, (doc_id % 3)::INT + 1 AS turn, doc_id % 2 = 0 AS resolved, (doc_id % 997) / 100.0::DOUBLE AS seconds FROM labels)"""


def judged(spark, sf_dir):
    i, q, x = F.col("doc_id"), F.col("quality"), F.col("toxic")
    fails = i % 13 == 0
    score = lambda c: F.when(fails, -1).otherwise(c)
    return table(spark, sf_dir, "labels").select(
        "doc_id", F.concat(F.lit("type"), (i % 5).cast("string")).alias("kind"), F.when(i % 4 == 0, "refuse").when(i % 4 == 1, "partial_answer").otherwise("answer").alias("expected"),
        score(F.greatest(F.lit(0), q * 2 - x)).alias("factual_accuracy"), score(q + (i % 2).cast("int")).alias("completeness"), score(F.greatest(F.lit(0), q * 2 - (i % 5 == 0).cast("int"))).alias("appropriate_behavior"),
        score(2 - 2 * x).alias("hallucination"), score((i % 11 == 0).cast("int")).alias("is_refusal"), F.when(i % 7 != 0, i % 3 == 0).alias("raw_hit3"), F.when(i % 7 != 0, i % 2 == 0).alias("raw_hit5"),
        (i % 10).cast("int").alias("chain"), ((i % 3).cast("int") + 1).alias("turn"), (i % 2 == 0).alias("resolved"), ((i % 997) / 100.0).alias("seconds"),
    )


A, V, REF, GOLD = "expected IN ('answer', 'partial_answer')", "factual_accuracy >= 0", "is_refusal = 1", "(expected IN ('answer', 'partial_answer') AND raw_hit5 IS NOT NULL)"


def share(hit: str, of: str) -> str:
    return f"count(*) FILTER ({hit}) / greatest(count(*) FILTER ({of}), 1)"


def half(c: str, when: str) -> str:
    return f"coalesce(avg({c}) FILTER ({when}) / 2, 0)"


HEADLINE = f"""count(*) AS total_questions, count(*) FILTER ({A}) AS answerable, count(*) FILTER (expected = 'refuse') AS refuse_expected, round({share(GOLD + " AND raw_hit3", GOLD)}, 4) AS hit_at_3, round({share(GOLD + " AND raw_hit5", GOLD)}, 4) AS hit_at_5,
round({half("factual_accuracy", A + " AND " + V)}, 4) AS accuracy_answerable, round({half("factual_accuracy", V)}, 4) AS accuracy_all, round({half("completeness", V)}, 4) AS completeness, round(1 - {half("hallucination", V)}, 4) AS hallucination_rate,
round(count(*) FILTER ({V} AND appropriate_behavior >= 1) / greatest(count(*), 1), 4) AS coverage, round(count(*) FILTER ({REF}) / greatest(count(*), 1), 4) AS refusal_rate, round({share(REF + " AND expected = 'refuse'", "expected = 'refuse'")}, 4) AS correct_refusal_rate,
round({share(REF + " AND " + A, A)}, 4) AS false_refusal_rate, count(*) FILTER (expected = 'refuse' AND NOT ({REF})) AS missed_refusal_count, round({share(GOLD + " AND raw_hit5 AND factual_accuracy >= 1", GOLD)}, 4) AS evidence_supported_accuracy"""


@query("eval_metrics", f"WITH {JUDGED} SELECT {HEADLINE} FROM judged")
def eval_metrics(spark, sf_dir):
    return judged(spark, sf_dir).agg(*evaluation.headline())


@query("eval_metrics_v2", f"WITH {JUDGED} SELECT {HEADLINE}, round(avg((doc_id % 3 <> 1)::INT) FILTER (doc_id % 2 = 0), 4) AS consistency_rate FROM judged")
def eval_metrics_v2(spark, sf_dir):
    """As above, with the share of consistent answers among those that were checked."""
    consistent = F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") % 3 != 1).cast("int"))
    return judged(spark, sf_dir).agg(*evaluation.headline(), F.round(F.avg(consistent), 4).alias("consistency_rate"))


@query("eval_by_type", f"WITH {JUDGED} SELECT kind, count(*) AS total, count(*) FILTER (appropriate_behavior >= 2) AS correct_behavior, round(count(*) FILTER (appropriate_behavior >= 2) / count(*), 3) AS behavior_rate, round(coalesce(sum(factual_accuracy) FILTER ({V}), 0)::DOUBLE / greatest(count(*) FILTER ({V}), 1) / 2, 3) AS avg_accuracy, count(*) FILTER (factual_accuracy >= 2) AS perfect FROM judged GROUP BY kind")
def eval_by_type(spark, sf_dir):
    return evaluation.by_type(judged(spark, sf_dir), "kind")


@query(
    "retrieval_eval",
    """WITH f AS (SELECT doc_id // 10 AS query_id, doc_id % 10 AS rank, source, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id % 10) AS n FROM documents),
g AS (SELECT doc_id // 10 AS query_id, CASE WHEN doc_id % 2 = 0 THEN 'SRC1' ELSE concat('the src', (doc_id % 20)::VARCHAR, ' file') END AS gold_id FROM documents),
h AS (SELECT query_id, min(n) AS n FROM f JOIN g USING (query_id) WHERE contains(lower(source), lower(gold_id)) OR contains(lower(gold_id), lower(source)) GROUP BY query_id)
SELECT g.query_id, coalesce(n <= 3, false) AS raw_hit3, coalesce(n <= 5, false) AS raw_hit5 FROM (SELECT DISTINCT query_id FROM g) g LEFT JOIN h USING (query_id)""",
)
def retrieval_eval(spark, sf_dir):
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    found = docs.select(F.floor(i / 10).alias("query_id"), (i % 10).alias("rank"), "source")
    gold = docs.select(F.floor(i / 10).alias("query_id"), F.when(i % 2 == 0, "SRC1").otherwise(F.concat(F.lit("the src"), (i % 20).cast("string"), F.lit(" file"))).alias("gold_id"))
    return evaluation.retrieval_hits(found, gold)


class StubJudge:
    """Scores by the length of what it was asked; some replies are fenced, some broken, and some prompts fail."""

    def complete(self, prompts):
        return [self.reply(len(p)) for p in prompts]

    def reply(self, n):
        import json

        if n % 11 == 0:
            raise ValueError("no reply")
        body = json.dumps({name: (n + k) % 3 if k < 4 else n % 2 for k, name in enumerate(models.SCORES)})
        return ("no JSON here", f"```json\n{body}\n```", body, f"Here: {body}")[n % 4]


ASKED_TO_JUDGE = f"concat('{models.JUDGING}', chr(10), chr(10), 'Right answer:', chr(10), a.text, chr(10), chr(10), 'Answer:', chr(10), coalesce(b.text, ''), chr(10), chr(10), 'Expected: ', CASE WHEN a.doc_id % 3 = 0 THEN 'refuse' ELSE 'answer' END)"


@query(
    "judge_answers",
    f"""WITH p AS (SELECT a.doc_id, length({ASKED_TO_JUDGE}) AS n FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, {", ".join(f"CASE WHEN n % 11 = 0 OR n % 4 = 0 THEN -1 ELSE {f'(n + {k}) % 3' if k < 4 else 'n % 2'} END AS {name}" for k, name in enumerate(models.SCORES))} FROM p""",
)
def judge_answers(spark, sf_dir):
    """Every document as the right answer to which the next one is held, judged."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("gold"))
    said = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("gold").alias("answer"))
    asked = docs.join(said, "doc_id", "left").withColumn("expected", F.when(F.col("doc_id") % 3 == 0, "refuse").otherwise("answer"))
    return models.judge(asked, StubJudge).drop("gold", "answer", "expected")


@query(
    "judge_override",
    f"""WITH {JUDGED}, r AS (SELECT j.*, {any_match("t.t", rules.REFUSAL)} AS refused FROM judged j JOIN (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('I was unable to find it. ', text) ELSE text END AS t FROM documents) t USING (doc_id))
SELECT doc_id, CASE WHEN refused THEN 1 WHEN is_refusal = 1 AND {A} THEN 0 ELSE is_refusal END AS is_refusal, CASE WHEN refused AND is_refusal <> 1 AND expected = 'refuse' THEN greatest(appropriate_behavior, 2) WHEN NOT refused AND is_refusal = 1 AND {A} THEN greatest(appropriate_behavior, 1) ELSE appropriate_behavior END AS appropriate_behavior FROM r""",
)
def judge_override(spark, sf_dir):
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("I was unable to find it. "), "text")).otherwise(F.col("text"))
    answers = table(spark, sf_dir, "documents").select("doc_id", classify.is_refusal(said).alias("refused"))
    return evaluation.override(judged(spark, sf_dir).join(answers, "doc_id"), F.col("refused")).select("doc_id", "is_refusal", "appropriate_behavior")


def mean(c: str, name: str) -> str:
    return f"round(avg({c}), 3) AS {name}"


@query("mt_overall", f"WITH {JUDGED} SELECT count(*) AS total, count(*) FILTER ({V}) AS valid, round(avg(factual_accuracy) FILTER ({V}), 3) AS accuracy, round(avg(hallucination) FILTER ({V}), 3) AS hallucination, count(*) FILTER (factual_accuracy = 0) AS a0, count(*) FILTER (factual_accuracy = 1) AS a1, count(*) FILTER (factual_accuracy = 2) AS a2 FROM judged")
def mt_overall(spark, sf_dir):
    valid = evaluation.valid()
    f = F.col("factual_accuracy")
    return judged(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(valid).alias("valid"), F.round(F.avg(F.when(valid, f)), 3).alias("accuracy"), F.round(F.avg(F.when(valid, F.col("hallucination"))), 3).alias("hallucination"), *[F.count_if(f == i).alias(f"a{i}") for i in range(3)])


@query("mt_by_turn", f"WITH {JUDGED} SELECT turn, count(*) AS n, {mean('factual_accuracy', 'accuracy')}, {mean('completeness', 'completeness')}, {mean('hallucination', 'hallucination')} FROM judged WHERE {V} GROUP BY turn")
def mt_by_turn(spark, sf_dir):
    rows = judged(spark, sf_dir).where(evaluation.valid())
    return rows.groupBy("turn").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 3).alias(n) for c, n in (("factual_accuracy", "accuracy"), ("completeness", "completeness"), ("hallucination", "hallucination"))])


@query("mt_by_chain", f"WITH {JUDGED} SELECT chain, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS questions, {mean('factual_accuracy', 'accuracy')} FROM judged WHERE {V} GROUP BY chain")
def mt_by_chain(spark, sf_dir):
    rows = judged(spark, sf_dir).where(evaluation.valid())
    return rows.groupBy("chain").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("questions"), F.round(F.avg("factual_accuracy"), 3).alias("accuracy"))


@query("mt_coref", f"WITH {JUDGED} SELECT count(*) AS follow_ups, count(*) FILTER (resolved) AS triggered, round(count(*) FILTER (resolved) / count(*), 3) AS rate, round(avg(factual_accuracy) FILTER (resolved AND {V}), 3) AS resolved_accuracy FROM judged WHERE turn > 1")
def mt_coref(spark, sf_dir):
    rows = judged(spark, sf_dir).where("turn > 1")
    return rows.agg(F.count("*").alias("follow_ups"), F.count_if("resolved").alias("triggered"), F.round(F.count_if("resolved") / F.count("*"), 3).alias("rate"), F.round(F.avg(F.when(F.col("resolved") & evaluation.valid(), F.col("factual_accuracy"))), 3).alias("resolved_accuracy"))


@query("mt_latency", f"WITH {JUDGED} SELECT round(avg(seconds), 2) AS avg_s, round(max(seconds), 2) AS max_s, round(min(seconds), 2) AS min_s FROM judged")
def mt_latency(spark, sf_dir):
    return judged(spark, sf_dir).agg(F.round(F.avg("seconds"), 2).alias("avg_s"), F.round(F.max("seconds"), 2).alias("max_s"), F.round(F.min("seconds"), 2).alias("min_s"))


DELTAS = ["hit_at_5", "accuracy_all", "coverage", "hallucination_rate"]


@query("metric_delta", f"WITH {JUDGED}, a AS (SELECT {HEADLINE} FROM judged WHERE chain % 2 = 0), b AS (SELECT {HEADLINE} FROM judged WHERE chain % 2 = 1) " + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(b.{m} - a.{m}, 4) AS delta FROM a, b" for m in DELTAS))
def metric_delta(spark, sf_dir):
    """Differences of two runs' metrics; each run is one row."""
    rows = judged(spark, sf_dir)
    pick = F.expr("stack(%d, %s) AS (metric, value)" % (len(DELTAS), ", ".join(f"'{m}', {m}" for m in DELTAS)))
    runs = [rows.where(F.col("chain") % 2 == i).agg(*evaluation.headline()).select(pick) for i in (0, 1)]
    return runs[1].withColumnRenamed("value", "b").join(runs[0], "metric").select("metric", F.round(F.col("b") - F.col("value"), 4).alias("delta"))


@query("chunk_stats", "WITH c AS (SELECT source, length(text) AS n FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n) AS i, count(*) OVER (PARTITION BY source) AS m FROM c) SELECT source, count(*) AS chunks, round(avg(n), 1) AS mean, floor(avg(n))::BIGINT AS mean_int, min(n) AS least, max(n) AS most, max(n) FILTER (i = m // 2 + 1) AS median FROM r GROUP BY source")
def chunk_stats(spark, sf_dir):
    return evaluation.chunk_stats(table(spark, sf_dir, "documents"), "source", F.length("text"))


@query("file_stats", "SELECT source, count(*) AS chunks, floor(avg(length(text)))::BIGINT AS mean_chars FROM documents GROUP BY source")
def file_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("chunks"), F.avg(F.length("text")).cast("long").alias("mean_chars"))


@query("chunk_audit", "SELECT source, round(100.0::DOUBLE * count(*) FILTER (length(text) BETWEEN 400 AND 800) / count(*), 2) AS pct_400_800, count(*) FILTER (length(text) > 900) AS over_900, count(*) FILTER (length(text) < 200) AS under_200, count(*) FILTER (length(text) < 200) * 20 <= count(*) AS few_short FROM documents GROUP BY source")
def chunk_audit(spark, sf_dir):
    n = F.length("text")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.round(100.0 * F.count_if(n.between(400, 800)) / F.count("*"), 2).alias("pct_400_800"), F.count_if(n > 900).alias("over_900"), F.count_if(n < 200).alias("under_200"), (F.count_if(n < 200) * 20 <= F.count("*")).alias("few_short"))


@query("dataset_dist", f"WITH {JUDGED} SELECT 'kind' AS field, kind AS value, count(*) AS n FROM judged GROUP BY kind UNION ALL SELECT 'expected', expected, count(*) FROM judged GROUP BY expected UNION ALL SELECT 'chain', chain::VARCHAR, count(*) FROM judged GROUP BY chain")
def dataset_dist(spark, sf_dir):
    fields = F.expr("stack(3, 'kind', kind, 'expected', expected, 'chain', cast(chain AS string)) AS (field, value)")
    return judged(spark, sf_dir).select(fields).groupBy("field", "value").agg(F.count("*").alias("n"))


@query("failure_modes", f"WITH {JUDGED}, b AS (SELECT * FROM judged WHERE appropriate_behavior < 2), c AS (SELECT count(*) AS total, count(*) FILTER ({REF} AND {A}) AS false_refusal, count(*) FILTER (expected = 'refuse' AND NOT ({REF})) AS missed_refusal, count(*) FILTER (completeness < 1) AS incomplete FROM b) SELECT *, total - false_refusal - missed_refusal - incomplete AS other FROM c")
def failure_modes(spark, sf_dir):
    bad, refused = judged(spark, sf_dir).where("appropriate_behavior < 2"), F.col("is_refusal") == 1
    counts = bad.agg(F.count("*").alias("total"), F.count_if(refused & evaluation.answerable()).alias("false_refusal"), F.count_if((F.col("expected") == "refuse") & ~refused).alias("missed_refusal"), F.count_if(F.col("completeness") < 1).alias("incomplete"))
    return counts.withColumn("other", F.col("total") - F.col("false_refusal") - F.col("missed_refusal") - F.col("incomplete"))


@query("error_subset", f"WITH {JUDGED} SELECT doc_id, kind, appropriate_behavior FROM judged WHERE appropriate_behavior < 2")
def error_subset(spark, sf_dir):
    return judged(spark, sf_dir).where("appropriate_behavior < 2").select("doc_id", "kind", "appropriate_behavior")


@query("error_topk", f"WITH {JUDGED} SELECT doc_id, factual_accuracy, appropriate_behavior, hallucination FROM judged ORDER BY factual_accuracy, appropriate_behavior, hallucination DESC, doc_id LIMIT 4")
def error_topk(spark, sf_dir):
    """The four worst cases: a top-k report."""
    rows = judged(spark, sf_dir).select("doc_id", "factual_accuracy", "appropriate_behavior", "hallucination")
    return rows.orderBy("factual_accuracy", "appropriate_behavior", F.col("hallucination").desc(), "doc_id").limit(4)


@query("case_pick", f"WITH {JUDGED}, f AS (SELECT doc_id, kind, row_number() OVER (PARTITION BY kind ORDER BY doc_id) AS n FROM judged WHERE factual_accuracy = 2), r AS (SELECT doc_id, kind, row_number() OVER (ORDER BY CASE kind WHEN 'type3' THEN 0 WHEN 'type1' THEN 1 ELSE 2 END, kind) AS place FROM f WHERE n = 1) SELECT * FROM r WHERE place <= 3")
def case_pick(spark, sf_dir):
    """The first good case of each type, types in order of preference, up to three: a top-k report."""
    first = judged(spark, sf_dir).where("factual_accuracy = 2").groupBy("kind").agg(F.min("doc_id").alias("doc_id"))
    order = F.when(F.col("kind") == "type3", 0).when(F.col("kind") == "type1", 1).otherwise(2)
    best = first.orderBy(order, "kind").limit(3)
    return best.withColumn("place", F.row_number().over(Window.orderBy(order, "kind")))


@query("case_blurb", f"WITH {JUDGED} SELECT doc_id, CASE WHEN factual_accuracy < 0 THEN 'not judged' WHEN {REF} AND expected = 'refuse' THEN 'rightly refused' WHEN {REF} THEN 'wrongly refused' WHEN factual_accuracy = 2 AND hallucination = 2 THEN 'accurate' WHEN factual_accuracy = 2 THEN 'accurate with additions' WHEN factual_accuracy = 1 THEN 'partly accurate' ELSE 'inaccurate' END AS blurb FROM judged")
def case_blurb(spark, sf_dir):
    f, refused = F.col("factual_accuracy"), F.col("is_refusal") == 1
    said = F.when(f < 0, "not judged").when(refused & (F.col("expected") == "refuse"), "rightly refused").when(refused, "wrongly refused").when((f == 2) & (F.col("hallucination") == 2), "accurate").when(f == 2, "accurate with additions").when(f == 1, "partly accurate").otherwise("inaccurate")
    return judged(spark, sf_dir).select("doc_id", said.alias("blurb"))


@query("section_examples", "WITH f AS (SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY lang, source), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM f) SELECT lang, source, doc_id FROM r WHERE n <= 10")
def section_examples(spark, sf_dir):
    """The first chunk of each section title, ten titles a file: a top-k report."""
    first = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.min("doc_id").alias("doc_id"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where("n <= 10").drop("n")


@query("ingest_stats", "SELECT source, count(*) AS inputs, count(*) FILTER (length(text) < 60) AS errors, count(*) FILTER (length(text) >= 60) AS chunks FROM documents GROUP BY source")
def ingest_stats(spark, sf_dir):
    bad = F.length("text") < 60
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("inputs"), F.count_if(bad).alias("errors"), F.count_if(~bad).alias("chunks"))
