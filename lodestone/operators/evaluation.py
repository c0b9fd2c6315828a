"""Scores of answers and retrieval rolled up into metrics.

A judged row has expected ('answer', 'partial_answer', 'refuse'), factual_accuracy, completeness, appropriate_behavior, hallucination
(0 to 2, -1 where judging failed), is_refusal (0, 1, -1), and raw_hit3 and raw_hit5 (null without gold sources).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def answerable() -> Column:
    return F.col("expected").isin("answer", "partial_answer")


def valid() -> Column:
    return F.col("factual_accuracy") >= 0


def half_mean(c: str, when: Column) -> Column:
    """Mean of c over the rows where when holds, by two; 0 if there are none."""
    return F.coalesce(F.avg(F.when(when, F.col(c))) / 2, F.lit(0.0))


def share(hits: Column, of: Column) -> Column:
    return F.count_if(hits) / F.greatest(F.count_if(of), F.lit(1))


def headline() -> list[Column]:
    """The metrics of one group of judged rows; coverage and refusals are shares of all rows, not of valid ones."""
    n, refused, gold = F.greatest(F.count("*"), F.lit(1)), F.col("is_refusal") == 1, answerable() & F.col("raw_hit5").isNotNull()
    r = lambda c, name, d=4: F.round(c, d).alias(name)
    return [
        F.count("*").alias("total_questions"), F.count_if(answerable()).alias("answerable"), F.count_if(F.col("expected") == "refuse").alias("refuse_expected"),
        r(share(gold & F.col("raw_hit3"), gold), "hit_at_3"), r(share(gold & F.col("raw_hit5"), gold), "hit_at_5"),
        r(half_mean("factual_accuracy", answerable() & valid()), "accuracy_answerable"), r(half_mean("factual_accuracy", valid()), "accuracy_all"), r(half_mean("completeness", valid()), "completeness"),
        r(1 - half_mean("hallucination", valid()), "hallucination_rate"), r(F.count_if(valid() & (F.col("appropriate_behavior") >= 1)) / n, "coverage"), r(F.count_if(refused) / n, "refusal_rate"),
        r(share(refused & (F.col("expected") == "refuse"), F.col("expected") == "refuse"), "correct_refusal_rate"), r(share(refused & answerable(), answerable()), "false_refusal_rate"),
        F.count_if((F.col("expected") == "refuse") & ~refused).alias("missed_refusal_count"), r(share(gold & F.col("raw_hit5") & (F.col("factual_accuracy") >= 1), gold), "evidence_supported_accuracy"),
    ]


def by_type(rows: DataFrame, key: str) -> DataFrame:
    correct, rated = F.count_if(F.col("appropriate_behavior") >= 2), F.count_if(valid())
    return rows.groupBy(key).agg(
        F.count("*").alias("total"), correct.alias("correct_behavior"), F.round(correct / F.count("*"), 3).alias("behavior_rate"),
        F.round(F.coalesce(F.sum(F.when(valid(), F.col("factual_accuracy"))), F.lit(0)) / F.greatest(rated, F.lit(1)) / 2, 3).alias("avg_accuracy"), F.count_if(F.col("factual_accuracy") >= 2).alias("perfect"),
    )


def retrieval_hits(found: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, raw_hit3, raw_hit5): whether a gold id and a raw source among the first contain one another, whatever the case.

    found: (query_id, rank, source) of raw evidence; gold: (query_id, gold_id). Questions without gold are not returned. An empty source matches everything.
    """
    s, g = F.lower("source"), F.lower("gold_id")
    ranked = found.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    hits = ranked.join(gold, "query_id").where(s.contains(g) | g.contains(s)).groupBy("query_id").agg(F.min("n").alias("n"))
    return gold.select("query_id").distinct().join(hits, "query_id", "left").select("query_id", F.coalesce(F.col("n") <= 3, F.lit(False)).alias("raw_hit3"), F.coalesce(F.col("n") <= 5, F.lit(False)).alias("raw_hit5"))


def override(rows: DataFrame, refused: Column) -> DataFrame:
    """A judge's verdict corrected by the refusal patterns: a missed refusal is set, a wrong one lifted where an answer was due."""
    said = F.col("is_refusal") == 1
    lifted = ~refused & said & answerable()
    behavior = F.when(refused & ~said & (F.col("expected") == "refuse"), F.greatest("appropriate_behavior", F.lit(2))).when(lifted, F.greatest("appropriate_behavior", F.lit(1))).otherwise(F.col("appropriate_behavior"))
    return rows.withColumns({"is_refusal": F.when(refused, 1).when(lifted, 0).otherwise(F.col("is_refusal")), "appropriate_behavior": behavior})


def chunk_stats(rows: DataFrame, key: str, length: Column) -> DataFrame:
    """Counts and lengths of chunks: mean to one place and cut to a whole number, least, greatest and upper median."""
    n = length.cast("long")
    sized = rows.select(key, n.alias("_n"))
    order = Window.partitionBy(key).orderBy("_n")
    placed = sized.withColumn("_i", F.row_number().over(order)).withColumn("_of", F.count("*").over(Window.partitionBy(key)))
    return placed.groupBy(key).agg(
        F.count("*").alias("chunks"), F.round(F.avg("_n"), 1).alias("mean"), F.floor(F.avg("_n")).alias("mean_int"), F.min("_n").alias("least"), F.max("_n").alias("most"),
        F.max(F.when(F.col("_i") == F.floor(F.col("_of") / 2) + 1, F.col("_n"))).alias("median"),
    )
