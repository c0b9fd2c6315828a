"""BM25 over a corpus as joins and aggregates.

Sums go through decimals, so that scores do not depend on the order in which partial sums meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions.text import tokens

SUM = "decimal(24,12)"


def postings(corpus: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(chunk_id, term, tf, dl); counting is partial before the shuffle, so frequent terms are no hot task."""
    words = corpus.select(F.col(id_col).alias("chunk_id"), tokens(F.col(text_col)).alias("ts"))
    sized = words.withColumn("dl", F.size("ts"))
    return sized.select("chunk_id", "dl", F.explode("ts").alias("term")).groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))


def corpus_stats(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: n documents and their mean length avgdl."""
    return corpus.agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.col(text_col)))).alias("avgdl"))


def idf(posted: DataFrame, stats: DataFrame, epsilon: float = rules.BM25_EPSILON) -> DataFrame:
    """(term, idf); a negative one becomes epsilon times the mean of all."""
    return idf_of(posted.groupBy("term").agg(F.count("*").alias("df")), stats, epsilon)


def idf_of(df: DataFrame, stats: DataFrame, epsilon: float = rules.BM25_EPSILON) -> DataFrame:
    """idf() from (term, df), the number of documents of each term."""
    raw = df.crossJoin(F.broadcast(stats)).select("term", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg((F.sum(F.col("raw").cast(SUM)).cast("double") / F.count("*")).alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, F.col("mean") * epsilon).otherwise(F.col("raw")).alias("idf"))


def scores(corpus: DataFrame, questions: DataFrame, id_col: str, query_col: str, text_col: str = "text", k1: float = rules.BM25_K1, b: float = rules.BM25_B) -> DataFrame:
    """(query_id, chunk_id, score) of all pairs that share a term; repeated query terms count each time. Scores are rounded to 4 places.

    Only postings of terms that some question has are joined; Spark picks the join by the sizes it sees.
    """
    posted, stats = postings(corpus, id_col, text_col), corpus_stats(corpus, text_col)
    asked = questions.select(F.col(query_col).alias("query_id"), F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    weights = asked.join(idf(posted, stats), "term")
    matched = posted.join(weights, "term").crossJoin(F.broadcast(stats))
    part = F.col("times") * F.col("idf") * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return matched.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part.cast(SUM)).cast("double"), 4).alias("score"))
