"""Hybrid retrieval: candidate lists, boosts, reranking, memory of answers, and the merge into few pieces of evidence.

Every operator is keyed by query_id; candidates are at most a few dozen a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import classify, rules
from lodestone.operators.patterns import occurrences


def per_query(*order: Column) -> Window:
    return Window.partitionBy("query_id").orderBy(*order)


def top(df: DataFrame, k: int, score: str = "score", tie: str = "chunk_id") -> DataFrame:
    """The k best rows of each query, ties by id; Spark cuts to k in each task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(per_query(F.col(score).desc(), F.col(tie)))).where(F.col("rank") <= k)


def candidates(scored: DataFrame, corpus: DataFrame, k: int, positive: bool = False) -> DataFrame:
    """The k best of each query, then without useless chunks: those that go are not made up for.

    Chunks are judged before the join and their texts stay behind: a text would move once for each query that it is a candidate of.
    """
    return candidates_of(scored, corpus.where(~classify.is_useless(F.col("text"))).drop("text"), k, positive)


def useful(corpus: DataFrame) -> DataFrame:
    """The chunks that are not useless, with what searches need of them: all columns but the text, and its passage."""
    kept = corpus.where(~classify.is_useless(F.col("text")))
    return kept.withColumn("passage", passage_of(F.col("text"))).drop("text")


def candidates_of(scored: DataFrame, chunks: DataFrame, k: int, positive: bool = False) -> DataFrame:
    """candidates() from the useful chunks."""
    best = top(scored, k)
    best = best.where("score > 0") if positive else best
    return best.join(chunks, "chunk_id").drop("rank")


def merge_lists(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Both lists by (query_id, chunk_id); a side that lacks the chunk scores 0."""
    keys = ["query_id", "chunk_id"]
    d = dense.select(*keys, F.col("score").alias("dense_score"))
    s = sparse.select(*keys, F.col("score").alias("sparse_score"))
    both = d.join(s, keys, "full_outer")
    found = F.when(F.col("dense_score").isNull(), "sparse").when(F.col("sparse_score").isNull(), "dense").otherwise("both")
    return both.select(*keys, F.coalesce("dense_score", F.lit(0.0)).alias("dense_score"), F.coalesce("sparse_score", F.lit(0.0)).alias("sparse_score"), found.alias("ret_src"))


def drop_when_both(df: DataFrame, pairs: dict[str, str], source: str = "source") -> DataFrame:
    """Without the rows whose source contains a key of pairs, where the query also has a source that contains its value."""
    out, w = df, Window.partitionBy("query_id")
    for i, (gone, stays) in enumerate(pairs.items()):
        has = F.max(F.col(source).contains(stays)).over(w)
        out = out.withColumn(f"_gone{i}", F.col(source).contains(gone) & has)
    for i in range(len(pairs)):
        out = out.where(~F.col(f"_gone{i}")).drop(f"_gone{i}")
    return out


def boost(intent: Column, source_type: Column, table: dict[str, dict[str, float]] = rules.SOURCE_BOOST) -> Column:
    """The boost of a kind of source for an intent; an unknown intent counts as the default, an unknown kind has none."""
    known = F.when(intent.isin(list(table)), intent).otherwise(rules.DEFAULT_INTENT)
    out = F.lit(0.0)
    for name, kinds in table.items():
        for kind, value in kinds.items():
            out = F.when((known == name) & (source_type == kind), value).otherwise(out)
    return out


def hybrid(df: DataFrame) -> DataFrame:
    """hybrid: both scores by the query's greatest, weighted, plus the boost; a greatest of 0 counts as 1."""
    w = Window.partitionBy("query_id")

    def share(c: str) -> Column:
        most = F.max(c).over(w)
        return F.col(c) / F.when(most == 0, 1.0).otherwise(most)

    return df.withColumn("hybrid", F.round(rules.DENSE_WEIGHT * share("dense_score") + rules.SPARSE_WEIGHT * share("sparse_score") + F.col("boost"), 6))


def passage_of(text: Column, most: int = 512) -> Column:
    """Of a text the first characters, all that lexical_rerank() reads."""
    return F.substring(text, 1, most)


def passages(corpus: DataFrame) -> DataFrame:
    """(chunk_id, passage)"""
    return corpus.select("chunk_id", passage_of(F.col("text")).alias("passage"))


def lexical_rerank(question: Column, passage: Column, most: int = 512) -> Column:
    """A stand-in for a reranking model, 0 to 10: the share of the question's distinct tokens that the passage's first characters hold."""
    from lodestone.functions.text import let, tokens

    asked, held = F.array_distinct(tokens(question)), F.array_distinct(tokens(F.substring(passage, 1, most)))
    return let(asked, lambda a: F.when(F.size(a) == 0, 0.0).otherwise(10.0 * F.size(F.array_intersect(a, held)) / F.size(a)))


def final_score(hybrid_score: Column, rerank: Column) -> Column:
    return F.round(rules.HYBRID_WEIGHT * hybrid_score + rules.RERANK_WEIGHT * rerank / 10.0, 6)


def evidence(raw: DataFrame, positive: DataFrame, negative: DataFrame, queries: DataFrame, k: int = rules.TOP_K_FINAL, at_least_raw: int = rules.MIN_RAW_IN_FINAL) -> DataFrame:
    """At most k rows a query: the best raw chunks, at most one or two answers from memory by intent, at most one denial, raw ones up to k.

    raw, positive: (query_id, chunk_id, final); negative: (query_id, chunk_id, raw_score); queries: (query_id, intent). The loop over
    lists has a closed form over counts: r0 raw ones come first, q answers fill up, a denial if the gate is open, then raw ones.
    Answers come before raw chunks in the result; rank counts from 1.
    """
    r = raw.withColumn("n", F.row_number().over(per_query(F.col("final").desc(), F.col("chunk_id"))))
    p = positive.withColumn("n", F.row_number().over(per_query(F.col("final").desc(), F.col("chunk_id"))))
    d = negative.withColumn("n", F.row_number().over(per_query(F.col("raw_score").desc(), F.col("chunk_id")))).where("n = 1")
    counts = queries.select("query_id", "intent").join(r.groupBy("query_id").agg(F.count("*").alias("raws"), F.max("final").alias("best")), "query_id", "left")
    counts = counts.join(p.groupBy("query_id").agg(F.count("*").alias("answers")), "query_id", "left").join(d.select("query_id", F.lit(1).alias("denials")), "query_id", "left").na.fill(0, ["raws", "answers", "denials"])
    most = F.when(F.col("intent").isin(rules.ONE_QA_INTENTS), 1).otherwise(2)
    first = F.least(F.col("raws"), F.lit(at_least_raw))
    gate = (F.col("intent") == "no_evidence") & (F.col("denials") > 0) & (F.coalesce("best", F.lit(0.0)) < rules.NEGATIVE_GATE)
    counts = counts.withColumn("q", F.least(most, F.col("answers"), F.lit(k) - first).cast("int")).withColumn("neg", (gate & (first + F.col("q") < k)).cast("int"))
    counts = counts.withColumn("keep", F.least(F.col("raws"), F.lit(k) - F.col("q") - F.col("neg")).cast("int")).select("query_id", "intent", "q", "neg", "keep")
    rows = (
        p.join(counts, "query_id").where("n <= q").select("query_id", "chunk_id", F.col("final").alias("score"), F.lit("qa_memory").alias("layer"), F.lit(0).alias("part"), "n")
        .unionByName(d.join(counts, "query_id").where("neg = 1").select("query_id", "chunk_id", F.col("raw_score").alias("score"), F.lit("qa_memory").alias("layer"), F.lit(1).alias("part"), "n"))
        .unionByName(r.join(counts, "query_id").where("n <= keep").select("query_id", "chunk_id", F.col("final").alias("score"), F.lit("corpus").alias("layer"), F.lit(2).alias("part"), "n"))
    )
    rank = F.row_number().over(per_query(F.col("part"), F.col("n"), F.col("chunk_id")))
    return rows.withColumn("rank", rank).select("query_id", "rank", "chunk_id", F.round("score", 4).alias("score"), "layer")


def union_subqueries(parts: DataFrame, k: int = rules.TOP_K_FINAL) -> DataFrame:
    """Evidence of several sub-queries (query_id, sub, rank, chunk_id, score): each chunk as first seen, the k best, ranked anew."""
    seen = parts.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("sub", "rank"))).where("n = 1").drop("n", "rank")
    return seen.withColumn("rank", F.row_number().over(per_query(F.col("score").desc(), F.col("sub"), F.col("chunk_id")))).where(F.col("rank") <= k)


def append_previous(now: DataFrame, before: DataFrame, most: int = 7) -> DataFrame:
    """Evidence of now, then the unseen evidence of the turn before while there are fewer than most rows."""
    size = now.groupBy("query_id").agg(F.count("*").alias("size"))
    fresh = before.join(now.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").withColumn("n", F.row_number().over(per_query(F.col("rank"))))
    added = fresh.join(size, "query_id", "left").na.fill(0, ["size"]).withColumn("rank", F.col("size") + F.col("n")).where(F.col("rank") <= most)
    return now.unionByName(added.select(now.columns))


def diversify(found: DataFrame, per_source: int = 2, least: int = rules.TOP_K_FINAL) -> DataFrame:
    """At most per_source rows of each source, in order of rank, then the first others while there are fewer than least; ranked anew."""
    n = F.row_number().over(Window.partitionBy("query_id", "source").orderBy("rank"))
    marked = found.withColumn("over", (n > per_source).cast("int"))
    kept = F.sum(1 - F.col("over")).over(Window.partitionBy("query_id"))
    place = F.row_number().over(Window.partitionBy("query_id", "over").orderBy("rank"))
    chosen = marked.withColumn("kept", kept).withColumn("place", place).where((F.col("over") == 0) | (F.col("place") <= F.lit(least) - F.col("kept")))
    return chosen.withColumn("rank", F.row_number().over(per_query(F.col("over"), F.col("place")))).drop("over", "kept", "place")


def missing_entities(entities: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, entity) of which no word of more than two letters occurs in the query's evidence (query_id, text)."""
    words = F.filter(F.split(F.lower("entity"), r"\s+"), lambda w: F.length(w) > 2)
    asked = entities.select("query_id", "entity", F.explode(words).alias("pattern"))
    held = occurrences(found.select("query_id", F.lower("text").alias("held")), F.col("held"), asked, keep=["query_id"]).select("query_id", "pattern").distinct()
    covered = asked.join(held, ["query_id", "pattern"]).select("query_id", "entity").distinct()
    return entities.select("query_id", "entity").join(covered, ["query_id", "entity"], "left_anti")


def supplements_of_all(missing: DataFrame, scored: DataFrame, existing: DataFrame, k: int = 2, most_held: int = rules.TOP_K_FINAL) -> DataFrame:
    """supplements() of (query_id, entity) with all chunks that each entity has (entity, chunk_id, score); a query holds at most most_held chunks of existing.

    Queries that miss the same entities are served by one list: of each such set and entity the best k + most_held chunks that no earlier entity of the set has,
    of which a query can hold no more than most_held. So scores are spread over sets of entities, never over queries.
    """
    sets = missing.groupBy("query_id").agg(F.array_sort(F.collect_set("entity")).alias("set"))
    members = sets.select("set").distinct().select("set", F.explode("set").alias("entity"))
    first = scored.join(F.broadcast(members), "entity").withColumn("n", F.row_number().over(Window.partitionBy("set", "chunk_id").orderBy("entity"))).where("n = 1")
    best = first.withColumn("n", F.row_number().over(Window.partitionBy("set", "entity").orderBy(F.col("score").desc(), "chunk_id"))).where(F.col("n") <= k + most_held)
    return supplements(sets.join(best.drop("n"), "set").select("query_id", "entity", "chunk_id", "score"), existing, k)


def supplements(scored: DataFrame, existing: DataFrame, k: int = 2) -> DataFrame:
    """For each missing entity (query_id, entity, chunk_id, score) its k best chunks that the query lacks; a chunk goes to the first entity that takes it."""
    fresh = scored.join(existing.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    first = fresh.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("entity"))).where("n = 1")
    best = first.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "entity").orderBy(F.col("score").desc(), "chunk_id"))).where(F.col("n") <= k)
    return best.drop("n")
