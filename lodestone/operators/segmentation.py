"""Segmentation of units by a model: triage, prompt, checks of the reply, one repair, and a fallback without a model.

Units are rows of unit_id, document_type, source_type, source, url, title, section, content. A reply is a JSON object with unit_id and segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import classify, rules
from lodestone.functions.storage import ensure_checkpoint_dir
from lodestone.functions.text import strip
from lodestone.operators import models, sentences

SEGMENT = "struct<segment_index:int,title:string,section:string,content_type:string,content:string,preserve_as_single_chunk:boolean,metadata:map<string,string>>"
REPLY = f"struct<unit_id:string,is_multi_topic:boolean,reasoning_brief:string,segments:array<{SEGMENT}>>"
FACTS = ("unit_id", "document_type", "source_type", "source", "url", "title", "section")
SCHOLARLY = "scholarly_paper_pdf"
ASKED = "Cut the unit below into segments of one topic each. Use its own words only. Answer with one JSON object: unit_id, is_multi_topic, reasoning_brief, and segments with segment_index, title, section, content_type, content, preserve_as_single_chunk, metadata."
ASKED_OF_PAPERS = "The unit is part of a paper: keep terms, names, results, numbers and limits as they stand, and its sections apart. "


def unit_prompt() -> Column:
    """What the model is asked about a unit."""
    facts = F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("none"))) for c in FACTS])
    of_paper = F.when(F.col("document_type") == SCHOLARLY, ASKED_OF_PAPERS).otherwise("")
    return F.concat(of_paper, F.lit(f"{ASKED}\n\n"), facts, F.lit("\n\ncontent:\n"), F.col("content"))


def repair_prompt(prompt: Column, reply: Column, problem: Column) -> Column:
    return F.concat(prompt, F.lit("\n\nYour reply was:\n"), reply, F.lit("\n\nIt cannot be used: "), problem, F.lit(". Answer with the corrected JSON object alone."))


def parsed(reply: Column) -> Column:
    """REPLY from a reply, with or without code fences; null where there is no JSON object."""
    return F.from_json(classify.json_part(reply), REPLY)


def problem(reply: Column, unit_id: Column, content: Column) -> Column:
    """Why a reply cannot be used; null where it can. Segments without content are grounded."""
    found = parsed(reply)
    segments = found["segments"]
    flat = F.regexp_replace(strip(content), r"\s+", " ")
    loose = F.exists(segments, lambda s: (strip(s["content"]) != "") & ~classify.is_grounded(F.regexp_replace(s["content"], r"\s+", " "), flat))
    return (
        F.when(found.isNull() | found["unit_id"].isNull(), "no JSON object of the asked form")
        .when(found["unit_id"] != unit_id, "it is about another unit")
        .when(F.coalesce(F.size(segments), F.lit(0)) < 1, "it has no segments")
        .when(F.exists(segments, lambda s: s["segment_index"].isNull() | s["content"].isNull()), "a segment lacks its index or its content")
        .when(~classify.unique_indices(F.transform(segments, lambda s: s["segment_index"])), "segment_index occurs twice")
        .when(loose, "a segment holds text that is not in the unit")
    )


def segments_of(reply: Column) -> Column:
    """The segments of a reply in order of their indices; what a segment says of itself goes before what is known of its unit."""
    base = F.map_from_arrays(F.array(*map(F.lit, FACTS)), F.array(*[F.col(c).cast("string") for c in FACTS]))

    def full(s: Column) -> Column:
        own = F.coalesce(s["metadata"], F.expr("map()").cast("map<string,string>"))
        merged = F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k)), own)
        return F.struct(s["segment_index"].alias("segment_index"), s["title"].alias("title"), s["section"].alias("section"), s["content_type"].alias("content_type"), strip(s["content"]).alias("content"), F.coalesce(s["preserve_as_single_chunk"], F.lit(True)).alias("preserve_as_single_chunk"), merged.alias("metadata"))

    order = lambda x, y: F.when(x["segment_index"] < y["segment_index"], -1).when(x["segment_index"] > y["segment_index"], 1).otherwise(0)
    return F.transform(F.array_sort(parsed(reply)["segments"], order), full)


def made(contents: Column, content_type: Column) -> Column:
    """Segments from pieces of the unit's content."""
    base = F.map_from_arrays(F.array(*map(F.lit, FACTS)), F.array(*[F.col(c).cast("string") for c in FACTS]))
    return F.transform(contents, lambda c, i: F.struct(i.alias("segment_index"), F.col("title"), F.col("section"), content_type.alias("content_type"), c.alias("content"), (F.length(c) <= rules.MAX_CHUNK_CHARS).alias("preserve_as_single_chunk"), base.alias("metadata")))


def segment_units(units: DataFrame, wants: Column, make=models.EchoCompleter) -> DataFrame:
    """units with route (single, model, repaired or fallback) and segments.

    Only units that want a model reach it, and only those with an unusable reply a second time. A column of units may not be called
    wants, prompt, reply, problem, route or segments. Null content is empty.
    """
    ensure_checkpoint_dir(units.sparkSession)
    units = units.withColumn("content", F.coalesce("content", F.lit("")))
    kind = F.when(F.col("document_type") == SCHOLARLY, "academic_overview").otherwise("other")
    pieces = sentences.joined(sentences.pack(sentences.split_sentences(F.col("content")), 5, 800))
    marked = units.withColumn("wants", F.coalesce(wants, F.lit(False)))
    single = marked.where("not wants").select(*units.columns, F.lit("single").alias("route"), made(F.array(strip(F.col("content"))), kind).alias("segments"))

    def judged(df: DataFrame) -> DataFrame:
        # Replies are written, so that a lost executor does not mean asking again.
        replied = df.withColumn("reply", models.complete(F.col("prompt"), make)).checkpoint()
        return replied.withColumn("problem", problem(F.col("reply"), F.col("unit_id"), F.col("content")))

    def used(df: DataFrame, route: str) -> DataFrame:
        return df.where("problem is null").select(*units.columns, F.lit(route).alias("route"), segments_of(F.col("reply")).alias("segments"))

    first = judged(marked.where("wants").withColumn("prompt", unit_prompt()))
    again = first.where("problem is not null").withColumn("prompt", repair_prompt(F.col("prompt"), F.col("reply"), F.col("problem")))
    second = judged(again.drop("reply", "problem"))
    fallback = second.where("problem is not null").select(*units.columns, F.lit("fallback").alias("route"), made(pieces, F.lit("other")).alias("segments"))
    out = single
    for part in (used(first, "model"), used(second, "repaired"), fallback):
        out = out.unionByName(part)
    return out
