"""Cleaning of whole documents, whichever form they come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import clean_text
from lodestone.operators import lines

GAP = "\n\n"


def _whole(parts: DataFrame, doc: str, order: str, text: Column, route: str) -> DataFrame:
    held = parts.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t")))).alias("p"))
    return held.select(doc, F.lit(route).alias("route"), F.array_join(F.transform("p", lambda x: x["t"]), GAP).alias("text"))


def clean_documents(docs: DataFrame, pages: DataFrame, sections: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, route, text) of docs (doc, text): by its pages (doc, page, text) if it has any, else by its sections (doc, i, heading, content), else by its text.

    Pages are cleaned one by one, lines that many of them share go, and they are joined by a blank line; sections are cleaned under their
    headings. A null text stays null.
    """
    cleaned = lines.without_repeats(pages.select(doc, "page", clean_text(F.col("text")).alias("text")), doc, longest=220)
    by_page = _whole(cleaned.join(docs.select(doc), doc, "left_semi"), doc, "page", F.col("text"), "pages")
    unpaged = docs.join(pages.select(doc).distinct(), doc, "left_anti")
    content = clean_text(F.col("content"))
    named = F.when(F.col("heading") != "", F.concat("heading", F.lit("\n"), content)).otherwise(content)
    by_section = _whole(sections.join(unpaged.select(doc), doc, "left_semi"), doc, "i", named, "sections")
    rest = unpaged.join(sections.select(doc).distinct(), doc, "left_anti")
    return by_page.unionByName(by_section).unionByName(rest.select(doc, F.lit("text").alias("route"), clean_text(F.col("text")).alias("text")))
