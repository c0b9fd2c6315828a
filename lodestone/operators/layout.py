"""Layout of paged documents: blocks under headings, tables and figures with the pages that they span, and their chunks.

Lines are rows; markers, the start of the bibliography and block numbers are windows over the lines of one document, which meet in one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import classify, ids, rules
from lodestone.functions.storage import written
from lodestone.functions.text import condense_preamble, strip
from lodestone.operators import sentences


def content_pages(pages: DataFrame, doc: str) -> DataFrame:
    """pages without those of references alone; of a document that has no others the first one."""
    marked = pages.withColumn("_refs", F.coalesce(classify.is_reference_page(F.col("text")), F.lit(False)))
    w = Window.partitionBy(doc)
    spared = F.min("_refs").over(w) & (F.col("page") == F.min("page").over(w))
    return marked.withColumn("_keep", ~F.col("_refs") | spared).where("_keep").drop("_refs", "_keep")


def begins_bibliography(doc: str) -> Column:
    """Whether a line is the first of an entry of a bibliography; the last line of a page is none."""
    w = Window.partitionBy(doc, "page").orderBy("line_no")
    after = [F.lead("line", n).over(w) for n in range(1, 5)]
    s, context = strip(F.col("line")), F.concat_ws("\n", "line", *after)
    number = F.regexp_extract(s, rules.ENTRY_NUMBER, 1)
    alone = (number != "") & strip(after[0]).rlike(rules.ENTRY_AUTHOR) & (context.rlike(rules.REFERENCE_SIGNALS) | (number.try_cast("decimal(38,0)") <= 3))
    return after[0].isNotNull() & (alone | (s.rlike(rules.ENTRY_LINE) & s.rlike(rules.REFERENCE_SIGNALS)))


def marker(line: Column) -> Column:
    """struct<kind, number, label> of a line that begins a block: a table's, then a figure's, then a section's; null for others."""
    s = strip(line)

    def captioned(kind: str, name: str, pattern: str) -> Column:
        caption = F.substring(strip(F.regexp_extract(s, pattern, 2)), 1, 80)
        number = F.regexp_extract(s, pattern, 1)
        return F.struct(F.lit(kind).alias("kind"), number.alias("number"), F.concat(F.lit(f"{name} "), number, F.lit(". "), F.when(caption == "", "Untitled").otherwise(caption)).alias("label"))

    number, label = classify.heading_number(s), classify.heading(s)
    section = F.struct(F.lit("section").alias("kind"), number.alias("number"), F.when(number == "", label).otherwise(F.concat(number, F.lit(". "), label)).alias("label"))
    return F.when(s.rlike(rules.TABLE_LABEL), captioned("table", "Table", rules.TABLE_LABEL)).when(s.rlike(rules.FIGURE_LABEL), captioned("figure", "Figure", rules.FIGURE_LABEL)).when(label.isNotNull(), section)


def marked_lines(pages: DataFrame, doc: str) -> DataFrame:
    """(doc, page, line_no, line, marker, block): the lines up to the bibliography; block counts the markers so far."""
    held = content_pages(pages.select(doc, "page", "text"), doc)
    lines = held.select(doc, "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    so_far = Window.partitionBy(doc).orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    kept = lines.withColumn("_ends", begins_bibliography(doc)).withColumn("_over", F.max("_ends").over(so_far)).where("not _over").drop("_ends", "_over")
    found = kept.withColumn("marker", marker(F.col("line")))
    return found.withColumn("block", F.count("marker").over(so_far))


def joined_lines(keep: Column | None = None) -> Column:
    """The lines of a group in order as one text."""
    row = F.struct("page", "line_no", "line")
    rows = F.array_sort(F.collect_list(row if keep is None else F.when(keep, row)))
    return strip(F.array_join(F.transform(rows, lambda x: x["line"]), "\n"))


def blocks(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, place, kind, number, heading, page_start, page_end, body) of every block of paged documents (doc, page, text).

    A document without a block falls back to its pages, one without a page of some length to itself as a whole. Documents of null
    text alone have none.
    """
    lines = written(marked_lines(pages, doc), "layout")
    span = [F.min("page").alias("page_start"), F.max("page").alias("page_end")]
    grouped = lines.groupBy(doc, "block").agg(F.first("marker", ignorenulls=True).alias("m"), joined_lines(F.col("marker").isNull()).alias("body"), *span)
    least = F.when(F.col("block") == 0, rules.LEAST_PREAMBLE).otherwise(rules.LEAST_BLOCK)
    under = grouped.where(F.length("body") >= least).select(
        doc, F.col("block").cast("long").alias("place"), F.coalesce("m.kind", F.lit("preamble")).alias("kind"), F.coalesce("m.number", F.lit("0")).alias("number"), F.coalesce("m.label", F.lit("Preamble")).alias("heading"), "page_start", "page_end", "body"
    )
    rest = lines.join(under.select(doc).distinct(), doc, "left_anti")
    by_page = rest.groupBy(doc, "page").agg(joined_lines().alias("body")).where(F.length("body") >= rules.LEAST_PREAMBLE)
    paged = by_page.select(doc, F.col("page").cast("long").alias("place"), F.lit("body").alias("kind"), F.lit("").alias("number"), F.concat(F.lit("Page "), F.col("page").cast("string")).alias("heading"), F.col("page").alias("page_start"), F.col("page").alias("page_end"), "body")
    whole = rest.join(paged.select(doc).distinct(), doc, "left_anti").groupBy(doc).agg(joined_lines().alias("body"), *span)
    single = whole.select(doc, F.lit(0).cast("long").alias("place"), F.lit("body").alias("kind"), F.lit("0").alias("number"), F.lit("Document").alias("heading"), "page_start", "page_end", "body")
    return under.unionByName(paged).unionByName(single)


CHUNK = "struct<section:string,page_start:bigint,page_end:bigint,text:string,embedding_text:string,kind:string>"


def block_chunks() -> Column:
    """array of CHUNK of a row of blocks(): tables by rows, preambles condensed, captions whole, other text in overlapping groups of sentences."""
    kind, body, heading = F.col("kind"), F.col("body"), F.col("heading")

    def groups(text: Column, overlap: int) -> Column:
        return F.filter(F.transform(sentences.joined(sentences.pack(sentences.split_sentences(text, sentences.PDF), overlap=overlap)), strip), lambda x: x != "")

    def made(texts: Column, chunk_type, titled) -> Column:
        return F.transform(texts, lambda x, i: F.struct(heading.alias("section"), F.col("page_start").cast("long").alias("page_start"), F.col("page_end").cast("long").alias("page_end"), x.alias("text"), F.when(titled(i), F.concat(heading, F.lit("\n"), x)).otherwise(x).alias("embedding_text"), chunk_type(x).alias("kind")))

    always, never, as_text = (lambda i: F.lit(True)), (lambda i: F.lit(False)), (lambda x: classify.pdf_chunk_type(x, F.lit("body")))
    condensed = condense_preamble(body)
    preamble = F.when(F.length(condensed) >= rules.LEAST_CONDENSED, made(groups(condensed, 0), lambda x: F.lit("metadata"), never)).otherwise(F.array().cast(f"array<{CHUNK}>"))
    long_figure = made(groups(body, 1), as_text, lambda i: i == 0)
    caption = made(F.array(body), lambda x: F.lit("figure_caption"), always)
    return (
        F.when(kind == "preamble", preamble)
        .when(kind == "table", made(sentences.table_chunks(body), lambda x: F.lit("table"), always))
        .when((kind == "figure") & (F.length(body) > rules.MAX_CHUNK_CHARS), long_figure)
        .when(kind == "figure", caption)
        .otherwise(made(groups(body, rules.OVERLAP_SENTENCES), as_text, never))
    )


def merged(chunks: Column) -> Column:
    """Small chunks into their neighbours: in a section, then any that still are too short, then a short first one into the next. Pages widen; texts to embed are those merged."""
    grown = lambda a, b: F.struct(a["section"].alias("section"), a["page_start"].alias("page_start"), F.greatest(a["page_end"], b["page_end"]).alias("page_end"), F.concat(a["text"], F.lit(" "), b["text"]).alias("text"), F.concat(a["text"], F.lit(" "), b["text"]).alias("embedding_text"), a["kind"].alias("kind"))
    into_next = lambda a, b: F.struct(b["section"].alias("section"), F.least(a["page_start"], b["page_start"]).alias("page_start"), b["page_end"].alias("page_end"), F.concat(a["text"], F.lit(" "), b["text"]).alias("text"), F.concat(a["text"], F.lit(" "), b["text"]).alias("embedding_text"), b["kind"].alias("kind"))
    return sentences.merge_small(chunks, small=rules.MIN_CHUNK_CHARS, least=rules.HARD_MIN_CHARS, kind=CHUNK, grown=grown, into_next=into_next)


def chunks(pages: DataFrame, doc: str = "doc_id", name: Column | None = None) -> DataFrame:
    """The chunks of paged documents: doc, chunk_index, chunk_id, section_title, page_start, page_end, chunk_text, embedding_text, chunk_type, quality_flag.

    Chunks that look like references are left out before small ones are merged. name is what ids are made of, by default the document's.
    """
    made = blocks(pages, doc).select(doc, "place", block_chunks().alias("c"))
    whole = made.groupBy(doc).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "c"))), lambda x: x["c"])).alias("c"))
    kept = F.filter("c", lambda x: ~classify.looks_like_reference(x["text"], x["kind"]))
    rows = whole.select(doc, F.posexplode(merged(kept)).alias("i", "c"))
    stem = F.col(doc).cast("string") if name is None else name
    return rows.select(
        doc, F.col("i").cast("long").alias("chunk_index"), ids.pdf_chunk_id(stem, F.col("i")).alias("chunk_id"), F.col("c.section").alias("section_title"), "c.page_start", "c.page_end", F.col("c.text").alias("chunk_text"), "c.embedding_text", F.col("c.kind").alias("chunk_type"), classify.pdf_quality(F.col("c.text")).alias("quality_flag")
    )
