"""Queries over sentences, chunks and sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import ids, text
from lodestone.operators import lines, sentences
from lodestone.plans.registry import query, table
from lodestone.plans.text_queries import stripped


def sql_sentences(c: str, opening: str = "A-Z\"''(\\[") -> str:
    """The look-around split in two steps with a mark that no text holds."""
    marked = f"regexp_replace(regexp_replace({stripped(c)}, '([.!?])\\s+([{opening}])', concat('\\1', chr(1), '\\2'), 'g'), '(?m)([.!?])\\s*$', concat('\\1', chr(1)), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda x: {stripped('x')}), lambda x: x <> '')"


def exploded(spark, sf_dir, column, name: str):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(column).alias("i", name)).withColumn("i", F.col("i").cast("long"))


@query("sentence_split", f"WITH s AS (SELECT doc_id, {sql_sentences('text')} AS s FROM documents) SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS i FROM s")
def sentence_split(spark, sf_dir):
    return exploded(spark, sf_dir, sentences.split_sentences(F.col("text")), "sentence")


PDF_OPENING = "A-Z\"''(\\[“"


@query("sentence_split_pdf", f"WITH s AS (SELECT doc_id, {sql_sentences('text', PDF_OPENING)} AS s FROM documents) SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS i FROM s")
def sentence_split_pdf(spark, sf_dir):
    return exploded(spark, sf_dir, sentences.split_sentences(F.col("text"), sentences.PDF), "sentence")


@query("sentence_split_web")
def sentence_split_web(spark, sf_dir):
    return exploded(spark, sf_dir, sentences.split_web_sentences(F.col("text")), "sentence")


def sql_pack(most: int, chars: int, following: str, opening: str = "A-Z\"''(\\[") -> str:
    """Groups by recursion over start positions; following gives the next start from i and j."""
    sizes = ", ".join(str(k) for k in range(2, most + 1))
    return f"""WITH RECURSIVE s AS (SELECT doc_id, {sql_sentences("text", opening)} AS s FROM documents),
p AS (SELECT doc_id, s, len(s) AS n, list_prepend(0, list_transform(s, lambda x, i: list_sum(list_transform(s[1:i], lambda y: length(y)))))::BIGINT[] AS e FROM s WHERE len(s) > 0),
z AS (SELECT doc_id, s, n, list_transform(s, lambda x, i: greatest(1, coalesce(list_max(list_filter([{sizes}], lambda k: i - 1 + k <= n AND e[i + k] - e[i] + k - 1 <= {chars})), 1)))::BIGINT[] AS z FROM p),
r AS (SELECT doc_id, 0::BIGINT AS g, 0::BIGINT AS i, z[1] AS j FROM z
UNION ALL SELECT doc_id, g, i, i + z[i + 1] AS j FROM (SELECT r.doc_id, r.g + 1 AS g, {following}::BIGINT AS i, z.z, z.n FROM r JOIN z USING (doc_id) WHERE r.j < z.n) q)
SELECT r.doc_id, r.g AS i, array_to_string(z.s[r.i + 1:r.j], ' ') AS chunk FROM r JOIN z USING (doc_id)"""


@query("pack_greedy", sql_pack(5, 800, "r.j"))
def pack_greedy(spark, sf_dir):
    return exploded(spark, sf_dir, sentences.joined(sentences.pack(sentences.split_sentences(F.col("text")), 5, 800)), "chunk")


@query("pack_overlap_agent", sql_pack(5, 800, "(CASE WHEN r.j - 2 <= r.i THEN r.j ELSE r.j - 2 END)"))
def pack_overlap_agent(spark, sf_dir):
    return exploded(spark, sf_dir, sentences.joined(sentences.pack(sentences.split_sentences(F.col("text")), 5, 800, 2, skip_stuck=True)), "chunk")


@query("pack_overlap_pdf", sql_pack(5, 700, "greatest(r.i + 1, r.j - 2)", PDF_OPENING))
def pack_overlap_pdf(spark, sf_dir):
    return exploded(spark, sf_dir, sentences.joined(sentences.pack(sentences.split_sentences(F.col("text"), sentences.PDF), overlap=2)), "chunk")


@query("pack_overlap_web")
def pack_overlap_web(spark, sf_dir):
    return exploded(spark, sf_dir, sentences.joined(sentences.pack(sentences.split_web_sentences(F.col("text")), overlap=2)), "chunk")


def listed():
    return F.concat(F.col("text"), F.lit("\n- first item\n  * second item\n\n3. third item\nrest"))


@query(
    "list_pieces",
    f"""WITH t AS (SELECT doc_id, {stripped("concat(text, chr(10), '- first item', chr(10), '  * second item', chr(10), chr(10), '3. third item', chr(10), 'rest')")} AS t FROM documents),
p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '\\n(\\s*(?:[-•*]|[0-9]+\\.)\\s+\\S)', concat(chr(1), '\\1'), 'g'), chr(1)), lambda x: {stripped("x")}), lambda x: x <> '') AS p FROM t)
SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) - 1 AS i FROM p""",
)
def list_pieces(spark, sf_dir):
    return exploded(spark, sf_dir, sentences.list_pieces(listed()), "piece")


@query("table_pack")
def table_pack(spark, sf_dir):
    return exploded(spark, sf_dir, sentences.table_chunks(F.col("text")), "chunk")


@query("slide_groups")
def slide_groups(spark, sf_dir):
    return exploded(spark, sf_dir, sentences.joined(sentences.slide_groups(F.split("text", "\n")), "\n\n"), "chunk")


def chunks_of(text_col, size: int):
    """CHUNKs of a text: its lines, so many lines to a section."""
    return F.transform(F.filter(F.split(text_col, "\n"), lambda x: text.strip(x) != ""), lambda x, i: F.struct(F.concat(F.lit("s"), F.floor(i / size).cast("string"), F.lit(" (part "), i.cast("string"), F.lit(")")).alias("section"), x.alias("text")))


@query("merge_small_pdf")
def merge_small_pdf(spark, sf_dir):
    found = sentences.merge_small(chunks_of("text", 3), small=120)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(found).alias("i", "c"))
    return docs.select("doc_id", F.col("i").cast("long").alias("i"), "c.section", "c.text")


@query("merge_small_web")
def merge_small_web(spark, sf_dir):
    found = sentences.merge_small(chunks_of("text", 3), small=200, base_title=True, forward=False)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(found).alias("i", "c"))
    return docs.select("doc_id", F.col("i").cast("long").alias("i"), "c.section", "c.text")


LINED = f"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), k AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i FROM l WHERE {stripped("x")} <> '')"""


@query(
    "merge_neighbours",
    f"""WITH RECURSIVE {LINED}, r AS (SELECT doc_id, i, 0::BIGINT AS g, x AS text FROM k WHERE i = 1
UNION ALL SELECT k.doc_id, k.i, CASE WHEN length(k.x) < 200 AND length(r.text) + length(k.x) + 1 <= 900 THEN g ELSE g + 1 END, CASE WHEN length(k.x) < 200 AND length(r.text) + length(k.x) + 1 <= 900 THEN concat(r.text, ' ', k.x) ELSE k.x END FROM r JOIN k ON k.doc_id = r.doc_id AND k.i = r.i + 1)
SELECT doc_id, g AS i, arg_max(text, i) AS text FROM (SELECT doc_id, g, i, text FROM r) q GROUP BY doc_id, g""",
)
def merge_neighbours(spark, sf_dir):
    """The lines of documents as chunks, short ones with the one before."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(sentences.merge_neighbours(chunks_of("text", 3))).alias("i", "c"))
    return docs.select("doc_id", F.col("i").cast("long").alias("i"), "c.text")


@query("merge_first", f"WITH {LINED}, t AS (SELECT *, first_value(length(x)) OVER w < 200 AND count(*) OVER (PARTITION BY doc_id) > 1 AS moves, lag(x) OVER w AS before FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)) SELECT doc_id, i - 1 - moves::INT AS i, CASE WHEN moves AND i = 2 THEN concat(before, ' ', x) ELSE x END AS text FROM t WHERE NOT (moves AND i = 1)")
def merge_first(spark, sf_dir):
    """The lines of documents as chunks, a short first one at the head of the second."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(sentences.merge_first(chunks_of("text", 3))).alias("i", "c"))
    return docs.select("doc_id", F.col("i").cast("long").alias("i"), "c.text")


PAGED = "p AS (SELECT source AS doc, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, text FROM documents)"


def paged(spark, sf_dir):
    """Every document as a page of its source."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), "doc_id", "text")


RANGES = f"{PAGED}, r AS (SELECT doc, page, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s, length(text) AS n FROM p)"


@query("page_char_ranges", f"WITH {RANGES} SELECT doc, page, s AS start, s + n AS \"end\" FROM r")
def page_char_ranges(spark, sf_dir):
    return lines.char_ranges(paged(spark, sf_dir), "doc", "doc_id").drop("doc_id")


@query("span_pages_join", f"WITH {RANGES}, q AS (SELECT doc, unnest(generate_series(0, max(s + n) // 3000)) AS span_id FROM r GROUP BY doc) SELECT doc, span_id, min(page) AS page_start, max(page) AS page_end FROM q JOIN r USING (doc) WHERE s <= span_id * 3000 + 2500 AND s + n >= span_id * 3000 GROUP BY doc, span_id")
def span_pages_join(spark, sf_dir):
    """Pages of spans of 2,500 characters, one every 3,000 over the whole of each source."""
    ranges = lines.char_ranges(paged(spark, sf_dir), "doc", "doc_id")
    last = F.floor(F.col("last") / 3000)
    spans = ranges.groupBy("doc").agg(F.max("end").alias("last")).select("doc", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("span_id"))
    return lines.span_pages(spans.select("doc", "span_id", (F.col("span_id") * 3000).alias("from"), (F.col("span_id") * 3000 + 2500).alias("to")), ranges, "doc", "page")


@query("pdf_pages_concat", "WITH p AS (SELECT doc_id, unnest(generate_series(0, greatest(length(text) - 1, 0) // 3000)) AS i, text FROM documents) SELECT doc_id, count(*) AS pages, md5(string_agg(substr(text, i * 3000 + 1, 3000), concat(chr(10), chr(10)) ORDER BY i)) AS text_md5 FROM p GROUP BY doc_id")
def pdf_pages_concat(spark, sf_dir):
    """Pages of 3,000 characters joined to the text of their document; a group is one document."""
    i = F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / 3000).cast("int")))
    pages = table(spark, sf_dir, "documents").select("doc_id", i.alias("i"), "text").select("doc_id", "i", F.substring("text", F.col("i") * 3000 + 1, F.lit(3000)).alias("text"))
    whole = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.array_sort(F.collect_list(F.struct("i", "text"))).alias("p"))
    return whole.select("doc_id", "pages", F.md5(F.array_join(F.transform("p", lambda x: x["text"]), "\n\n")).alias("text_md5"))


@query("segment_chunks")
def segment_chunks(spark, sf_dir):
    """Segments cut at list items, each piece packed with overlap, parts numbered over the whole segment."""
    pieces = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(sentences.list_pieces(listed())).alias("piece", "t"))
    groups = pieces.select("doc_id", "source", "piece", F.posexplode(sentences.joined(sentences.pack(sentences.split_sentences(F.col("t")), 5, 800, 1, skip_stuck=True))).alias("g", "chunk"))
    from pyspark.sql import Window

    part = F.row_number().over(Window.partitionBy("doc_id").orderBy("piece", "g"))
    numbered = groups.withColumn("part", part.cast("long"))
    title = F.concat("source", F.lit(" (part "), F.col("part").cast("string"), F.lit(")"))
    return numbered.select("doc_id", "part", title.alias("title"), ids.agent_chunk_id(F.col("source"), F.lit(0), F.col("part")).alias("chunk_id"), "chunk")


@query("fallback_segments")
def fallback_segments(spark, sf_dir):
    """Units without a model: one segment a greedy group."""
    found = exploded(spark, sf_dir, sentences.joined(sentences.pack(sentences.split_sentences(F.col("text")), 5, 800)), "content")
    return found.select("doc_id", F.col("i").alias("segment_index"), F.lit("other").alias("content_type"), (F.length("content") <= 800).alias("preserve"), "content")


@query("page_min_length", f"SELECT doc_id FROM documents WHERE length({stripped('text')}) >= 50 AND source NOT IN ('src3', 'src7')")
def page_min_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").where((F.length(text.strip(F.col("text"))) >= 50) & ~F.col("source").isin("src3", "src7")).select("doc_id")
