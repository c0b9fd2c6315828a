"""Queries over cleaning, hashing and naming of texts.

The tables hold clean prose, so a fixed frame of page marks, stray white space, repeated lines and
boilerplate is put around each text, the same in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import ids, rules, text
from lodestone.operators import patterns
from lodestone.plans.registry import query, table

#: SQL with the same text as noisy().
NOISY = """
noisy AS (SELECT doc_id, source, text AS plain, concat('  Page 1  ', chr(13), chr(10), 'ISBN 12', chr(10), 'Running head', chr(10), replace(text, '. ', concat('.', chr(9), ' ', chr(10))),
 chr(10), ' 12 ', chr(10), chr(10), chr(10), chr(10), 'Running head', chr(13), '- item', chr(10), 'Running head ', chr(10), 'References', chr(10), 'https://doi.org/10.1', chr(10), 'end of li-', chr(10), 'ne') AS text FROM documents)
"""
S = r"^\s+|\s+$"
SQL_NORMAL = rf"""regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace({{0}}, '\r\n?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(regexp_replace(x, '{S}', '', 'g'), '[ \t]+', ' ', 'g')), chr(10)), '\n{{{{3,}}}}', concat(chr(10), chr(10)), 'g'), '{S}', '', 'g')"""
SQL_STRIP = rf"regexp_replace({{0}}, '{S}', '', 'g')"


def normal(c: str) -> str:
    return SQL_NORMAL.format(c)


def stripped(c: str) -> str:
    return SQL_STRIP.format(c)


def no_page_numbers(c: str) -> str:
    return f"array_to_string(list_filter(string_split({c}, chr(10)), lambda x: NOT regexp_matches({stripped('x')}, '^[0-9]{{1,4}}$')), chr(10))"


def noisy(spark, sf_dir) -> DataFrame:
    body = F.replace(F.col("text"), F.lit(". "), F.lit(".\t \n"))
    frame = F.concat(F.lit("  Page 1  \r\nISBN 12\nRunning head\n"), body, F.lit("\n 12 \n\n\n\nRunning head\r- item\nRunning head \nReferences\nhttps://doi.org/10.1\nend of li-\nne"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("plain"), frame.alias("text"))


@query("txt_normalize_ws", f"WITH {NOISY} SELECT doc_id, {normal('text')} AS text FROM noisy")
def txt_normalize_ws(spark, sf_dir):
    return noisy(spark, sf_dir).select("doc_id", text.normalize_ws(F.col("text")).alias("text"))


@query("txt_strip_pagenum", f"WITH {NOISY} SELECT doc_id, {no_page_numbers('text')} AS text FROM noisy")
def txt_strip_pagenum(spark, sf_dir):
    return noisy(spark, sf_dir).select("doc_id", text.strip_page_numbers(F.col("text")).alias("text"))


@query(
    "txt_drop_repeats",
    f"""WITH {NOISY}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM noisy),
k AS (SELECT doc_id, i, line, {stripped("line")} AS s, count(*) OVER (PARTITION BY doc_id, {stripped("line")}) AS n FROM l)
SELECT doc_id, coalesce(string_agg(CASE WHEN NOT (s <> '' AND n >= 3 AND length(s) < 200) THEN line END, chr(10) ORDER BY i), '') AS text FROM k GROUP BY doc_id""",
)
def txt_drop_repeats(spark, sf_dir):
    return noisy(spark, sf_dir).select("doc_id", text.drop_repeated_lines(F.col("text")).alias("text"))


@query("txt_merge_lines")
def txt_merge_lines(spark, sf_dir):
    return noisy(spark, sf_dir).select("doc_id", text.merge_broken_lines(F.col("text")).alias("text"))


@query("txt_clean")
def txt_clean(spark, sf_dir):
    return noisy(spark, sf_dir).select("doc_id", text.clean_text(F.col("text")).alias("text"))


@query("txt_noise_ratio", f"WITH {NOISY} SELECT doc_id, (length(text) - length(regexp_replace(text, '[\\x{{FFFD}}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'))) / length(text) AS ratio FROM noisy")
def txt_noise_ratio(spark, sf_dir):
    return noisy(spark, sf_dir).select("doc_id", text.noise_ratio(F.col("text")).alias("ratio"))


@query(
    "txt_drop_empty_lines",
    f"WITH {NOISY} SELECT doc_id, {stripped('''array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(''' + stripped('x') + ''', '[ \\t]+', ' ', 'g')), lambda x: x <> ''), chr(10))''')} AS text FROM noisy",
)
def txt_drop_empty_lines(spark, sf_dir):
    return noisy(spark, sf_dir).select("doc_id", text.drop_empty_lines(F.col("text")).alias("text"))


FLAT = stripped(r"regexp_replace(text, '\s+', ' ', 'g')")


@query("txt_snippet", f"WITH {NOISY}, f AS (SELECT doc_id, {FLAT} AS t FROM noisy) SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE concat(substr(t, 1, 117), '...') END AS snippet FROM f")
def txt_snippet(spark, sf_dir):
    return noisy(spark, sf_dir).select("doc_id", text.snippet(F.col("text"), 120).alias("snippet"))


@query(
    "txt_first_sentence",
    f"""WITH t AS (SELECT doc_id, {stripped("text")} AS t FROM documents), m AS (SELECT doc_id, t, regexp_extract(t, '(?s)^(.+?[.!?])(\\s|$)', 1) AS m FROM t),
c AS (SELECT doc_id, CASE WHEN m = '' THEN substr(t, 1, 320) ELSE {stripped("m")} END AS s FROM m)
SELECT doc_id, concat(substr(s, 1, 320), CASE WHEN length(s) >= 320 THEN '…' ELSE '' END) AS sentence FROM c""",
)
def txt_first_sentence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.first_sentence(F.col("text")).alias("sentence"))


@query("doc_summary", f"WITH {NOISY}, f AS (SELECT doc_id, {FLAT} AS t FROM noisy) SELECT doc_id, CASE WHEN length(t) > 800 THEN concat(substr(t, 1, 800), '…') ELSE t END AS summary FROM f")
def doc_summary(spark, sf_dir):
    return noisy(spark, sf_dir).select("doc_id", text.document_summary(F.col("text")).alias("summary"))


STOPPED = ", ".join(f"'{w}'" for w in rules.STOP_WORDS)


@query(
    "doc_keywords_topk",
    f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[A-Za-z][A-Za-z-]{{3,}}') AS ws FROM documents),
e AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
g AS (SELECT doc_id, word, count(*) AS n, min(p) AS p FROM e WHERE word NOT IN ({STOPPED}) GROUP BY doc_id, word),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS rank FROM g)
SELECT doc_id, word, n, rank FROM r WHERE rank <= 10""",
)
def doc_keywords_topk(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[A-Za-z][A-Za-z-]{3,}"), F.lit(0))).alias("p", "word"))
    counted = words.where(~F.col("word").isin(rules.STOP_WORDS)).groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("p").alias("p"))
    order = Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "p")
    return counted.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 10").select("doc_id", "word", "n", "rank")


@query("tokenize_counts", "SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS n_distinct FROM documents")
def tokenize_counts(spark, sf_dir):
    t = text.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


PAGE_DELETIONS = [r"(?im)^running\s+head\s*$", r"(?m)^https?://doi\.org/.*$", r"(?s)ISBN.*?\n"]


def deleted(c: str, patterns: list[str]) -> str:
    for p in patterns:
        c = f"regexp_replace({c}, '{p}', '', 'g')"
    return c


@query("pdf_page_clean", f"WITH {NOISY} SELECT doc_id, {stripped('''regexp_replace(regexp_replace(''' + no_page_numbers(deleted(normal('text'), PAGE_DELETIONS)) + ''', '-\\n([a-z])', '\\1', 'g'), '\\n{3,}', concat(chr(10), chr(10)), 'g')''')} AS text FROM noisy")
def pdf_page_clean(spark, sf_dir):
    return noisy(spark, sf_dir).select("doc_id", text.pdf_page_clean(F.col("text"), PAGE_DELETIONS).alias("text"))


WEB_DELETIONS = [r"(?m)^(?:Page 1|References)[ \t]*$", r"(?m)^\s*Menu\s*$", r"(?m)Running head.?$"]


@query(
    "web_clean",
    f"WITH {NOISY} SELECT doc_id, {stripped('''regexp_replace(array_to_string(list_transform(string_split(regexp_replace(''' + deleted('text', WEB_DELETIONS) + ''', '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: ''' + stripped('x') + '''), chr(10)), '\\n{3,}', concat(chr(10), chr(10)), 'g')''')} AS text FROM noisy",
)
def web_clean(spark, sf_dir):
    return noisy(spark, sf_dir).select("doc_id", text.web_clean(F.col("text"), [p.replace("(?m)", "(?md)") for p in WEB_DELETIONS]).alias("text"))


SKIPPED = " AND ".join(f"NOT regexp_matches(s, '{p}')" for p in rules.PREAMBLE_SKIP)


@query(
    "condense_preamble",
    f"""WITH {NOISY}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM noisy),
k AS (SELECT doc_id, i, {stripped("line")} AS s FROM l), f AS (SELECT doc_id, i, s, lag(s) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM k WHERE length(s) >= 5 AND {SKIPPED})
SELECT doc_id, string_agg(s, ' ' ORDER BY i) AS text FROM f WHERE before IS NULL OR before <> s GROUP BY doc_id""",
)
def condense_preamble(spark, sf_dir):
    return noisy(spark, sf_dir).select("doc_id", text.condense_preamble(F.col("text")).alias("text")).where("text <> ''")


@query(
    "cross_page_repeats",
    f"""WITH p AS (SELECT source, doc_id, concat('Head of ', source, chr(10), text, chr(10), 'part ', (doc_id % 3)::VARCHAR) AS text FROM documents),
l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM p), k AS (SELECT source, doc_id, {stripped("line")} AS s FROM l),
n AS (SELECT source, count(*) AS pages FROM documents GROUP BY source), c AS (SELECT source, s, count(*) AS n FROM k WHERE length(s) BETWEEN 6 AND 200 GROUP BY source, s)
SELECT c.source, c.s AS line, c.n FROM c JOIN n USING (source) WHERE pages >= 5 AND c.n >= greatest(3, (pages * 35) // 100)""",
)
def cross_page_repeats(spark, sf_dir):
    """Lines that repeat over the pages of a document; here a source is the document, its rows the pages."""
    docs = table(spark, sf_dir, "documents")
    framed = docs.select("source", F.concat(F.lit("Head of "), "source", F.lit("\n"), "text", F.lit("\npart "), (F.col("doc_id") % 3).cast("string")).alias("text"))
    from lodestone.operators.lines import repeated_over_pages

    return repeated_over_pages(framed, "source", "text")


@query(
    "doc_id_hash",
    "SELECT page_id, coalesce(substr(sha256(CASE WHEN page_id % 7 = 0 THEN NULL ELSE url END), 1, 12), 'unknown') AS doc_id FROM pages",
)
def doc_id_hash(spark, sf_dir):
    url = F.when(F.col("page_id") % 7 != 0, F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", ids.document_id(F.lit(None).cast("string"), url).alias("doc_id"))


@query("unit_id_hash", "SELECT doc_id, concat(substr(sha256(source), 1, 12), '_u', (doc_id % 9)::VARCHAR, '_', substr(sha256(substr(text, 1, 500)), 1, 12)) AS unit_id FROM documents")
def unit_id_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ids.unit_id(ids.document_id(F.col("source"), F.lit(None)), F.col("doc_id") % 9, F.col("text")).alias("unit_id"))


@query("chunk_id_sha", "SELECT doc_id, substr(sha256(concat('pilot|', source, '|', doc_id::VARCHAR)), 1, 16) AS pdf_id, substr(sha256(concat(source, '|', doc_id::VARCHAR, '|', 2)), 1, 16) AS agent_id FROM documents")
def chunk_id_sha(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ids.pdf_chunk_id(F.col("source"), F.col("doc_id")).alias("pdf_id"), ids.agent_chunk_id(F.col("source"), F.col("doc_id"), F.lit(2)).alias("agent_id"))


@query("chunk_id_md5", "SELECT page_id, substr(md5(concat(url, '::', page_id::VARCHAR)), 1, 16) AS chunk_id FROM pages")
def chunk_id_md5(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", ids.web_chunk_id(F.col("url"), F.col("page_id")).alias("chunk_id"))


@query("embedding_text", "SELECT doc_id, concat('Title: ', source, chr(10), CASE WHEN doc_id % 2 = 0 THEN concat('Section: ', lang, chr(10)) ELSE '' END, 'Type: other', chr(10), 'Content: ', text) AS text FROM documents")
def embedding_text(spark, sf_dir):
    section = F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", ids.embedding_text(F.col("source"), section, F.lit("other"), F.col("text")).alias("text"))


@query("qa_text", "SELECT item_id, concat_ws(' | ', substr(text, 1, 40), substr(text, 5, 9), lower(substr(text, 1, 8)), substr(text, 3, 7), substr(text, 1, 300)) AS text FROM benchmark")
def qa_text(spark, sf_dir):
    t = F.col("text")
    alternates = F.array(F.substring(t, 5, 9), F.lower(F.substring(t, 1, 8)), F.substring(t, 3, 7), F.lit("a fourth"))
    return table(spark, sf_dir, "benchmark").select("item_id", ids.qa_text(F.substring(t, 1, 40), alternates, t).alias("text"))


TITLES = {"src1": "First of the reports", "src2": "Second of the reports", "c3": "Third"}


@query("pretty_title", "SELECT doc_id, CASE WHEN s LIKE '%src1%' THEN 'First of the reports' WHEN s LIKE '%src2%' THEN 'Second of the reports' WHEN s LIKE '%c3%' THEN 'Third' ELSE replace(s, '_', ' ') END AS title FROM (SELECT doc_id, concat(source, '_of_', lang) AS s FROM documents)")
def pretty_title(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ids.pretty_title(F.concat("source", F.lit("_of_"), "lang", F.lit(".pdf")), TITLES).alias("title"))


@query(
    "contextualize",
    """WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'website' ELSE 'note' END AS st, source AS title, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN 'Preamble' ELSE lang END AS section, CASE WHEN doc_id % 4 = 0 THEN 'table' ELSE 'paragraph' END AS ct FROM documents)
SELECT doc_id, CASE st WHEN 'pdf' THEN concat('From the report ''', title, ''' of the institute.', CASE WHEN section <> '' AND section <> 'Preamble' THEN concat(chr(10), 'Section: ', section, '.') ELSE '' END, CASE WHEN ct = 'table' THEN concat(chr(10), 'This is tabular data.') ELSE '' END)
WHEN 'website' THEN concat('From the web page ''', title, ''' of the institute.', CASE WHEN title LIKE '%1%' THEN concat(chr(10), 'It is about people.') WHEN title LIKE '%2%' THEN concat(chr(10), 'It is about projects.') ELSE '' END, CASE WHEN section <> '' THEN concat(chr(10), 'Section: ', section, '.') ELSE '' END)
ELSE 'From the institute.' END AS prefix FROM d""",
)
def contextualize(spark, sf_dir):
    i = F.col("doc_id")
    kind = F.when(i % 3 == 0, "pdf").when(i % 3 == 1, "website").otherwise("note")
    section = F.when(i % 5 == 0, "").when(i % 5 == 1, "Preamble").otherwise(F.col("lang"))
    prefix = ids.context_prefix(kind, F.col("source"), section, F.when(i % 4 == 0, "table").otherwise("paragraph"), F.col("source"), hints={"1": "It is about people.", "2": "It is about projects."})
    return table(spark, sf_dir, "documents").select("doc_id", prefix.alias("prefix"))


@query(
    "pattern_mentions",
    """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) AS pattern FROM benchmark) SELECT pattern, count(*) AS documents, min(strpos(lower(text), pattern) - 1)::INT AS earliest FROM documents JOIN w ON contains(lower(text), pattern) GROUP BY pattern""",
)
def pattern_mentions(spark, sf_dir):
    """For every longer word of the benchmark the documents that hold it anywhere, and the earliest place in one."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0))).alias("pattern"))
    found = patterns.occurrences(table(spark, sf_dir, "documents"), F.lower("text"), words, keep=["doc_id"])
    return found.groupBy("pattern").agg(F.count("*").alias("documents"), F.min("at").alias("earliest"))
