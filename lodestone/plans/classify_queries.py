"""Queries over document types, flags, intents and checks.

Word lists that this corpus' invented prose can hit stand in for the domain's; they are parameters of the functions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import classify, rules
from lodestone.plans.registry import query, table
from lodestone.plans.text_queries import NOISY, noisy, stripped

SCHOLARLY = [r"\bthe\b", r"\bein\b", r"\bque\b", r"\blas\b", r"\blicensed\b", r"\bpublic\b", r"\bunder\b"]
INSTITUTE = [r"\bof\b", r"\bder\b", r"\bles\b", r"\bversion\b"]
INTENTS = {"general_overview": ["licensed under", "tion of"], "publication_finding": ["chen ", "eau "], "project_initiative": ["thand", "ción"], "no_evidence": ["password", "ingen"], "synthesis": ["the ", "und "]}


def sum_hits(c: str, patterns: list[str]) -> str:
    return " + ".join(f"regexp_matches({c}, '{p}')::INT" for p in patterns)


@query(
    "doc_type_classify",
    f"""WITH d AS (SELECT doc_id, source AS path, lower(substr(concat(source, ' ', text), 1, 200000)) AS low, doc_id % 10 = 0 AS web FROM documents),
s AS (SELECT doc_id, web, {sum_hits("low", SCHOLARLY)} + CASE WHEN path = 'src1' THEN 3 ELSE 0 END AS s, {sum_hits("low", INSTITUTE)} + CASE WHEN path = 'src2' THEN 2 ELSE 0 END AS i FROM d)
SELECT doc_id, CASE WHEN web THEN 'website_page' WHEN s >= 4 AND s >= i THEN 'scholarly_paper_pdf' WHEN i >= 2 AND i > s THEN 'institute_report_pdf' WHEN s >= 3 THEN 'scholarly_paper_pdf' ELSE 'institute_report_pdf' END AS type FROM s""",
)
def doc_type_classify(spark, sf_dir):
    path = F.when(F.col("source") == "src1", F.lit("papers/src1")).when(F.col("source") == "src2", F.lit("annual/src2")).otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", classify.document_type(F.col("text"), path, F.col("doc_id") % 10 == 0, SCHOLARLY, INSTITUTE).alias("type"))


def sql_intent(c: str) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'contains({c}, {w!r})' for w in words)} THEN '{name}'" for name, words in INTENTS.items())
    return f"CASE {cases} ELSE '{rules.DEFAULT_INTENT}' END"


@query("intent_classify", f"SELECT item_id, {sql_intent('lower(text)')} AS intent FROM benchmark")
def intent_classify(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", classify.intent(F.col("text"), INTENTS).alias("intent"))


def any_match(c: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, '{p}')" for p in patterns) + ")"


FRAMED = "CASE doc_id % 6 WHEN 0 THEN concat('  References', chr(10), text) WHEN 1 THEN ' page  12 ' WHEN 2 THEN concat('Appendix B ', text) ELSE text END"


@query("useless_filter", f"SELECT doc_id FROM (SELECT doc_id, {FRAMED} AS t FROM documents) q WHERE NOT {any_match('substr(' + stripped('t') + ', 1, 150)', rules.USELESS)}")
def useless_filter(spark, sf_dir):
    i, t = F.col("doc_id") % 6, F.col("text")
    framed = F.when(i == 0, F.concat(F.lit("  References\n"), t)).when(i == 1, " page  12 ").when(i == 2, F.concat(F.lit("Appendix B "), t)).otherwise(t)
    return table(spark, sf_dir, "documents").where(~classify.is_useless(framed)).select("doc_id")


REPLIES = "CASE conv_id % 4 WHEN 0 THEN concat('Sorry, I was unable to find it. ', text) WHEN 1 THEN concat(text, ' There is no direct evidence.') WHEN 2 THEN concat('There is no such evidence ', text) ELSE text END"


@query("refusal_detect", f"SELECT conv_id, turn, {any_match('t', rules.REFUSAL)} AS refused FROM (SELECT conv_id, turn, {REPLIES} AS t FROM conversations) q")
def refusal_detect(spark, sf_dir):
    i, t = F.col("conv_id") % 4, F.col("text")
    said = F.when(i == 0, F.concat(F.lit("Sorry, I was unable to find it. "), t)).when(i == 1, F.concat(t, F.lit(" There is no direct evidence."))).when(i == 2, F.concat(F.lit("There is no such evidence "), t)).otherwise(t)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", classify.is_refusal(said).alias("refused"))


SPOILT = "CASE doc_id % 5 WHEN 0 THEN substr(text, 1, 30) WHEN 1 THEN concat(text, chr(65533)) WHEN 2 THEN concat(text, repeat(chr(1), length(text) // 20)) WHEN 3 THEN concat(substr(text, 1, 700), chr(128512)) ELSE text END"
BAD = r"(length(t) - length(regexp_replace(t, '[\x{10000}-\x{10FFFF}\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')))"


def spoilt():
    i, t = F.col("doc_id") % 5, F.col("text")
    return F.when(i == 0, F.substring(t, 1, 30)).when(i == 1, F.concat(t, F.lit("�"))).when(i == 2, F.concat(t, F.repeat(F.lit("\x01"), F.floor(F.length(t) / 20).cast("int")))).when(i == 3, F.concat(F.substring(t, 1, 700), F.lit("\U0001f600"))).otherwise(t)


@query("quality_flag_pdf", f"SELECT doc_id, CASE WHEN length({stripped('t')}) < 40 THEN 'partial' WHEN {BAD} > length(t) * 0.02 OR contains(t, chr(65533)) THEN 'noisy' ELSE 'clean' END AS flag FROM (SELECT doc_id, {SPOILT} AS t FROM documents) q")
def quality_flag_pdf(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", spoilt().alias("t")).select("doc_id", classify.pdf_quality(F.col("t")).alias("flag"))


@query("quality_flag_web", f"SELECT doc_id, CASE WHEN length(t) < 80 THEN 'too_short' WHEN length(t) > 900 THEN 'too_long' ELSE 'clean' END AS flag FROM (SELECT doc_id, {SPOILT} AS t FROM documents) q")
def quality_flag_web(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", spoilt().alias("t")).select("doc_id", classify.web_quality(F.col("t")).alias("flag"))


@query("quality_flag_batch", f"SELECT doc_id, CASE WHEN length({stripped('t')}) < 40 THEN 'partial' WHEN {BAD} > greatest(length(t), 1) * 0.02 OR contains(t, chr(65533)) THEN 'noisy' WHEN length(t) > 8000 THEN 'uncertain' ELSE 'clean' END AS flag FROM (SELECT doc_id, {SPOILT} AS t FROM documents) q")
def quality_flag_batch(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", spoilt().alias("t")).select("doc_id", classify.batch_quality(F.col("t")).alias("flag"))


TYPED = "CASE doc_id % 8 WHEN 0 THEN concat('| a | b |', chr(10), text) WHEN 1 THEN concat('- one', chr(10), '- two', chr(10), '- three', chr(10), '- four', text) WHEN 2 THEN concat('Figure 3 ', text) WHEN 3 THEN concat(text, ' see Fig. 12') WHEN 4 THEN concat('A journal ', text) WHEN 5 THEN concat('This program ', text) WHEN 6 THEN concat('Appendix: forum ', text) ELSE text END"
ENDS = "(length(t) - length(replace(t, chr(10), '')))"
TABLE_SQL, LIST_SQL = r"regexp_matches(t, '(?m)^\s*\|.*\|')", r"regexp_matches(t, '(?m)^\s*[-•*]\s')"


def typed():
    i, t = F.col("doc_id") % 8, F.col("text")
    return F.when(i == 0, F.concat(F.lit("| a | b |\n"), t)).when(i == 1, F.concat(F.lit("- one\n- two\n- three\n- four"), t)).when(i == 2, F.concat(F.lit("Figure 3 "), t)).when(i == 3, F.concat(t, F.lit(" see Fig. 12"))).when(i == 4, F.concat(F.lit("A journal "), t)).when(i == 5, F.concat(F.lit("This program "), t)).when(i == 6, F.concat(F.lit("Appendix: forum "), t)).otherwise(t)


@query(
    "chunk_type_pdf",
    f"""SELECT doc_id, CASE WHEN b = 'table' THEN 'table' WHEN b = 'figure' THEN 'figure_caption' WHEN {TABLE_SQL} THEN 'table' WHEN {LIST_SQL} AND {ENDS} >= 2 THEN 'list'
WHEN contains(substr(lower(t), 1, 100), 'figure') OR regexp_matches(lower(t), '\\bfig\\.?\\s+[0-9]') THEN 'figure_caption' ELSE 'paragraph' END AS kind FROM (SELECT doc_id, CASE doc_id % 11 WHEN 0 THEN 'table' WHEN 1 THEN 'figure' ELSE 'body' END AS b, {TYPED} AS t FROM documents) q""",
)
def chunk_type_pdf(spark, sf_dir):
    block = F.when(F.col("doc_id") % 11 == 0, "table").when(F.col("doc_id") % 11 == 1, "figure").otherwise("body")
    return table(spark, sf_dir, "documents").select("doc_id", classify.pdf_chunk_type(typed(), block).alias("kind"))


def any_contained(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


@query(
    "chunk_type_web",
    f"""SELECT doc_id, CASE WHEN {any_contained("l", rules.WEB_BIOGRAPHY)} THEN 'biography' WHEN {any_contained("l", rules.WEB_PUBLICATION)} THEN 'publication_list' WHEN s = 'person_profile' THEN 'person_profile' WHEN s = 'institute_presentation' THEN 'presentation_slide'
WHEN {any_contained("l", rules.WEB_PROJECT)} THEN 'project_description' WHEN {any_contained("l", rules.WEB_EVENT)} THEN 'event_info' ELSE 'paragraph' END AS kind FROM (SELECT doc_id, CASE doc_id % 13 WHEN 0 THEN 'person_profile' WHEN 1 THEN 'institute_presentation' ELSE 'page' END AS s, lower(substr({TYPED}, 1, 200)) AS l FROM documents) q""",
)
def chunk_type_web(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 13 == 0, "person_profile").when(F.col("doc_id") % 13 == 1, "institute_presentation").otherwise("page")
    return table(spark, sf_dir, "documents").select("doc_id", classify.web_chunk_type(typed(), kind).alias("kind"))


@query(
    "chunk_type_batch",
    f"""SELECT doc_id, CASE WHEN {TABLE_SQL} OR contains(substr(t, 1, 500), chr(9)) THEN 'table' WHEN contains(lower(t), 'figure') OR contains(lower(t), 'fig.') OR contains(substr(t, 1, 80), '图') THEN 'figure_caption' WHEN {LIST_SQL} AND {ENDS} > 2 THEN 'list'
WHEN contains(lower(t), 'appendix') THEN 'appendix' WHEN doc_id % 7 = 0 THEN 'mixed' ELSE 'paragraph' END AS kind FROM (SELECT doc_id, {TYPED} AS t FROM documents) q""",
)
def chunk_type_batch(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", classify.batch_chunk_type(typed(), F.when(F.col("doc_id") % 7 == 0, "academic_method").otherwise("other")).alias("kind"))


@query("needs_context", f"SELECT doc_id, length(t) < 120 OR (NOT contains(t, '.') AND length(t) < 200) AS needs FROM (SELECT doc_id, {stripped('replace(text, chr(46), CASE WHEN doc_id % 2 = 0 THEN chr(46) ELSE chr(32) END)')} AS t FROM documents) q")
def needs_context(spark, sf_dir):
    t = F.replace(F.col("text"), F.lit("."), F.when(F.col("doc_id") % 2 == 0, ".").otherwise(" "))
    return table(spark, sf_dir, "documents").select("doc_id", classify.needs_context(t).alias("needs"))


@query("page_risks", f"SELECT doc_id, length({stripped('text')}) AS n_chars FROM documents WHERE length({stripped('text')}) < 400")
def page_risks(spark, sf_dir):
    n = F.length(classify.strip(F.col("text")))
    return table(spark, sf_dir, "documents").where(n < 400).select("doc_id", n.cast("long").alias("n_chars"))


@query(
    "llm_triage",
    f"""SELECT doc_id, length(text) > 4500 OR length(text) >= 3500 OR t = '' OR contains(t, 'untitled') OR regexp_matches(t, '^(section|part)\\s*[0-9]+$') OR (length(x) - length(replace(x, concat(chr(10), chr(10)), ''))) / 2 > 25 OR (length(x) - length(replace(x, '- ', ''))) / 2 > 40 OR doc_id % 31 = 0 AS llm
FROM (SELECT doc_id, text, CASE WHEN doc_id % 9 = 0 THEN replace(text, ' ', concat(chr(10), chr(10))) WHEN doc_id % 9 = 1 THEN replace(text, ' ', '- ') ELSE text END AS x, CASE doc_id % 12 WHEN 0 THEN '' WHEN 1 THEN 'section 4' WHEN 2 THEN 'untitled' ELSE source END AS t FROM documents) q""",
)
def llm_triage(spark, sf_dir):
    i, t = F.col("doc_id"), F.col("text")
    content = F.when(i % 9 == 0, F.replace(t, F.lit(" "), F.lit("\n\n"))).when(i % 9 == 1, F.replace(t, F.lit(" "), F.lit("- "))).otherwise(t)
    title = F.when(i % 12 == 0, "  ").when(i % 12 == 1, "Section 4").when(i % 12 == 2, "Untitled").otherwise(F.col("source"))
    long = F.length(t)
    wants = (long > 4500) | (long >= 3500) | classify.is_generic_title(title, ["untitled"]) | classify.is_noisy(content) | (i % 31 == 0)
    return table(spark, sf_dir, "documents").select("doc_id", wants.alias("llm"))


@query(
    "grounding_ratio",
    """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(concat(text, CASE WHEN doc_id % 3 = 0 THEN ' zzyzx quux' ELSE '' END)), '[a-z0-9]+')) AS w FROM documents), n AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL),
k AS (SELECT DISTINCT doc_id, w, true AS held FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) q)
SELECT n.doc_id, sum(n)::BIGINT AS n_words, sum(CASE WHEN held THEN n ELSE 0 END) / sum(n) AS ratio FROM n LEFT JOIN k ON n.doc_id = k.doc_id AND n.w = k.w GROUP BY n.doc_id""",
)
def grounding_ratio(spark, sf_dir):
    seg = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " zzyzx quux").otherwise(""))
    words = F.size(F.regexp_extract_all(F.lower(seg), F.lit("[a-z0-9]+"), F.lit(0)))
    return table(spark, sf_dir, "documents").select("doc_id", words.cast("long").alias("n_words"), classify.grounding(seg, F.col("text")).alias("ratio")).where("n_words > 0")


WRAPPED = """CASE item_id % 3 WHEN 0 THEN concat('```json', chr(10), '{"unit": ', item_id::VARCHAR, ', "ok": true}', chr(10), '```') WHEN 1 THEN concat('Sure: {"unit": ', item_id::VARCHAR, '} ', text) ELSE text END"""


@query("json_extract", f"SELECT item_id, CASE WHEN contains(t, '{{') THEN (regexp_extract(regexp_extract(t, '(?s)\\{{.*\\}}', 0), '\"unit\": ([0-9]+)', 1))::BIGINT END AS unit FROM (SELECT item_id, {WRAPPED} AS t FROM benchmark) q")
def json_extract(spark, sf_dir):
    i = F.col("item_id")
    reply = F.when(i % 3 == 0, F.concat(F.lit('```json\n{"unit": '), i.cast("string"), F.lit(', "ok": true}\n```'))).when(i % 3 == 1, F.concat(F.lit('Sure: {"unit": '), i.cast("string"), F.lit("} "), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.from_json(classify.json_part(reply), "unit long, ok boolean")["unit"].alias("unit"))


@query("content_type_default", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'academic_overview' ELSE 'other' END AS content_type FROM documents")
def content_type_default(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 3 == 0, "scholarly_paper_pdf").otherwise("website_page")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(kind == "scholarly_paper_pdf", "academic_overview").otherwise("other").alias("content_type"))


@query("segment_validate")
def segment_validate(spark, sf_dir):
    """Replies whose unit is the asked one and whose indices are unique."""
    i = F.col("item_id")
    indices = F.when(i % 4 == 0, F.array(F.lit(0), F.lit(1), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    return table(spark, sf_dir, "benchmark").select("item_id", (classify.unique_indices(indices) & (i % 5 != 0)).alias("valid"))


LINES = "VALUES ('7. Conclusions'), ('2020. This Report'), ('NEW THINGS NOW'), ('DEC 2021'), ('About'), ('plain words here'), ('4.1.2. Black Letters'), ('1. Department of It'), ('2.1 Table of it'), ('x')"


@query(
    "heading_detect",
    f"""WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), l AS (SELECT col0 AS line FROM ({LINES}) v UNION ALL SELECT line FROM d UNION ALL SELECT concat((doc_id % 9 + 1)::VARCHAR, '. ', line) FROM d),
s AS (SELECT {stripped("line")} AS s FROM l), m AS (SELECT s, regexp_extract(s, '^([0-9]+(?:\\.[0-9]+)*)\\.?\\s+([A-Z][A-Za-z,\\s:&/''–\\-]{{3,80}})$', 1) AS num, {stripped("regexp_extract(s, '^([0-9]+(?:" + chr(92) + ".[0-9]+)*)" + chr(92) + ".?" + chr(92) + "s+([A-Z][A-Za-z," + chr(92) + "s:&/''–" + chr(92) + "-]{3,80})$', 2)")} AS label FROM s),
h AS (SELECT s, CASE WHEN length(s) NOT BETWEEN 3 AND 100 THEN NULL WHEN num <> '' THEN CASE WHEN regexp_matches(num, '^(19|20)[0-9][0-9]$') OR regexp_matches(label, '^(Department|School|University|Institute|Faculty)') OR length(label) < 5 OR regexp_matches(lower(label), '^(table|figure|fig\\.)') THEN NULL ELSE label END
WHEN regexp_matches(s, '\\p{{Lu}}') AND NOT regexp_matches(s, '\\p{{Ll}}') AND contains(s, ' ') AND length(s) <= 60 AND len(string_split_regex(s, '\\s+')) BETWEEN 2 AND 6 THEN CASE WHEN regexp_matches(s, '^(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Z]*\\s+[0-9]{{4}}$') THEN NULL ELSE 'capitals' END
WHEN lower(s) IN ({", ".join(repr(h) for h in rules.HEADINGS)}) THEN s END AS heading FROM m)
SELECT s AS line, heading, count(*) AS n FROM h WHERE heading IS NOT NULL GROUP BY s, heading""",
)
def heading_detect(spark, sf_dir):
    fixed = spark.createDataFrame([(x,) for x in ("7. Conclusions", "2020. This Report", "NEW THINGS NOW", "DEC 2021", "About", "plain words here", "4.1.2. Black Letters", "1. Department of It", "2.1 Table of it", "x")], "line string")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(F.split("text", "\n")).alias("line"))
    lines = fixed.union(docs.select("line")).union(docs.select(F.concat((F.col("doc_id") % 9 + 1).cast("string"), F.lit(". "), "line")))
    s = classify.strip(F.col("line"))
    found = lines.select(s.alias("line"), classify.heading(F.col("line")).alias("heading")).where("heading is not null")
    shown = F.when(~F.col("line").rlike(r"\p{Ll}"), "capitals").otherwise(F.col("heading"))
    return found.select("line", shown.alias("heading")).groupBy("line", "heading").agg(F.count("*").alias("n"))


REFS = "concat(CASE WHEN doc_id % 3 = 0 THEN concat('[CrossRef]', chr(10), 'doi.org/1', chr(10), '1.', chr(10), '2.', chr(10), '3.', chr(10), 'ISBN 9', chr(10), '[PubMed] x', chr(10)) ELSE 'doi.org' END, text)"
SIGNAL = r"(?im)\[CrossRef\]|\[PubMed\]|doi\.org|Available\s+online:?\s+http|ISBN\s+[0-9]|Accessed\s+on\s+[0-9]|^\s*[0-9]+\.\s*$"


@query(
    "ref_only_page",
    f"""SELECT doc_id, len(regexp_extract_all(t, '{SIGNAL}')) >= 6 AND len(list_filter(l, lambda x: regexp_matches(x, '{SIGNAL}'))) > 0.5 * len(l) AS refs
FROM (SELECT doc_id, t, list_filter(list_transform(string_split(t, chr(10)), lambda x: {stripped("x")}), lambda x: x <> '') AS l FROM (SELECT doc_id, {REFS} AS t FROM documents) q) q""",
)
def ref_only_page(spark, sf_dir):
    t = F.concat(F.when(F.col("doc_id") % 3 == 0, "[CrossRef]\ndoi.org/1\n1.\n2.\n3.\nISBN 9\n[PubMed] x\n").otherwise("doi.org"), "text")
    return table(spark, sf_dir, "documents").select("doc_id", classify.is_reference_page(t).alias("refs"))


@query(
    "drop_ref_chunks",
    """SELECT doc_id FROM (SELECT doc_id, concat(CASE doc_id % 4 WHEN 0 THEN concat('1. Smith, ', chr(10), 'doi.org') WHEN 1 THEN 'Climate. 2020, 12 [CrossRef]' ELSE '' END, text) AS t FROM documents) q
WHERE NOT (length(t) <= 600 AND regexp_matches(t, '\\[CrossRef\\]|\\[PubMed\\]|doi\\.org') AND (regexp_matches(t, '(?m)^\\s*[0-9]+\\.\\s+[A-Z][a-z]+,') OR regexp_matches(t, '\\b[A-Z][a-z]+\\.\\s+[0-9]{4},\\s+[0-9]+')))""",
)
def drop_ref_chunks(spark, sf_dir):
    i = F.col("doc_id")
    head = F.when(i % 4 == 0, "1. Smith, \ndoi.org").when(i % 4 == 1, "Climate. 2020, 12 [CrossRef]").otherwise("")
    t = F.concat(head, F.col("text"))
    return table(spark, sf_dir, "documents").where(~classify.looks_like_reference(t, F.lit("paragraph"))).select("doc_id")


@query("doc_kind_kw", f"WITH {NOISY} SELECT doc_id, CASE WHEN {any_contained('lower(plain)', ['report', 'thand', 'ción', 'heit'])} THEN 'institute_report' ELSE 'scholarly_paper' END AS kind FROM noisy")
def doc_kind_kw(spark, sf_dir):
    return noisy(spark, sf_dir).select("doc_id", F.when(classify.any_word(F.lower("plain"), ["report", "thand", "ción", "heit"]), "institute_report").otherwise("scholarly_paper").alias("kind"))
