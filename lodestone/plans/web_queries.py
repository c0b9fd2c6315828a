"""Queries over web pages, addresses and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import ids, rules
from lodestone.functions.text import strip
from lodestone.plans.registry import query, table
from lodestone.plans.text_queries import stripped
from lodestone.sources import page_tree, web

HOST, PATH = r"regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)", r"regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


@query("page_source_key", f"SELECT page_id, concat({HOST}, {PATH}) AS source FROM pages")
def page_source_key(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", web.page_source(F.col("url")).alias("source"))


def sql_noise(c: str, tags: list[str]) -> str:
    for t in tags:
        c = f"regexp_replace({c}, '(?is)<{t}\\b.*?</{t}>', '', 'g')"
    return c


@query("html_strip_noise", f"SELECT page_id, {sql_noise('html', rules.NOISE_TAGS)} AS html FROM pages")
def html_strip_noise(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", web.strip_noise(F.col("html")).alias("html"))


@query("html_title", f"SELECT page_id, nullif({stripped('''regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)''')}, '') AS title FROM pages")
def html_title(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", web.title(F.col("html")).alias("title"))


def sql_without_phrases(c: str) -> str:
    for p in rules.SCRAPE_NOISE:
        c = f"replace({c}, '{p}', '')"
    return c


@query("scrape_clean_text", f"SELECT page_id, {stripped('regexp_replace(' + sql_without_phrases('regexp_replace(' + sql_noise('html', [*rules.NOISE_TAGS, 'iframe', 'svg']) + ''', '(?s)<[^>]*>', chr(10), 'g')''') + ''', '\\n{3,}', concat(chr(10), chr(10)), 'g')''')} AS text FROM pages")
def scrape_clean_text(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", web.scrape_text(F.col("html")).alias("text"))


@query("html_sections")
def html_sections(spark, sf_dir):
    return web.sections(pages(spark, sf_dir))


@query("html_main_text")
def html_main_text(spark, sf_dir):
    """Title and text of every page, from the element that holds its content."""
    return page_tree.contents(pages(spark, sf_dir)).select("page_id", "title", "text")


@query("web_chunk_pipeline")
def web_chunk_pipeline(spark, sf_dir):
    """Sections of pages to sentences, overlapping chunks, small ones merged, with ids and flags."""
    from lodestone.functions import classify
    from lodestone.operators import sentences

    found = web.sections(pages(spark, sf_dir)).select("page_id", "i", F.coalesce("heading", F.lit("")).alias("section"), "content")
    packed = found.select("page_id", "i", F.transform(sentences.joined(sentences.pack(sentences.split_web_sentences(F.col("content")), overlap=rules.OVERLAP_SENTENCES)), lambda x: F.struct(F.col("section").alias("section"), x.alias("text"))).alias("c"))
    whole = packed.groupBy("page_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"])).alias("c"))
    merged = whole.select("page_id", F.posexplode(sentences.merge_small(F.col("c"), small=200, base_title=True, forward=False)).alias("i", "c"))
    body = F.col("c.text")
    return merged.select("page_id", F.col("i").cast("long").alias("chunk_index"), ids.web_chunk_id(F.concat(F.lit("web_"), F.col("page_id").cast("string")), F.col("i")).alias("chunk_id"), F.col("c.section").alias("section_title"), body.alias("chunk_text"), classify.web_quality(body).alias("quality_flag"), classify.web_chunk_type(body, F.lit("page")).alias("chunk_type"))


@query("url_slug", "SELECT page_id, substr(CASE WHEN s = '' THEN 'index' ELSE s END, 1, 80) AS slug FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, 'https?://[^/]+/', '', 'g'), '/+$', ''), '[^a-zA-Z0-9_-]', '_', 'g') AS s FROM pages) q")
def url_slug(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", ids.url_slug(F.col("url")).alias("slug"))


@query("safe_filename", f"SELECT page_id, concat(regexp_replace(substr(concat(replace({HOST}, '.', '_'), '_', CASE WHEN p = '' THEN 'index' ELSE p END), 1, 120), '[^\\w\\-_.]', '_', 'g'), '__', substr(sha256(url), 1, 10), '.txt') AS name FROM (SELECT page_id, url, replace(regexp_replace({PATH}, '^/+|/+$', '', 'g'), '/', '_') AS p FROM pages) q")
def safe_filename(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", ids.safe_filename(F.col("url")).alias("name"))


HREFS = """regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"#]*)', 1)"""


@query("page_links", f"SELECT page_id, unnest({HREFS}) AS target, generate_subscripts({HREFS}, 1) - 1 AS i FROM pages")
def page_links(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.posexplode(web.links(F.col("html"))).alias("i", "target")).withColumn("i", F.col("i").cast("long"))


#: Pages called by number on one site; every link of the table leads, in one of six forms, to the page of the number that its letters give.
GOES = "(SELECT count(*) FROM pages)"
NUMBERED = f"""l AS (SELECT page_id, unnest({HREFS}) AS h, generate_subscripts({HREFS}, 1) - 1 AS i FROM pages), k AS (SELECT page_id, i, (ascii(substr(h, 2, 1)) * 31 + length(h) * 7 + page_id * 3) % {GOES} AS goes FROM l),
e AS (SELECT DISTINCT concat('https://www.site.org/in/p', page_id::VARCHAR) AS url, concat('https://www.site.org/in/p', goes::VARCHAR) AS target FROM k WHERE i % 6 < 4)"""


def numbered_pages(spark, sf_dir):
    """(url, html) of the made site."""
    all_ = pages(spark, sf_dir)
    n = F.broadcast(all_.agg(F.count("*").alias("n")))
    h = F.regexp_extract_all("html", F.lit("(?i)<a\\s[^>]*href=\"([^\"#]*)"), F.lit(1))
    rows = all_.select("page_id", F.posexplode(h).alias("i", "h")).crossJoin(n)
    to = ((F.ascii(F.substring("h", 2, 1)) * 31 + F.length("h") * 7 + F.col("page_id") * 3) % F.col("n")).cast("string")
    forms = [("href=\"/in/p", "\""), ("class=x href='p", "#top'"), ("href=\"../x/../in/./p", "\""), ("HREF=//www.site.org/in/p", " id=a"), ("href=\"https://other.org/in/p", "\""), ("href=\"mailto:p", "\"")]
    link = F.lit("")
    for k, (before, after) in enumerate(forms):
        link = F.when(F.col("i") % 6 == k, F.concat(F.lit(f"<a {before}"), to, F.lit(f"{after}>x</a>"))).otherwise(link)
    html = rows.groupBy("page_id").agg(F.array_join(F.collect_list(link), "\n").alias("html"))
    return html.select(F.concat(F.lit("https://www.site.org/in/p"), F.col("page_id").cast("string")).alias("url"), "html")


@query("site_links", f"WITH {NUMBERED} SELECT url, target FROM e")
def site_links(spark, sf_dir):
    """Links within the site, resolved."""
    return web.site_links(numbered_pages(spark, sf_dir), "https://www.site.org/in/")


@query(
    "crawl_reachable",
    f"WITH RECURSIVE {NUMBERED}, r AS (SELECT 'https://www.site.org/in/p0' AS url, 0 AS depth UNION SELECT e.target, depth + 1 FROM r JOIN e USING (url) WHERE depth < (SELECT 2 * count(*) FROM pages)) SELECT url, min(depth) AS depth FROM r GROUP BY url",
)
def crawl_reachable(spark, sf_dir):
    """What a crawl from the first page of the site finds along its links, with the depth."""
    return web.reachable(spark.createDataFrame([("https://www.site.org/in/p0",)], "url string"), web.site_links(numbered_pages(spark, sf_dir), "https://www.site.org/in/"))


LISTED = "CASE page_id % 5 WHEN 0 THEN concat('  ', url, ' ') WHEN 1 THEN concat('# ', url) WHEN 2 THEN concat('see ', url, ').') WHEN 3 THEN ' ' ELSE 'nothing here' END"


def listed():
    i, u = F.col("page_id") % 5, F.col("url")
    return F.when(i == 0, F.concat(F.lit("  "), u, F.lit(" "))).when(i == 1, F.concat(F.lit("# "), u)).when(i == 2, F.concat(F.lit("see "), u, F.lit(")."))).when(i == 3, " ").otherwise("nothing here")


FOUND = "regexp_replace(regexp_extract(x, '(?i)https?://[^\\s#]+', 0), '[.,);\\]\"'']+$', '')"


@query("url_line_parse", f"SELECT page_id, CASE WHEN x = '' OR starts_with(x, '#') THEN NULL WHEN regexp_matches(x, '^https?://') THEN x WHEN regexp_matches({FOUND}, '^https?://') THEN {FOUND} END AS url FROM (SELECT page_id, {stripped(LISTED)} AS x FROM pages) q")
def url_line_parse(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", web.parse_url_line(listed()).alias("url"))


@query("url_dedup_first_seen", f"WITH h AS (SELECT page_id, {HOST} AS host, url FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS n FROM h) SELECT page_id, host FROM r WHERE n = 1")
def url_dedup_first_seen(spark, sf_dir):
    return web.first_seen(pages(spark, sf_dir).select("page_id", web.host(F.col("url")).alias("host")), "host", "page_id")


@query("page_manifest", "SELECT count(*) AS pages, count(*) FILTER (contains(lower(substr(html, 1, 2000)), '<html') OR starts_with(lower(ltrim(html)), '<!doctype')) AS ok, sum(length(html))::BIGINT AS chars FROM pages")
def page_manifest(spark, sf_dir):
    ok = web.looks_like_html(F.lit(None).cast("string"), F.col("html"))
    return pages(spark, sf_dir).agg(F.count("*").alias("pages"), F.count_if(ok).alias("ok"), F.sum(F.length("html")).alias("chars"))


@query("url_audit", "SELECT page_id, s < 400 AS ok, CASE WHEN page_id % 4 = 0 AND s IN (202, 403) AND length(html) < 5000 THEN 'blocked download' END AS note FROM (SELECT page_id, html, CASE page_id % 3 WHEN 0 THEN 200 WHEN 1 THEN 403 ELSE 202 END AS s FROM pages) q")
def url_audit(spark, sf_dir):
    i = F.col("page_id")
    status = F.when(i % 3 == 0, 200).when(i % 3 == 1, 403).otherwise(202)
    url = F.when(i % 4 == 0, F.concat("url", F.lit("/viewcontent.cgi"))).otherwise(F.col("url"))
    found = web.audit(status, F.length("html"), url)
    return pages(spark, sf_dir).select("page_id", found["ok"].alias("ok"), found["note"].alias("note"))


@query("link_gap_check", "WITH s AS (SELECT url FROM pages WHERE page_id % 3 <> 0), l AS (SELECT url FROM pages WHERE page_id % 5 <> 0) SELECT 'missing' AS kind, url FROM (SELECT url FROM l EXCEPT SELECT url FROM s) UNION ALL SELECT 'known', url FROM (SELECT url FROM s UNION SELECT url FROM l)")
def link_gap_check(spark, sf_dir):
    saved, live = pages(spark, sf_dir).where("page_id % 3 <> 0").select("url"), pages(spark, sf_dir).where("page_id % 5 <> 0").select("url")
    gone, known = live.subtract(saved), saved.union(live).distinct()
    return gone.select(F.lit("missing").alias("kind"), "url").union(known.select(F.lit("known"), "url"))


@query("link_query_param", "SELECT page_id, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page FROM pages WHERE contains(url, 'page=')")
def link_query_param(spark, sf_dir):
    return pages(spark, sf_dir).where(F.col("url").contains("page=")).select("page_id", F.regexp_extract("url", r"[?&]page=([^&#]*)", 1).alias("page"))


@query("page_meta_extract")
def page_meta_extract(spark, sf_dir):
    """Title from meta tags, else the title element, else the first heading; language; the first year in the text."""
    html = F.col("html")
    meta = F.regexp_extract(html, r'(?i)<meta[^>]*name="citation_title"[^>]*content="([^"]*)"', 1)
    heading = strip(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"<[^>]*>", ""))
    title = F.coalesce(F.nullif(meta, F.lit("")), web.title(html), F.nullif(heading, F.lit("")))
    return pages(spark, sf_dir).select("page_id", title.alias("title"), F.regexp_extract(html, r'(?i)<html[^>]*lang="([^"]*)"', 1).alias("lang"), F.nullif(F.regexp_extract(html, r"\b((?:19|20)\d{2})\b", 1), F.lit("")).alias("year"))


@query("pdf_link_pick")
def pdf_link_pick(spark, sf_dir):
    """A download address by the first of four strategies that finds one."""
    html = F.col("html")
    ways = [r'(?i)<meta[^>]*name="citation_pdf_url"[^>]*content="([^"]*)"', r'(?i)href="([^"]*viewcontent\.cgi[^"]*)"', r'(?i)href="([^"]*\.pdf)"', r'(?i)href="([^"]*download[^"]*)"']
    return pages(spark, sf_dir).select("page_id", F.coalesce(*[F.nullif(F.regexp_extract(html, w, 1), F.lit("")) for w in ways]).alias("pdf"))


@query("stop_after_misses", "WITH m AS (SELECT doc_id % 10 AS k, doc_id, (doc_id * 7919) % 11 < 6 AS miss FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS i, sum(miss::INT) OVER (PARTITION BY k ORDER BY doc_id ROWS 2 PRECEDING) = 3 AS hit FROM m), e AS (SELECT *, coalesce(bool_or(hit) OVER (PARTITION BY k ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM r) SELECT k, doc_id FROM e WHERE NOT ended AND i <= 50")
def stop_after_misses(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 10).alias("k"), "doc_id")
    return web.stop_after_misses(rows, "k", "doc_id", (F.col("doc_id") * 7919) % 11 < 6, run=3)


@query("metadata_index", "SELECT lang AS folder, count(*) AS n, count(*) FILTER (doc_id % 4 = 0) AS with_pdf, sum(length(coalesce(CASE WHEN doc_id % 9 = 0 THEN NULL ELSE text END, '')))::BIGINT AS chars FROM documents GROUP BY lang")
def metadata_index(spark, sf_dir):
    text = F.coalesce(F.when(F.col("doc_id") % 9 != 0, F.col("text")), F.lit(""))
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("folder")).agg(F.count("*").alias("n"), F.count_if(F.col("doc_id") % 4 == 0).alias("with_pdf"), F.sum(F.length(text)).alias("chars"))
