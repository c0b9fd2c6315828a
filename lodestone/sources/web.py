"""Web pages as data: titles, sections, links, URL lists and records of fetches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions.storage import ensure_checkpoint_dir, written
from lodestone.functions.text import ascii_edges, strip
from lodestone.sources import page_tree


def title(html: Column) -> Column:
    """The text of the title element; null without one."""
    found = strip(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(found != "", found)


def strip_noise(html: Column, tags: list[str] = rules.NOISE_TAGS) -> Column:
    """html without the elements of such tags, from opening to next closing tag."""
    for tag in tags:
        html = F.regexp_replace(html, ascii_edges(rf"(?is)<{tag}\b.*?</{tag}>"), "")
    return html


def scrape_text(html: Column, phrases: list[str] = rules.SCRAPE_NOISE) -> Column:
    """Text of a page: noise elements and tags out, fixed phrases out, at most one blank line in a row."""
    text = F.regexp_replace(strip_noise(html, [*rules.NOISE_TAGS, "iframe", "svg"]), r"(?s)<[^>]*>", "\n")
    for p in phrases:
        text = F.replace(text, F.lit(p), F.lit(""))
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def links(html: Column) -> Column:
    """Targets of all anchors in order, without fragments."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*href="([^"#]*)"""), F.lit(1)), lambda x: x)


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1)


def page_source(url: Column) -> Column:
    """Host and path, as pages are called."""
    return F.concat(host(url), F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1))


def parse_url_line(line: Column) -> Column:
    """The address on a line of a list; null for blank lines, comments and lines without one."""
    x = strip(line)
    found = F.regexp_replace(F.regexp_extract(x, r"(?i)https?://[^\s#]+", 0), r"[.,);\]\"']+$", "")
    return F.when((x == "") | x.startswith("#"), F.lit(None).cast("string")).when(x.rlike("^https?://"), x).when(found.rlike("^https?://"), found)


def first_seen(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key, the first in order; ties beyond the order are rows that are alike."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def looks_like_html(content_type: Column, html: Column) -> Column:
    start = F.lower(F.substring(F.ltrim(html), 1, 2000))
    return F.coalesce(F.lower(content_type).contains("html"), F.lit(False)) | start.contains("<html") | start.startswith("<!doctype")


def audit(status: Column, size: Column, url: Column) -> Column:
    """struct<ok, note> of a fetch: blocked downloads are told apart from failures."""
    blocked = url.contains("viewcontent.cgi") & status.isin(202, 403) & (size < 5000)
    return F.struct((status < 400).alias("ok"), F.when(blocked, "blocked download").alias("note"))


def without_dots(path: Column) -> Column:
    """A path without its segments . and .., which take the one before with them."""
    segments = F.split(path, "/")
    tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))

    def step(done: Column, x: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(x == ".", done).when(x == "..", up).otherwise(F.array_append(done, x))

    return F.array_join(F.concat(F.aggregate(segments, F.array().cast("array<string>"), step), tail), "/")


def resolved(base: Column, target: Column) -> Column:
    """The address that a link on a page means, without its fragment; null for links to other schemes than http and https, and for those to a place on the page.

    Targets are whole addresses, or begin with //host, /path or ?query, or are paths from the folder of the page.
    """
    t = F.regexp_replace(strip(target), "#.*$", "")
    page = F.regexp_replace(base, "[?#].*$", "")
    scheme, root = F.regexp_extract(page, "^([a-z]+:)//", 1), F.regexp_extract(page, "^[a-z]+://[^/]*", 0)
    path = F.substring(page, F.length(root) + 1, F.length(page))
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", "")
    joined = (
        F.when(t == "", F.lit(None).cast("string"))
        .when(t.rlike("(?i)^https?://"), t)
        .when(t.rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(t.startswith("//"), F.concat(scheme, t))
        .when(t.startswith("/"), F.concat(root, t))
        .when(t.startswith("?"), F.concat(page, t))
        .otherwise(F.concat(root, folder, t))
    )
    site, rest = F.regexp_extract(joined, "(?i)^https?://[^/?]*", 0), F.regexp_extract(joined, "(?i)^https?://[^/?]*(.*)$", 1)
    way, asked = F.regexp_extract(rest, "^[^?]*", 0), F.regexp_extract(rest, "[?].*$", 0)
    return F.when(joined.isNotNull(), F.concat(site, F.when(way == "", way).otherwise(without_dots(way)), asked))


def site_links(pages: DataFrame, within: str, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, target), each once: the links of pages that lead to addresses with this beginning."""
    hrefs = F.regexp_extract_all(html_col, F.lit(HREF), F.lit(1))
    targets = F.transform(hrefs, lambda x: F.regexp_replace(x, "&amp;", "&"))
    found = pages.select(F.col(url_col).alias("url"), F.explode(targets).alias("href")).select("url", resolved(F.col("url"), F.regexp_replace("href", "^[\"']|[\"']$", "")).alias("target"))
    return found.where(F.col("target").startswith(within)).distinct()


#: The value of href in an anchor, with its quotes if any.
HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def reachable(start: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages that a crawl from start (url) finds along edges (url, target), each once with its depth; breadth first, until no page is new.

    Edges are written once; each level is written beside those before it and never again, and what it finds is new if no level has it.
    """
    spark, edge = start.sparkSession, written(edges.select("url", "target").distinct(), "edges")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/crawl-{uuid.uuid4().hex}"
    start.select("url").where("url is not null").distinct().write.parquet(f"{path}/depth=0")
    depth, kind = 0, f"url {dict(start.dtypes)['url']}"
    while not (front := spark.read.schema(kind).parquet(f"{path}/depth={depth}")).isEmpty():
        seen = spark.read.schema(f"{kind}, depth int").parquet(path).select("url")
        depth += 1
        front.join(edge, "url").select(F.col("target").alias("url")).distinct().join(seen, "url", "left_anti").write.parquet(f"{path}/depth={depth}")
    return spark.read.schema(f"{kind}, depth int").parquet(path)


def stop_after_misses(df: DataFrame, key: str, number: str, missed: Column, run: int = 5, most: int = 50) -> DataFrame:
    """Rows up to the end of the first run of so many misses in a row, and at most so many a key."""
    w = Window.partitionBy(key).orderBy(number)
    marked = df.withColumn("_i", F.row_number().over(w)).withColumn("_miss", missed.cast("int"))
    full = F.sum("_miss").over(w.rowsBetween(-(run - 1), 0)) == run
    ended = F.max(F.when(full, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return marked.withColumn("_ended", F.coalesce(ended, F.lit(0))).where((F.col("_ended") == 0) & (F.col("_i") <= most)).drop("_i", "_miss", "_ended")


def sections(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, i, level, heading, content), one row a section."""
    found = page_tree.contents(pages, id_col, html_col)
    return found.select("page_id", F.posexplode("sections").alias("i", "s")).select("page_id", F.col("i").cast("long").alias("i"), "s.level", "s.heading", "s.content")


def read_url_lists(spark, path: str, recursive: bool = False) -> DataFrame:
    """(url, file) of the lists in a folder (*.txt, *.url, *.list), each address as first seen, files in order of their names whatever the case."""
    lines = spark.read.option("pathGlobFilter", "*.{txt,url,list}").option("recursiveFileLookup", str(recursive).lower()).text(path)
    named = lines.select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("n"))
    found = named.select(parse_url_line(F.col("value")).alias("url"), "file", "n").where("url is not null").withColumn("order", F.lower("file"))
    return first_seen(found, "url", "order", "file", "n").select("url", "file")
