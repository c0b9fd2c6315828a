"""Links against the standard library's rules, and crawls against a queue."""

from __future__ import annotations

from collections import deque
from urllib.parse import urldefrag, urljoin

from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.sources import web

BASES = st.sampled_from(["http://a.org", "https://a.org/", "http://a.org/x/y", "http://a.org/x/y/?q=1#f", "https://b.org:8080/p/q/r.html"])
PARTS = st.lists(st.sampled_from(["a", "b.html", ".", "..", "c-d"]), min_size=1, max_size=5).map("/".join)
#: Whole addresses without dots, which the library leaves as they are.
PLAIN = st.lists(st.sampled_from(["a", "b.html", "c-d"]), min_size=1, max_size=3).map("/".join)
TARGETS = st.one_of(PARTS, PARTS.map("/{}".format), PLAIN.map("//h.net/{}".format), PLAIN.map("https://o.org/{}".format), st.builds("{}?x={}#f".format, PARTS, PARTS), st.sampled_from(["?q=2", "a/", "../", "http://o.org", "x#y", "/"]))


@settings(max_examples=8, deadline=None, phases=[Phase.generate])
@given(st.lists(st.tuples(BASES, TARGETS), min_size=20, max_size=60))
def test_addresses_are_those_of_the_standard(spark, pairs):
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, base string, target string")
    got = {r["i"]: r["u"] for r in frame.select("i", web.resolved(F.col("base"), F.col("target")).alias("u")).collect()}
    assert got == {i: urldefrag(urljoin(base, target))[0] for i, (base, target) in enumerate(pairs)}


def test_links_that_lead_nowhere(spark):
    frame = spark.createDataFrame([(x,) for x in ("", "#top", "mailto:a@b", "JavaScript:void(0)", "tel:1", None)], "t string")
    assert [r[0] for r in frame.select(web.resolved(F.lit("http://a.org/"), F.col("t"))).collect()] == [None] * 6


def test_links_of_a_page(spark):
    html = "<A class=x HREF='/a?x=1&amp;y=2'>1</A><a href=b>2</a><a\nhref = \"http://a.org/c#d\">3</a><a data-href='no' title='href=none'>4</a><abbr href='z'>5</abbr><a href='http://z.org/'>6</a>"
    rows = web.site_links(spark.createDataFrame([("http://a.org/in/", html)], "url string, html string"), "http://a.org/").collect()
    assert {r["target"] for r in rows} == {"http://a.org/a?x=1&y=2", "http://a.org/in/b", "http://a.org/c"}


def test_crawls_go_one_way_to_any_depth(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(12)] + [("n3", "n0"), ("back", "n0"), ("n2", "far"), ("n0", "far"), ("n5", "n5")]
    depth, queue = {"n0": 0}, deque(["n0"])
    while queue:
        u = queue.popleft()
        for a, b in edges:
            if a == u and b not in depth:
                depth[b] = depth[u] + 1
                queue.append(b)
    found = web.reachable(spark.createDataFrame([("n0",), ("n0",), (None,)], "url string"), spark.createDataFrame(edges, "url string, target string"))
    assert sorted((r["url"], r["depth"]) for r in found.collect()) == sorted(depth.items())


def test_no_start(spark):
    none = spark.createDataFrame([], "url string")
    assert web.reachable(none, spark.createDataFrame([("a", "b")], "url string, target string")).count() == 0
