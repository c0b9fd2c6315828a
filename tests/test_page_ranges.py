"""Prefix sums by range and joins by bin against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import lines


def pages_of(seed):
    rng = random.Random(seed)
    return [(d, i, "x" * rng.choice([0, 1, 7, 90, 5000])) for d, n in (("hot", 200), ("one", 1), ("few", 5)) for i in rng.sample(range(1000), n)]


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_sums_do_not_depend_on_ranges(spark, parts):
    rows = pages_of(1)
    found = lines.sums_before(spark.createDataFrame(rows, "doc string, i int, text string"), "doc", "i", {"n": F.lit(1), "size": F.length("text")}, parts)
    want = set()
    for doc in ("hot", "one", "few"):
        n = size = 0
        for _, i, text in sorted(r for r in rows if r[0] == doc):
            want.add((doc, i, n, size))
            n, size = n + 1, size + len(text)
    assert {tuple(r) for r in found.collect()} == want


@pytest.mark.parametrize("width", [1, 64, 100_000])
def test_spans_meet_every_page_that_they_touch(spark, width):
    rows = [(d, i, t[:200]) for d, i, t in pages_of(2)]
    ranges = lines.char_ranges(spark.createDataFrame(rows, "doc string, i int, text string"), "doc", "i")
    held = [tuple(r) for r in ranges.select("doc", "page", "start", "end").collect()]
    rng = random.Random(3)
    spans = [(d, n, a, a + rng.choice([0, 1, 50, 900])) for n in range(60) for d in ("hot", "few", "none") for a in [rng.randint(0, 3000)]]
    found = lines.span_pages(spark.createDataFrame(spans, "doc string, span_id int, from long, to long"), ranges, "doc", "page", width)
    want = set()
    for d, n, a, b in spans:
        if touched := [p for doc, p, s, e in held if doc == d and s <= b and e >= a]:
            want.add((d, n, min(touched), max(touched)))
    assert {tuple(r) for r in found.collect()} == want


def test_no_pages(spark):
    none = spark.createDataFrame([], "doc string, i int, text string")
    assert lines.char_ranges(none, "doc", "i").count() == 0
