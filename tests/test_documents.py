"""Cleaning by pages, sections or text."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from lodestone.functions.text import clean_text
from lodestone.operators import documents

PAGES = [(1, p, f"Running head of all\nBody {p} goes on here. \n{p}\nand  ends.") for p in range(1, 8)] + [(2, 1, "one\nRunning head of all"), (2, 2, None), (9, 1, "of no document")]
SECTIONS = [(2, 0, "h", "not used"), (3, 0, None, "first  part\nof it."), (3, 1, "Head", " second "), (3, 2, "Empty", None)]
DOCS = [(1, "no"), (2, "no"), (3, "no"), (4, "A  text\n3\nof lines."), (5, None), (6, "")]


def test_three_routes(spark):
    docs, pages = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(PAGES, "doc_id long, page int, text string")
    sections = spark.createDataFrame(SECTIONS, "doc_id long, i int, heading string, content string")
    texts = [t for *_, t in PAGES + SECTIONS + DOCS if t is not None]
    rows = spark.createDataFrame([(t,) for t in dict.fromkeys(texts)], "t string").select("t", clean_text(F.col("t")).alias("c")).collect()
    clean = {r["t"]: r["c"] for r in rows} | {None: None}
    of_pages = {}
    for d, _, t in PAGES[:-1]:
        of_pages.setdefault(d, []).append(clean[t] or "")
    for d, parts in of_pages.items():
        seen = Counter(x.strip() for p in parts for x in p.split("\n") if 6 <= len(x.strip()) <= 220)
        often = {x for x, n in seen.items() if len(parts) >= 5 and n >= max(3, len(parts) * 35 // 100)}
        of_pages[d] = "\n\n".join("\n".join(x for x in p.split("\n") if x.strip() not in often) for p in parts)
    want = {1: ("pages", of_pages[1]), 2: ("pages", of_pages[2]), 4: ("text", clean[DOCS[3][1]]), 5: ("text", None), 6: ("text", "")}
    want[3] = ("sections", "\n\n".join([clean[SECTIONS[1][3]], f"Head\n{clean[' second ']}", ""]))
    assert {r["doc_id"]: (r["route"], r["text"]) for r in documents.clean_documents(docs, pages, sections).collect()} == want


def test_none(spark):
    none = [spark.createDataFrame([], s) for s in ("doc_id long, text string", "doc_id long, page int, text string", "doc_id long, i int, heading string, content string")]
    assert documents.clean_documents(*none).count() == 0
