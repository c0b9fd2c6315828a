"""Blocks and chunks of paged documents against plain loops."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import classify, rules, text
from lodestone.operators import layout, sentences
from lodestone.plans import layout_queries

SIGNAL = re.compile(rules.REFERENCE_SIGNALS.replace("(?im)", ""), re.I | re.M)
TABLE, FIGURE = (re.compile(p.replace("(?i)", ""), re.I) for p in (rules.TABLE_LABEL, rules.FIGURE_LABEL))
WHITE = " \t\n\x0b\f\r"


def heading(s):
    """(number, label) of a heading line."""
    if not 3 <= len(s) <= 100:
        return None
    if m := re.match(rules.NUMBERED_HEADING, s):
        number, label = m[1], m[2].strip(WHITE)
        wrong = re.match(r"(19|20)\d\d$", number) or re.match("Department|School|University|Institute|Faculty", label) or len(label) < 5 or re.match(r"table|figure|fig\.", label.lower())
        return None if wrong else (number, label)
    if s.isupper() and " " in s and len(s) <= 60 and 2 <= len(s.split()) <= 6:
        return None if re.match(r"(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)\w*\s+\d{4}$", s) else ("", s.title())
    return ("", s) if s.lower() in rules.HEADINGS else None


def only_references(page):
    lines = [x for x in (y.strip(WHITE) for y in page.split("\n")) if x]
    return len(SIGNAL.findall(page)) >= 6 and sum(bool(SIGNAL.search(x)) for x in lines) > len(lines) / 2


def begins(lines, i):
    if i + 1 >= len(lines):
        return False
    s = lines[i].strip(WHITE)
    if (m := re.match(rules.ENTRY_NUMBER, s)) and re.match(rules.ENTRY_AUTHOR, lines[i + 1].strip(WHITE)):
        return bool(SIGNAL.search("\n".join(lines[i : i + 5]))) or int(m[1]) <= 3
    return bool(re.match(rules.ENTRY_LINE, s) and SIGNAL.search(s))


def plain_blocks(pages):
    """(kind, number, heading, first page, last page, body) in order; pages is [(number, text)]."""
    content = [p for p in pages if not only_references(p[1])] or pages[:1]
    flat = []
    for page, body in content:
        lines = body.split("\n")
        end = next((i for i in range(len(lines)) if begins(lines, i)), None)
        flat += [(page, x) for x in lines[:end]]
        if end is not None:
            break
    parts, now = [], ["preamble", "0", "Preamble", []]
    for page, line in flat:
        s = line.strip(WHITE)
        if m := TABLE.match(s):
            mark = ("table", m[1], f"Table {m[1]}. {m[2].strip(WHITE)[:80] or 'Untitled'}")
        elif m := FIGURE.match(s):
            mark = ("figure", m[1], f"Figure {m[1]}. {m[2].strip(WHITE)[:80] or 'Untitled'}")
        elif h := heading(s):
            mark = ("section", h[0], f"{h[0]}. {h[1]}" if h[0] else h[1])
        else:
            now[3].append((page, line, True))
            continue
        parts.append(now)
        now = [*mark, [(page, line, False)]]
    out = []
    for kind, number, label, lines in [*parts, now]:
        body = "\n".join(x for _, x, own in lines if own).strip(WHITE)
        if len(body) > (30 if kind == "preamble" else 14):
            out.append((kind, number, label, lines[0][0], lines[-1][0], body))
    if out or not flat:
        return out
    for page in dict.fromkeys(p for p, _ in flat):
        body = "\n".join(x for p, x in flat if p == page).strip(WHITE)
        if len(body) > 30:
            out.append(("body", "", f"Page {page}", page, page, body))
    return out or [("body", "0", "Document", flat[0][0], flat[-1][0], "\n".join(x for _, x in flat).strip(WHITE))]


def plain_chunks(blocks, split, flags):
    """Chunks by loops; split and flags are the tested parts for sentences and for kinds."""
    made = []

    def packed(body, overlap):
        s, i = split(body), 0
        while i < len(s):
            j, size = i, 0
            while j < len(s) and j - i < 5 and (j == i or size + 1 + len(s[j]) <= 700):
                size += len(s[j]) + (j > i)
                j += 1
            yield " ".join(s[i:j]).strip(WHITE)
            if j >= len(s):
                return
            i = max(i + 1, j - overlap)

    for kind, _, label, first, last, body in blocks:
        chunk = lambda t, k, e=None: made.append([label, first, last, t, e or t, k])  # noqa: E731, B023
        if kind == "preamble":
            lines = [x for x in (y.strip(WHITE) for y in body.split("\n")) if len(x) >= 5 and not any(re.search(p, x) for p in rules.PREAMBLE_SKIP)]
            short = " ".join(x for i, x in enumerate(lines) if not i or x != lines[i - 1])
            if len(short) >= 30:
                for t in packed(short, 0):
                    chunk(t, "metadata")
        elif kind == "table":
            rows = [x for x in (y.strip(WHITE) for y in body.split("\n")) if x]
            groups, n = [[]], 0
            for r in rows:
                if groups[-1] and n + len(r) + 1 > 700:
                    groups.append([])
                    n = 0
                groups[-1].append(r)
                n += len(r) + 1
            whole = len("\n".join(rows)) <= 700
            for t in ["\n".join(rows)] if whole else ["\n".join(g) for g in groups]:
                if whole or len(t) >= 20:
                    chunk(t, "table", f"{label}\n{t}")
        elif kind == "figure" and len(body) <= 700:
            chunk(body, "figure_caption", f"{label}\n{body}")
        else:
            for i, t in enumerate(packed(body, 1 if kind == "figure" else 2)):
                chunk(t, None, f"{label}\n{t}" if kind == "figure" and not i else None)
    for c, (kind, reference) in zip(made, flags([(c[3], c[5]) for c in made])):
        c[5] = None if reference else kind
    out = []
    for c in (c for c in made if c[5]):
        if out and out[-1][0] == c[0] and len(c[3]) < 120:
            out[-1] = [c[0], out[-1][1], max(out[-1][2], c[2]), f"{out[-1][3]} {c[3]}", f"{out[-1][3]} {c[3]}", out[-1][5]]
        else:
            out.append(c)
    changed = True
    while changed:
        changed, rest = False, []
        for c in out:
            if len(c[3]) < 200 and rest and len(rest[-1][3]) + len(c[3]) + 1 <= 900:
                p = rest[-1]
                rest[-1] = [p[0], p[1], max(p[2], c[2]), f"{p[3]} {c[3]}", f"{p[3]} {c[3]}", p[5]]
                changed = True
            else:
                rest.append(c)
        out = rest
    if len(out) > 1 and len(out[0][3]) < 200:
        a, b = out[:2]
        out[:2] = [[b[0], min(a[1], b[1]), b[2], f"{a[3]} {b[3]}", f"{a[3]} {b[3]}", b[5]]]
    return [tuple(c) for c in out]


CASES = {
    1: ["Some words of a paper\nby someone or other here\nTable 2. Numbers\na 1\nb 2\nc 3\nd 4 and so on\n3. Results of it\nText. More text of some length here.", "goes on here\n1.\nSmith, J. Things\nnot read"],
    2: ["short"],
    3: ["no marker at all but a text of some length on the page", "tiny", "another page without any marker that is long enough"],
    4: [layout_queries.REFERENCES, "SUMMARY OF WORK\nbody of the summary in a few words"],
    5: [layout_queries.REFERENCES],
    6: ["", "Fig. 7.\n" + "A caption that is long. " * 60 + "\nAbout\nx"],
    7: ["Table 1. " + "t" * 100 + "\n" + "\n".join(f"row {i} " + "v" * 60 for i in range(30))],
    8: ["1. Introduction\nfirst part of the text here\nReferences\n2. Smith, A. B. 2020 doi.org\nlast"],
    9: [None, "words on the second page that are enough"],
}


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(d, i + 1, t) for d, ts in CASES.items() for i, t in enumerate(ts)], "doc_id long, page long, text string").repartition(3)


def held(frame, key="doc_id"):
    out = {}
    for r in frame.select(key, "page", "text").orderBy(key, "page").collect():
        if r["text"] is not None:
            out.setdefault(r[key], []).append((r["page"], r["text"]))
    return out


def compare_blocks(frame, want):
    got = {}
    for r in layout.blocks(frame).orderBy("doc_id", "place").collect():
        got.setdefault(r["doc_id"], []).append((r["kind"], r["number"], r["heading"], r["page_start"], r["page_end"], r["body"]))
    assert got == {d: plain_blocks(ps) for d, ps in want.items() if plain_blocks(ps)}


def test_blocks_of_hard_cases(pages):
    want = held(pages)
    compare_blocks(pages, want)
    kinds = {b[0] for ps in want.values() for b in plain_blocks(ps)}
    assert kinds == {"preamble", "table", "figure", "section", "body"}
    assert plain_blocks(want[5])[0][2] != "Document" or plain_blocks(want[2])[0][2] == "Document"


def test_chunks_are_the_loops(spark, sf_dir, pages):
    def split(body):
        return spark.createDataFrame([(body,)], "t string").select(sentences.split_sentences(F.col("t"), sentences.PDF)).first()[0]

    def flags(rows):
        if not rows:
            return []
        frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, k string").withColumn("k", F.coalesce("k", classify.pdf_chunk_type(F.col("t"), F.lit("body"))))
        return [(r["k"], r["x"]) for r in frame.select("i", "k", classify.looks_like_reference(F.col("t"), F.col("k")).alias("x")).orderBy("i").collect()]

    few = layout_queries.laid(spark, sf_dir).where("doc_id < 12")
    for frame in (pages, few):
        got = {}
        for r in layout.chunks(frame).orderBy("doc_id", "chunk_index").collect():
            got.setdefault(r["doc_id"], []).append((r["section_title"], r["page_start"], r["page_end"], r["chunk_text"], r["embedding_text"], r["chunk_type"]))
        want = {d: plain_chunks(plain_blocks(ps), split, flags) for d, ps in held(frame).items()}
        assert got == {d: c for d, c in want.items() if c}


def test_no_pages(spark):
    none = spark.createDataFrame([], "doc_id long, page long, text string")
    assert layout.blocks(none).count() == 0 and layout.chunks(none).count() == 0


def test_condensing_leaves_nothing_of_blanks(spark):
    assert spark.createDataFrame([("\n \n",)], "t string").select(text.condense_preamble(F.col("t"))).first()[0] == ""
