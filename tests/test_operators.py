"""Operators against hand-worked cases and plain restatements."""

from __future__ import annotations

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import classify, rules, text
from lodestone.operators import evaluation, models, retrieval, sections, sentences, sessions
from lodestone.sources import web


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def test_merge_broken_lines(spark):
    merged = one(spark, "A first li-\nne goes\non here.\nNext line\n\n# Head\nbody", text.merge_broken_lines)
    assert merged == "A first line goes on here.\nNext line\n\n# Head body"


def test_drop_repeated_lines(spark):
    assert one(spark, "a\nb\na \nc\n a\n\n\n", text.drop_repeated_lines) == "b\nc\n\n\n"


def test_web_sentences_take_in_short_open_ones(spark):
    assert one(spark, "Short; And more here. Then", sentences.split_web_sentences) == ["Short;", "And more here.", "Then"]


def packed(lengths: list[int], most: int, chars: int, overlap: int, skip: bool) -> list[list[int]]:
    """A plain loop over sentence numbers."""
    out, i, n = [], 0, len(lengths)
    while i < n:
        j, size = i, 0
        while j < n and j - i < most and (j == i or size + 1 + lengths[j] <= chars):
            size += lengths[j] + (j > i)
            j += 1
        out.append(list(range(i, j)))
        if j >= n:
            break
        back = j - overlap
        i = (j if back <= i else back) if skip else max(i + 1, back)
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.integers(1, 60), max_size=14), min_size=1, max_size=8), st.integers(1, 5), st.integers(0, 3), st.booleans())
def test_packing_is_the_plain_loop(spark, cases, most, overlap, skip):
    rows = [(i, ["x" * n for n in case]) for i, case in enumerate(cases)]
    found = spark.createDataFrame(rows, "i int, s array<string>").select("i", F.transform(sentences.pack(F.col("s"), most, 70, overlap, skip), lambda g: F.transform(g, F.length)).alias("g"))
    for r in found.collect():
        case = cases[r["i"]]
        assert r["g"] == [[case[k] for k in g] for g in packed(case, most, 70, min(overlap, most - 1), skip)]


def test_merge_small_moves_a_tiny_first_chunk_on(spark):
    chunks = [("a", "x" * 50), ("b", "y" * 300), ("b", "z" * 30), ("c", "w" * 150)]
    frame = spark.createDataFrame([(chunks,)], "c array<struct<section:string,text:string>>")
    found = frame.select(sentences.merge_small(F.col("c"), small=120)).first()[0]
    assert [(r["section"], len(r["text"])) for r in found] == [("b", 50 + 1 + 300 + 1 + 30 + 1 + 150)]


def test_sections_leave_out_titles_without_body(spark):
    frame = spark.createDataFrame([(1, "intro\nONE\nTWO\nbody\n")], "d int, text string")
    found = sections.by_heading(frame, "d", lambda x: x.rlike("^[A-Z]+$")).orderBy("i").collect()
    assert [(r["title"], r["body"], r["start"]) for r in found] == [(None, "intro", 0), ("TWO", "body", 14)]


def test_long_texts_merge_in_time(spark):
    """A hundred thousand lines are one walk."""
    line = "some words of a line"
    found = one(spark, "\n".join([line, "", *[line] * 100_000]), text.merge_broken_lines)
    assert found.startswith(f"{line}\n\n{line} {line}") and found.count(line) == 100_001


def test_headings(spark):
    cases = {"7. Conclusions": "Conclusions", "2020. This Report": None, "1. Department of X": None, "NEW THINGS": "New Things", "DEC 2021": None, "about": "about", "some words": None, "": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", classify.heading(F.col("t")).alias("h")).collect()
    assert {r["t"]: r["h"] for r in rows} == cases


def merged_evidence(intent, raw, positive, negative):
    """The loop over lists, with ids by score."""
    gate = intent == "no_evidence" and negative and (max(raw.values()) if raw else 0) < rules.NEGATIVE_GATE
    order = sorted(raw, key=lambda k: (-raw[k], k))
    final = order[:3]
    for k in sorted(positive, key=lambda k: (-positive[k], k))[: 1 if intent in rules.ONE_QA_INTENTS else 2]:
        if len(final) < 5:
            final.append(k)
    if gate and len(final) < 5:
        final.append(min(negative, key=lambda k: (-negative[k], k)))
    final += [k for k in order[3:]][: 5 - len(final)]
    return [k for k in final if k not in raw] + [k for k in order if k in final]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["no_evidence", "topic_specific", "synthesis"]), *[st.lists(st.integers(0, 9), max_size=7)] * 3), min_size=1, max_size=6))
def test_evidence_is_the_loop(spark, cases):
    raws, pos, neg, asked, want = [], [], [], [], {}
    for q, (intent, r, p, n) in enumerate(cases):
        named = [{f"{k}{i}": x / 10 for i, x in enumerate(v)} for k, v in (("r", r), ("p", p), ("n", n))]
        for out, d in zip((raws, pos, neg), named):
            out += [(q, k, x) for k, x in d.items()]
        asked.append((q, intent))
        want[q] = merged_evidence(intent, *named)
    frames = [spark.createDataFrame(rows, f"query_id int, chunk_id string, {c} double") for rows, c in ((raws, "final"), (pos, "final"), (neg, "raw_score"))]
    found = retrieval.evidence(*frames, spark.createDataFrame(asked, "query_id int, intent string")).orderBy("query_id", "rank").collect()
    for q in want:
        assert [r["chunk_id"] for r in found if r["query_id"] == q] == want[q]


def test_diversity_refills_only_to_five(spark):
    rows = [(1, f"c{i}", "a" if i < 6 else "b", i) for i in range(7)] + [(2, f"d{i}", f"s{i % 3}", i) for i in range(6)]
    found = retrieval.diversify(spark.createDataFrame(rows, "query_id int, chunk_id string, source string, rank int")).orderBy("query_id", "rank").collect()
    assert [r["chunk_id"] for r in found if r["query_id"] == 1] == ["c0", "c1", "c6", "c2", "c3"]
    assert len([r for r in found if r["query_id"] == 2]) == 6


def test_an_empty_source_matches_every_gold_id(spark):
    found = spark.createDataFrame([(1, 1, ""), (2, 1, "x"), (2, 4, "the GOLD file")], "query_id int, rank int, source string")
    gold = spark.createDataFrame([(1, "g"), (2, "gold"), (3, "z")], "query_id int, gold_id string")
    assert {tuple(r) for r in evaluation.retrieval_hits(found, gold).collect()} == {(1, True, True), (2, True, True), (3, False, False)}


def test_idle_limit_is_exclusive(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [("a", t, 1), ("a", t + datetime.timedelta(seconds=3600), 2), ("a", t + datetime.timedelta(seconds=7201), 3)]
    found = sessions.sessions(spark.createDataFrame(rows, "k string, at timestamp, i int"), "k", "at", "i").orderBy("session").collect()
    assert [r["n"] for r in found] == [2, 1]


def test_eleventh_turn_pushes_out_the_first(spark):
    turns = spark.createDataFrame([("s", i) for i in range(11)], "s string, turn int")
    assert sorted(r["turn"] for r in sessions.last_turns(turns, "s", "turn").collect()) == list(range(1, 11))


def test_at_most_two_hundred_sessions(spark):
    events = spark.range(201).select("id", (F.col("id") * 10).alias("at"))
    assert sorted(r["id"] for r in sessions.most_recent(events, "id", "at").collect()) == list(range(1, 201))


def test_unreadable_replies_have_defaults(spark):
    frame = spark.createDataFrame([("{no",), ('{"is_consistent": false, "confidence": 0.9}',)], "t string")
    assert [tuple(r[0]) for r in frame.select(models.consistency(F.col("t"))).collect()] == [(True, 0.0), (False, 0.9)]
    assert set(frame.select(models.judged(F.col("t"))).first()[0]) == {-1}


def test_model_sees_only_unknown_rows(spark):
    seen = spark.sparkContext.accumulator(0)

    class Counting:
        def complete(self, prompts):
            seen.add(len(prompts))
            return ["m"] * len(prompts)

    frame = spark.createDataFrame([("a", "k"), ("b", None)], "p string, known string")
    assert sorted(r["x"] for r in models.with_fallback(frame, F.col("p"), F.col("known"), "x", Counting).collect()) == ["k", "m"]
    assert seen.value == 1


def test_url_lists(spark, tmp_path):
    (tmp_path / "B.txt").write_text("# no\nhttps://x.org/a\nsee https://x.org/b).\n")
    (tmp_path / "a.list").write_text("https://x.org/b\n\nplain\n")
    (tmp_path / "c.csv").write_text("https://x.org/c\n")
    assert sorted(map(tuple, web.read_url_lists(spark, str(tmp_path)).collect())) == [("https://x.org/a", "B.txt"), ("https://x.org/b", "a.list")]


@pytest.mark.parametrize("empty", ["documents", "pages"])
def test_columns_on_empty_tables(spark, sf_dir, empty):
    none = spark.read.parquet(f"{sf_dir}/{empty}.parquet").limit(0)
    if empty == "pages":
        assert web.sections(none).count() == 0
    else:
        assert none.select(text.clean_text(F.col("text"))).count() == 0


def test_supplements_by_sets_of_entities(spark):
    """As from all pairs of queries and chunks, with chunks that other entities of the query take or that it holds already."""
    missing = spark.createDataFrame([(q, e) for q in range(7) for i, e in enumerate("abc") if (q + 1) >> i & 1], "query_id long, entity string")
    scored = spark.createDataFrame([(e, c, float((c * 7 + ord(e)) % 11)) for e in "abc" for c in range(40) if (c + ord(e)) % 3], "entity string, chunk_id long, score double")
    held = spark.createDataFrame([(q, c) for q in range(7) for c in range(q, 40, 9)], "query_id long, chunk_id long")
    want = retrieval.supplements(missing.join(scored, "entity").select("query_id", "entity", "chunk_id", "score"), held)
    got = retrieval.supplements_of_all(missing, scored, held)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_candidates_leave_texts_behind(spark):
    scored = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0), (1, 3, 0.5)], "query_id long, chunk_id long, score double")
    corpus = spark.createDataFrame([(1, "s", "References"), (2, "s", "what it is"), (3, "s", None)], "chunk_id long, source string, text string")
    found = retrieval.candidates(scored, corpus, 3)
    assert "text" not in found.columns and [r["chunk_id"] for r in found.collect()] == [2]


def test_lines_are_merged_in_pieces_of_a_batch(spark):
    """Rows keep their order, nulls stay, and more rows than a piece holds come through."""
    rows = spark.range(1001).selectExpr("id", "CASE WHEN id % 7 <> 0 THEN concat('a ', id, '\n', 'on') END AS t").coalesce(1)
    found = rows.select("id", text.merge_broken_lines(F.col("t")).alias("t"))
    assert all(r["t"] == (f"a {r['id']} on" if r["id"] % 7 else None) for r in found.collect())
    import pyarrow as pa

    assert max(len(x) for x in text.paragraphs_of(iter([pa.array(["a\nb"] * 1001)]))) <= 200
