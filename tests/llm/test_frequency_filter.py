"""Scores of a language model against plain dictionaries."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import frequency_filter as lm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), " "]


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def level(c):
    return sum(c >= math.ceil(1.5**j) and (j == 0 or math.ceil(1.5**j) > math.ceil(1.5 ** (j - 1))) for j in range(100)) if c else 0


def plain(rows, order=2, prior=64.0):
    """Base and model scores from dictionaries; counts stand for the middle of their level."""
    grams = [Counter() for _ in range(order)]
    for i, text in rows:
        if not held_out(i):
            ts = tokens(text)
            for n in range(order):
                grams[n].update(zip(*(ts[k:] for k in range(n + 1))))
    total, types = sum(grams[0].values()), len(grams[0])
    lows = sorted({math.ceil(1.5**j) for j in range(90)})
    middle = {c: (lows[level(c) - 1] + lows[level(c)] - 1) / 2 for c in {x for g in grams for x in g.values()}} | {0: 0.0}
    out = []
    for i, text in rows:
        ts, base, score = tokens(text), 0.0, 0.0
        for at, t in enumerate(ts):
            base += math.log10((grams[0][(t,)] + 1) / (total + types + 1))
            p = (middle[grams[0][(t,)]] + 1) / (total + types + 1)
            for n in range(1, order):
                if at >= n:
                    gram = tuple(ts[at - n : at + 1])
                    c, h = middle[grams[n][gram]], middle[grams[n - 1][gram[:-1]]]
                    p = (c + prior * p) / (max(c, h) + prior)
            score += math.log10(p)
        out.append((i, held_out(i), len(ts), sum(grams[0][(t,)] > 0 for t in ts), total, base, score))
    return out


def compare(found, rows, near=0.03, **more):
    """All exact but the model's score, which a few false members of the filter may raise."""
    key = lambda r: (str(r[0]), r[2], r[5])
    got, want = sorted(map(tuple, found.collect()), key=key), sorted(plain(rows, **more), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want])
    assert all(abs(g[6] - w[6]) <= near * abs(w[6]) + 0.5 for g, w in zip(got, want)), [(g, w) for g, w in zip(got, want) if abs(g[6] - w[6]) > near * abs(w[6]) + 0.5][:3]
    assert sum(abs(g[6] - w[6]) for g, w in zip(got, want)) <= 0.01 * sum(abs(w[6]) for w in want) + 0.5


def rows_of(hard_rows):
    return [(r[0], r[1]) for r in hard_rows]


def test_hard_cases_by_broadcast_and_by_join(spark, hard, hard_rows, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 3000)
    wide = lm.lm_score(hard)
    compare(wide, rows_of(hard_rows))
    monkeypatch.setattr(lm, "GROUP_BYTES", 20_000)
    monkeypatch.setattr(lm, "PIECE_BYTES", 50_000)
    monkeypatch.setattr(lm, "LOOKED", 1)
    monkeypatch.setattr(lm, "PART_BYTES", 30_000)
    joined = lm.lm_score(hard, max_filter_bytes=0)
    key = lambda r: (str(r[0]), r[2], r[5])
    for a, b in zip(sorted(wide.collect(), key=key), sorted(joined.collect(), key=key)):
        assert tuple(a) == pytest.approx(tuple(b), abs=1e-9, nan_ok=True) if a[0] is not None else tuple(a)[1:] == pytest.approx(tuple(b)[1:])


def test_words_that_are_joined(spark, hard, hard_rows, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 20)
    compare(lm.lm_score(hard, order=3), rows_of(hard_rows), order=3)


def test_small_table(spark, sf_dir):
    from lodestone.llm import queries

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    compare(queries.op11_frequency_filter(spark, sf_dir), [tuple(r) for r in docs.collect()])


def test_nothing_and_nothing_learned(spark, none):
    assert lm.lm_score(none).count() == 0
    kept = next(i for i in range(100) if held_out(i))
    only = spark.createDataFrame([(kept, "a b")], "doc_id long, text string")
    assert [tuple(r) for r in lm.lm_score(only).collect()] == [(kept, True, 3, 0, 0, 0.0, 0.0)]


def test_carried_columns_and_clashes(hard):
    assert lm.lm_score(hard, carry=["lang"]).columns[:3] == ["doc_id", "held_out", "lang"]
    with pytest.raises(ValueError):
        lm.lm_score(hard.withColumnRenamed("lang", "score"), carry=["score"])


def test_the_model_prefers_text_in_its_order(spark, sf_dir):
    """Held-out texts are likelier than by words alone, and than with their words shuffled."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rng = np.random.default_rng(1)
    mixed = []
    for r in docs:
        ws = (r["text"] or "").split()
        rng.shuffle(ws)
        if held_out(r["doc_id"]) and len(ws) > 20:
            mixed.append((r["doc_id"], True, " ".join(ws)))
            mixed.append((r["doc_id"], False, r["text"]))
    frame = spark.createDataFrame([(r["doc_id"], None, r["text"]) for r in docs if not held_out(r["doc_id"])] + mixed, "doc_id long, mixed boolean, text string")
    found = {(r["doc_id"], r["mixed"]): r for r in lm.lm_score(frame, carry=["mixed"]).collect()}
    kept = {i for i, m in found if m}
    assert len(kept) > 5
    assert sum(found[i, False]["score"] for i in kept) > sum(found[i, True]["score"] for i in kept)
    assert sum(found[i, False]["score"] > found[i, True]["score"] for i in kept) > 0.7 * len(kept)
    assert sum(found[i, False]["score"] for i in kept) > sum(found[i, False]["base_score"] for i in kept)


def test_hashes_do_not_depend_on_place_or_window(monkeypatch):
    texts = ["one Two\x0bthree", None, "", "x" * 5000 + " y", " ", "three TWO one Éé", "  a b"]
    monkeypatch.setattr(lm, "WINDOW", 16)
    t = lm.Tokens(pa.array(["zz", *texts]).slice(1))
    assert t.size.tolist() == [len(tokens(x)) for x in texts]
    flat = [w for x in texts for w in tokens(x)]
    pairs = set(zip(flat, t.a.tolist(), t.b.tolist()))
    assert len(pairs) == len(set(flat)) == len({a for _, a, _ in pairs}) == len({b for _, _, b in pairs})


def test_filter_never_forgets_and_seldom_invents():
    rng = np.random.default_rng(5)
    hashes, n = rng.integers(1 << 63, size=40_000, dtype="u8") * np.uint64(2) + np.uint64(1), rng.geometric(0.4, 40_000)
    buckets = 7
    own = lm.bucket_of(hashes, buckets)
    f = lm.Filter(np.arange(buckets), [lm.bucket_bits(hashes[own == b], n[own == b]) for b in range(buckets)], buckets)
    true = np.searchsorted(lm.LOWER, n, "right")
    got = f.levels(hashes)
    assert (got >= true).all() and (got > true).mean() < 0.02
    assert (f.levels(rng.integers(1 << 63, size=40_000, dtype="u8") * np.uint64(2)) > 0).mean() < 0.02


def test_a_joined_piece_is_cut_and_hashed_once(monkeypatch):
    """Where the filter is joined, scoring a piece from its levels makes the tokens of each group of texts once."""
    texts = pa.array(["one two three", None, "two three two", "", "zzz one", "three one two one"])
    order, made = 2, []
    monkeypatch.setattr(lm, "GROUP_BYTES", 20)
    level = lambda hashes: (hashes % np.uint64(5)).astype("u1")
    hashes = lm.distinct_grams([lm.Tokens(texts)], order)
    levels = level(lm.distinct_grams([lm.Tokens(texts.slice(at, end - at)) for at, end in lm.groups(texts)], order))

    class Counted(lm.Tokens):
        def __init__(self, texts):
            made.append(len(texts))
            super().__init__(texts)

    scorer = lm.Scorer(100, 10, tuple(np.zeros(0, k) for k in ("u8", "u8", "i8")), order, 64.0)
    whole = pa.table(scorer.score(texts, lm.Looked(hashes, level(hashes))), scorer.NAMES)
    monkeypatch.setattr(lm, "Tokens", Counted)
    assert scorer.of_piece(texts, levels).combine_chunks().to_pylist() == whole.to_pylist()
    assert sum(made) == len(texts) and len(made) > 1


def test_settings_of_the_join_go_back(spark, hard):
    before = {k: spark.conf.get(k, None) for k in lm.SMALL_BATCHES}
    assert lm.lm_score(hard, max_filter_bytes=0).count() == hard.count()
    assert {k: spark.conf.get(k, None) for k in lm.SMALL_BATCHES} == before


def test_hashes_travel_in_order_and_packed():
    rng = np.random.default_rng(3)
    x = rng.integers(1 << 63, size=5000, dtype="u8") * np.uint64(2)
    for some in (x, x[:1], x[:0], np.array([0, 1 << 63, (1 << 64) - 1], "u8")):
        kept = lm.ascending([some, some[: len(some) // 2]])
        assert kept.tolist() == sorted(set(some.tolist()))
        assert lm.unpacked(lm.packed(kept)).tolist() == kept.tolist()
