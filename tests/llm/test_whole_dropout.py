"""Dropout is drawn for each occurrence of a word."""

from __future__ import annotations

from lodestone.llm import merge_dropout


def test_each_occurrence_draws_anew(spark):
    text = " ".join(["internationalisation"] * 200)
    rows = merge_dropout.encode_documents(spark.createDataFrame([(i, text) for i in range(20)], "doc_id long, text string")).collect()
    assert len({tuple(r["ids"]) for r in rows}) == 20


def test_chunks_and_batches_change_nothing(monkeypatch):
    coder = merge_dropout.MergeDropout(dropout=0.2)
    texts = [" ".join(["international", "straßenverkehr", "word", "日本x", "a" * 40, "▁x"] * n) for n in (50, 0, 3, 120)]
    found = coder.encode(texts, [7, 8, 9, 10])
    assert [coder.encode([t], [i])[0] for t, i in zip(texts, (7, 8, 9, 10))] == found
    monkeypatch.setattr(merge_dropout, "CHUNK", 64)
    monkeypatch.setattr(merge_dropout, "TABLE", 100)
    assert coder.encode(texts, [7, 8, 9, 10]) == found
    assert [coder.decode(memoryview(c).cast("I")) for c in found] == texts
