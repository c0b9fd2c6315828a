"""Many patterns at once against a loop over them."""

from __future__ import annotations

import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import patterns

LETTERS = st.text("abé ", max_size=6)


@settings(max_examples=6, deadline=None, phases=[Phase.generate])
@given(texts=st.lists(st.text("abé ", max_size=40), min_size=3, max_size=12), words=st.lists(LETTERS, min_size=3, max_size=30))
@pytest.mark.parametrize("most", [1 << 20, 12])
def test_every_pattern_is_found_where_it_first_begins(spark, texts, words, most):
    rows = spark.createDataFrame([(i, "kept", t) for i, t in enumerate([*texts, None])], "i int, other string, t string")
    found = patterns.occurrences(rows.select("i", "other", "t"), F.col("t"), spark.createDataFrame([(w,) for w in [*words, None]], "pattern string"), most_letters=most)
    got = sorted((r["i"], r["pattern"], r["at"]) for r in found.collect())
    assert got == sorted((i, w, t.find(w)) for i, t in enumerate(texts) for w in set(words) if w and w in t)


def test_no_patterns(spark):
    rows = spark.createDataFrame([(1, "a")], "i int, t string")
    assert patterns.occurrences(rows, F.col("t"), spark.createDataFrame([], "pattern string")).count() == 0


def test_finds_of_a_batch_are_held_in_pieces(spark, monkeypatch):
    """A batch's texts and finds are never held whole, and a column that is not kept is not repeated for each find."""
    rows = spark.range(1000).selectExpr("id", "concat('ab', repeat('c', 500)) AS t").coalesce(1)
    words = spark.createDataFrame([("a",), ("b",), ("ab",)], "pattern string")
    found = patterns.occurrences(rows, F.col("t"), words, keep=["id"])
    assert found.columns == ["id", "pattern", "at"]
    sizes = found.mapInArrow(lambda batches: (b.select([0]) for b in batches), "id long")
    assert sizes.count() == 3000 and found.where("pattern = 'b'").agg(F.sum("at")).first()[0] == 1000


def test_pieces_hold_all_rows_in_order():
    import pyarrow as pa

    from lodestone.functions.batches import pieces

    batch = pa.record_batch({"a": list(range(7))})
    none = pa.record_batch({"a": pa.array([], pa.int64())})
    assert [p.num_rows for p in pieces([batch, none, batch], 3)] == [3, 3, 1, 0, 3, 3, 1]
    assert [x for p in pieces([batch], 3) for x in p.column(0).to_pylist()] == list(range(7))
