"""A crawl follows links to any depth."""

from __future__ import annotations

from lodestone.functions.storage import ensure_checkpoint_dir
from lodestone.sources import web


def test_pages_deeper_than_fifty_links(spark):
    ensure_checkpoint_dir(spark)
    edges = spark.createDataFrame([(i, i + 1) for i in range(54)] + [(54, 0)], "url long, target long").coalesce(1)
    found = web.reachable(spark.createDataFrame([(0,)], "url long"), edges).collect()
    assert {r["url"]: r["depth"] for r in found} == {i: i for i in range(55)}
