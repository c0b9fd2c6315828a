"""Replies of a model to units: what is refused, what is repaired, and what is made without it."""

from __future__ import annotations

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodestone.operators import segmentation

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this module

TEXT = "The first part is here. It has words.\n\nThe second part is there."
SEGMENTS = [{"segment_index": 0, "content": "The first part is here."}, {"segment_index": 1, "content": "The  second part is there."}]


def reply(unit="u", segments=None):
    return json.dumps({"unit_id": unit, "segments": SEGMENTS if segments is None else segments})


@pytest.mark.parametrize(
    ("text", "wrong"),
    [
        (reply(), None), (f"```json\n{reply()}\n```", None), (f"Sure: {reply()} done", None), ("words", "no JSON"), ("{}", "no JSON"), ("{broken", "no JSON"), (reply("v"), "another unit"), (reply(segments=[]), "no segments"),
        (reply(segments=[{"segment_index": 0, "content": "It has words."}] * 2), "twice"), (reply(segments=[{"segment_index": 0}]), "lacks"), (reply(segments=[{"segment_index": 0, "content": "made up by me"}]), "not in the unit"), (reply(segments=[{"segment_index": 0, "content": " "}]), None),
    ],
)
def test_problems(spark, text, wrong):
    row = spark.createDataFrame([(text, TEXT)], "reply string, content string").select(segmentation.problem(F.col("reply"), F.lit("u"), F.col("content")).alias("p")).first()
    assert row["p"] is None if wrong is None else wrong in row["p"]


class Once:
    """Right at the second time of asking."""

    def complete(self, prompts):
        return [reply() if "cannot be used" in p else "no" for p in prompts]


class Never:
    def complete(self, prompts):
        raise RuntimeError("down")


UNIT = "unit_id string, document_type string, source_type string, source string, url string, title string, section string, content string, wanted boolean"


@pytest.mark.parametrize(("make", "route", "n"), [(Once, "repaired", 2), (Never, "fallback", 1)])
def test_routes(spark, make, route, n):
    rows = [("u", "website_page", "web", "s", None, "t", None, TEXT, True), ("w", "scholarly_paper_pdf", "pdf", "s", None, "t", None, f" {TEXT} ", False), ("x", None, None, None, None, None, None, None, None)]
    found = {r["unit_id"]: r for r in segmentation.segment_units(spark.createDataFrame(rows, UNIT), F.col("wanted"), make).collect()}
    assert (found["u"]["route"], len(found["u"]["segments"])) == (route, n)
    assert found["u"]["segments"][0]["metadata"]["source"] == "s" and found["u"]["segments"][0]["content"].startswith("The first part")
    assert found["w"]["route"] == "single" and found["w"]["segments"][0]["content"] == TEXT and found["w"]["segments"][0]["content_type"] == "academic_overview"
    assert found["x"]["route"] == "single" and found["x"]["segments"][0]["content"] == ""


def test_empty_units(spark):
    assert segmentation.segment_units(spark.createDataFrame([], UNIT), F.col("wanted")).count() == 0


class Counting:
    """Replies with how many prompts came at once."""

    def complete(self, prompts):
        return [str(len(prompts))] * len(prompts)


def test_a_model_is_given_few_prompts_at_a_time(spark):
    """What a worker holds of prompts and replies does not grow with the partition."""
    from lodestone.operators import models

    found = spark.range(1001).coalesce(1).select("id", models.complete(F.when(F.col("id") != 5, F.col("id").cast("string")), Counting).alias("n"))
    sizes = [int(r["n"]) for r in found.collect()]
    assert len(sizes) == 1001 and max(sizes) <= models.PROMPTS
