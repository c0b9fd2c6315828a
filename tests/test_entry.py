"""The driver's contract."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).parent.parent
HIDING = "import sys; sys.modules['lodestone.llm'] = None; sys.modules['corpus_pipeline'] = None; "


def names(before: str = "") -> list[str]:
    code = before + "import __spark_entry__ as e; print(*e.queries()); e.oracle_sql()"
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()


def test_queries_are_listed_without_a_session():
    assert "retrieve_v1" in names()


def test_queries_are_listed_without_the_training_data_operators():
    assert "retrieve_v1" in (found := names(HIDING)) and not any(n.startswith("op") and n[2].isdigit() for n in found)


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.columns[0] == "query_id" and frame.count() > 0
