"""Shared fixtures: one local session and a DuckDB comparison."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture
def same_as_sql(spark, sf_dir):
    """Asserts that a registered query returns the rows of its SQL."""

    def check(name: str) -> int:
        import __spark_entry__
        from comparison import oracle_rows, rows_of

        frame = __spark_entry__.queries()[name](spark, sf_dir)
        columns = sorted(frame.columns)
        ours = rows_of(frame.select(*[f"`{c}`" for c in columns]).collect())
        theirs = oracle_rows(__spark_entry__.oracle_sql()[name], sf_dir, columns)
        assert ours == theirs, f"{name}: {len(ours)} and {len(theirs)} rows; first difference {next((p for p in zip(ours, theirs) if p[0] != p[1]), None)}"
        return len(ours)

    return check
