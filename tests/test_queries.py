"""Every query against its SQL, or its rows where there is none."""

from __future__ import annotations

import pytest

from lodestone.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(name, same_as_sql):
    assert same_as_sql(name) > 0


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_has_rows(name, spark, sf_dir):
    frame = catalog.QUERIES[name](spark, sf_dir)
    assert len(set(frame.columns)) == len(frame.columns)
    assert frame.count() > 0
