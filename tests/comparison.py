"""Rows in a form that two engines' results can be compared in."""

from __future__ import annotations

import datetime
import os
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, Decimal):
        return round(float(value), 6)
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(rows) -> list[tuple]:
    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


def oracle_rows(sql: str, sf_dir: str, columns: list[str]) -> list[tuple]:
    import duckdb

    con = duckdb.connect(config={"threads": 4})
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    names = ", ".join(f'"{c}"' for c in columns)
    return rows_of(con.execute(f"SELECT {names} FROM ({sql}) q").fetchall())
