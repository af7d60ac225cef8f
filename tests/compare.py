"""Compare a Spark result with the rows of its SQL: names, number of rows, and values."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda at: names[at])
    picked = [tuple(_plain(row[at]) for at in order) for row in rows]
    return [names[at] for at in order], sorted(picked, key=repr)


def difference(df, connection, sql: str) -> str | None:
    found_names, found = _rows(df.columns, [tuple(row) for row in df.collect()])
    cursor = connection.execute(sql)
    names, wanted = _rows([column[0] for column in cursor.description], cursor.fetchall())
    if found_names != names:
        return f"columns {found_names}, wanted {names}"
    if len(found) != len(wanted):
        return f"{len(found)} rows, wanted {len(wanted)}: {found[:3]!r:.600} / {wanted[:3]!r:.600}"
    for one, other in zip(found, wanted, strict=True):
        if one != other:
            return f"found  {one!r:.1500}\nwanted {other!r:.1500}"
    return None
