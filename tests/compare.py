"""Runs a registered query and its SQL side by side and reports every difference."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = """region nation customer supplier part orders lineitem events documents embeddings
pages benchmark labels conversations""".split()

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "decimal(38,2)": "DECIMAL(38,2)",
}


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            db.execute(f"create view {name} as select * from read_parquet('{path}')")
    return db


def _key(row: tuple) -> tuple:
    return tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row)


def _plain(v: object) -> object:
    if isinstance(v, float) and not math.isnan(v):
        return v + 0.0  # no negative zero
    return v


def _rows(rows: list, columns: list[str], names: list[str]) -> list[tuple]:
    at = [columns.index(n) for n in names]
    return sorted((tuple(_plain(r[i]) for i in at) for r in rows), key=_key)


def differences(df, db: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty when columns, types, row count and every value agree."""
    relation = db.sql(sql)
    theirs = dict(zip(relation.columns, map(str, relation.types)))
    ours = dict(df.dtypes)
    if sorted(ours) != sorted(theirs):
        return [f"columns {sorted(ours)} <> {sorted(theirs)}"]
    out = [
        f"type of {c}: {t} <> {theirs[c]}" for c, t in ours.items() if TYPES.get(t, t) != theirs[c]
    ]
    names = sorted(ours)
    a = _rows([tuple(r) for r in df.collect()], df.columns, names)
    b = _rows(relation.fetchall(), relation.columns, names)
    if len(a) != len(b):
        out.append(f"rows {len(a)} <> {len(b)}")
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        out.append(f"{len(bad)} of {len(a)} rows differ, first {names}: {bad[0][0]} <> {bad[0][1]}")
    return out
