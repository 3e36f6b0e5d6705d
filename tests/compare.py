"""Compare a Spark result with the SQL twin's, as multisets of rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, Counter(tuple(_plain(r[n]) for n in names) for r in df.collect())


def sql_rows(db, sql: str):
    result = db.execute(sql)
    columns = [c[0] for c in result.description]
    names = sorted(columns)
    where = [columns.index(n) for n in names]
    return names, Counter(tuple(_plain(r[i]) for i in where) for r in result.fetchall())


def _kind(duck: str) -> str:
    return {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double"}.get(duck, duck)


def sql_types(db, sql: str) -> dict[str, str]:
    return {r[0]: _kind(r[1]) for r in db.execute(f"DESCRIBE {sql}").fetchall()}
