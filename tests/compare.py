"""Run a report in Spark and in DuckDB and compare names, types, rows and values."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def _key(row):
    return tuple((v is not None, str(type(v)), v) for v in row)


def spark_rows(df):
    names = sorted(df.columns)
    rows = [tuple(_plain(r[n]) for n in names) for r in df.collect()]
    return names, sorted(rows, key=_key)


def duck_rows(con, query):
    result = con.sql(query)
    order = sorted(result.columns)
    places = [result.columns.index(n) for n in order]
    rows = [tuple(_plain(r[i]) for i in places) for r in result.fetchall()]
    return order, sorted(rows, key=_key), dict(zip(result.columns, map(str, result.types)))


# Spark type name to DuckDB type name.
TYPES = {
    "string": "VARCHAR",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
}


def differences(df, con, query) -> list[str]:
    """What differs between a Spark result and a DuckDB query; empty when nothing does."""
    names, mine = spark_rows(df)
    order, theirs, types = duck_rows(con, query)
    if names != order:
        return [f"columns {names} against {order}"]
    found = [
        f"type of {f.name}: {f.dataType.simpleString()} against {types[f.name]}"
        for f in df.schema.fields
        if TYPES.get(f.dataType.simpleString()) != types[f.name]
    ]
    if len(mine) != len(theirs):
        found.append(f"{len(mine)} rows against {len(theirs)}")
    for a, b in zip(mine, theirs):
        if a != b:
            found.append(f"{names}: {a} against {b}")
            break
    return found
