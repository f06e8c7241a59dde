"""Run a registered query and its SQL twin and compare the whole results."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    if hasattr(value, "asDict"):
        return tuple((k, plain(v)) for k, v in value.asDict().items())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def kind(t: str) -> str:
    t = t.lower()
    for k, v in {"bigint": "int", "int": "int", "integer": "int", "smallint": "int", "tinyint": "int", "double": "float",
                 "float": "float", "varchar": "string", "string": "string", "boolean": "bool", "timestamp_ntz": "ts",
                 "timestamp": "ts", "date": "date"}.items():
        if t == k:
            return v
    return t


def compare(spark, con, sf_dir, fn, sql):
    """Empty string when equal, else what differs first."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    mine = {n: kind(t) for n, t in df.dtypes}
    theirs = {n: kind(str(t)) for n, t in zip(rel.columns, rel.types)}
    bad = {n: (mine[n], theirs[n]) for n in mine
           if mine[n] != theirs[n] and not mine[n].startswith(("array", "struct", "map"))}
    if bad:
        return f"types {bad}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2] if len(got) < 5000 else ""
        miss = [r for r in want if r not in set(got)][:2] if len(got) < 5000 else ""
        return f"rows {len(got)} != {len(want)}; spark only {extra}; sql only {miss}"
    if not got:
        return "EMPTY"
    for a, b in zip(got, want):
        if a != b:
            return f"{sorted(df.columns)}\n   spark {a}\n   sql   {b}"
    return ""
