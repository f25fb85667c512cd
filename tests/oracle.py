"""Comparing a Spark query with its SQL, which DuckDB runs over the same files."""

import datetime as dt
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = f"{path}/*.parquet" if Path(path).is_dir() else path
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (float, decimal.Decimal)):
        x = float(x)
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    return x


def bag(columns, rows):
    """Column names in order, and the rows sorted, with columns in order of their names."""
    by = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in by], sorted((tuple(plain(r[i]) for i in by) for r in rows), key=repr)


def kinds(df) -> dict[str, str]:
    """Families of types: an integer stands for every width."""
    family = {"int": "int", "bigint": "int", "smallint": "int", "tinyint": "int", "double": "float", "float": "float", "string": "text", "boolean": "bool", "timestamp": "time", "timestamp_ntz": "time"}
    return {n: family.get(t, t) for n, t in df.dtypes}


def same(spark_df, con, sql: str) -> None:
    found = con.execute(sql)
    names, rows = [d[0] for d in found.description], found.fetchall()
    left, right = bag(spark_df.columns, spark_df.collect()), bag(names, rows)
    assert left[0] == right[0], f"columns {left[0]} and {right[0]}"
    assert len(left[1]) == len(right[1]), f"{len(left[1])} and {len(right[1])} rows"
    for a, b in zip(left[1], right[1]):
        assert a == b, f"{a}\n{b}"
