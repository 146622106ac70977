"""Comparison of Spark results with DuckDB."""

import math
from pathlib import Path

import duckdb


def duckdb_rows(sql, sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return normal(names, got.fetchall())


def spark_rows(df):
    return normal(df.columns, [tuple(r) for r in df.collect()])


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    return [names[i] for i in order], sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr)
