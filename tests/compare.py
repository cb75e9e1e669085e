"""Compares a Spark result with DuckDB's, as sorted rows by column name."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(x, 9) if isinstance(x, float) else x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([cell(r[i]) for i in order] for r in data), key=repr)


def difference(df, con, sql):
    """None if both agree, else what differs."""
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    want = rows(names, rel.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} {sorted(names)}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want, strict=False) if g != w]
        return f"{len(got)} and {len(want)} rows, {len(bad)} differ: {bad[:2]}"
    return None
