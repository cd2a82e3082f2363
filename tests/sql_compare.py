"""Compares a query with its SQL twin in DuckDB, as unordered rows."""

import os
from collections import Counter

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            path = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
            con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{path}'")
    return con


def compare(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    con = connect(sf_dir)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
    assert sorted(con.sql(sql).columns) == cols
    got = Counter(tuple(map(repr, r)) for r in df.select(*cols).collect())
    assert got == Counter(tuple(map(repr, r)) for r in want)
    return len(want)
