"""Runs a query's DuckDB SQL over the same Parquet tables and compares whole results."""

import math
import os

import duckdb

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in NAMES:
        at = f"{sf}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}{'/*.parquet' if os.path.isdir(at) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


def compare(df, con, sql):
    names = sorted(df.columns)
    got = [[plain(r[n]) for n in names] for r in df.collect()]
    out = con.execute(sql)
    have = [d[0] for d in out.description]
    assert sorted(have) == names, (sorted(have), names)
    want = [[plain(r[have.index(n)]) for n in names] for r in out.fetchall()]
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        for n, x, y in zip(names, a, b, strict=True):
            same = abs(x - y) <= 2e-5 * max(1.0, abs(x)) if isinstance(x, float) and isinstance(y, float) else x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and float(x) == float(y))
            assert same, (n, a, b)
