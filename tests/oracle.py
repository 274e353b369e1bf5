"""Compares a query with its DuckDB SQL."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, list | tuple):
        return tuple(map(cell, x))
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def duck(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, got.fetchall()


def assert_matches(df, sql: str, sf_dir: str) -> int:
    names, want = duck(sql, sf_dir)
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = rows_of(names, want)
    assert len(got) == len(want), (len(got), len(want))
    for g, w in zip(got, want, strict=True):
        assert g == w, (g, w)
    return len(got)
