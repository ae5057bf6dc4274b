"""Holds a registered query's rows against its DuckDB SQL."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, (str, bool, int)):
        return v
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def assert_same(spark, sf_dir: str, run, sql: str) -> None:
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.sql(f"create view {t} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    df = run(spark, sf_dir)
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    at = [rel.columns.index(c) for c in order]
    want = Counter(tuple(plain(r[k]) for k in at) for r in rel.fetchall())
    assert got == want
