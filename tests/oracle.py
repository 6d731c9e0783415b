"""Compare a query with its DuckDB SQL: columns, rows and values, in any order."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run_sql(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    r = c.execute(sql)
    return [d[0] for d in r.description], r.fetchall()


def _value(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(_value, v)) if isinstance(v, (list, tuple)) else v


def rows_of(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(_value(r[i]) for i in order)) for r in rows)


def assert_equal(df, sf_dir: str, sql: str) -> None:
    columns, want = run_sql(sf_dir, sql)
    assert sorted(columns) == sorted(df.columns)
    got = [tuple(r) for r in df.collect()]
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    assert len(a) == len(b), (len(a), len(b))
    assert a == b, ([x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3])
