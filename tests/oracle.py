"""Compare a Spark result with its SQL twin on DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return float(f"{x:.9g}") + 0.0
    return str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(_cell, r)) for r in frame.itertuples(index=False)), key=lambda r: tuple((x is None, not isinstance(x, str), x if x is not None else "") for x in r))


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-7))


def assert_same(got, expected):
    assert sorted(got.columns) == sorted(expected.columns)
    a, b = rows(got), rows(expected)
    assert len(a) == len(b)
    off = [(x, y) for x, y in zip(a, b) if not all(map(same, x, y))]
    assert not off, off[:3]
