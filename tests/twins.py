"""Compare a registered query with its SQL twin: same rows in any order, doubles to six digits."""

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.6g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return float(v) if type(v).__name__ == "Decimal" else v


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 1e-5 * max(abs(a), abs(b))
    return a == b


def assert_same(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    names = sorted(df.columns)
    ours = [tuple(value(r[n]) for n in names) for r in df.collect()]
    rel = con.sql(sql)
    assert sorted(rel.columns) == names
    at = [rel.columns.index(n) for n in names]
    theirs = [tuple(value(r[k]) for k in at) for r in rel.fetchall()]
    assert len(ours) == len(theirs)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    for a, b in zip(sorted(ours, key=key), sorted(theirs, key=key)):
        assert all(map(close, a, b)), (a, b)
