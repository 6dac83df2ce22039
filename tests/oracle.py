"""Rows of a Spark query beside those of its SQL in DuckDB."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if v != v else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    names = sorted(df.columns)
    ours = [tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in names]).collect()]
    theirs = [tuple(map(plain, r)) for r in con.execute("SELECT " + ", ".join(f'"{c}"' for c in names) + f" FROM ({sql})").fetchall()]
    key = lambda r: tuple((x is None, str(round(x, 2)) if isinstance(x, float) else str(x)) for x in r)
    return sorted(ours, key=key), sorted(theirs, key=key)


def same(a, b):
    return len(a) == len(b) and all(len(x) == len(y) and all(u == v or (isinstance(u, (int, float)) and isinstance(v, (int, float)) and math.isclose(u, v, rel_tol=1e-6, abs_tol=2e-3)) for u, v in zip(x, y)) for x, y in zip(a, b))
