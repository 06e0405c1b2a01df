"""Every query against its SQL in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tandem.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return str(v) if hasattr(v, "isoformat") else v


def compare(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=key)
    exp = sorted((tuple(norm(dict(zip(want.columns, r))[c]) for c in cols) for r in want.fetchall()), key=key)
    assert got == exp
    return got


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, sf_dir, name):
    assert compare(catalogue.QUERIES[name](spark, sf_dir), catalogue.SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_rows_only(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
