"""Every registered query with SQL gives the same rows as DuckDB on the same tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from bulletinlake.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v if isinstance(v, (int, str, type(None))) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, sf, con, name):
    rel = con.sql(catalogue.ORACLE_SQL[name])
    df = catalogue.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(rel.columns)
    mine = sorted((tuple(map(plain, r)) for r in df.select(*rel.columns).collect()), key=repr)
    assert mine == sorted((tuple(map(plain, r)) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "source", "n_chars", "selected", "reason"]
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
