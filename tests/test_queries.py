"""Every query with SQL gives the same rows in DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from mosaiq.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _cell(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else str(round(v, 5) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(tuple(_cell(r[c]) for c in columns) for r in df.collect())
    assert rows
    if name in catalogue.ORACLES:
        cur = duck.execute(catalogue.ORACLES[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert sorted(tuple(_cell(r[i]) for i in at) for r in cur.fetchall()) == rows


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() == spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label").distinct().count()


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
