"""Every registered core query runs, and agrees with its DuckDB equivalent on the smallest tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from palimpsest.plans import registry


def norm(v):
    if v is None:
        return "null"
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.6f}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def compare(spark, duck, sf, queries, oracles, name):
    df = queries[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name in oracles:
        rel = duck.execute(oracles[name])
        at = {d[0]: i for i, d in enumerate(rel.description)}
        assert sorted(at) == cols
        assert got == sorted(tuple(norm(r[at[c]]) for c in cols) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf, name):
    compare(spark, duck, sf, registry.QUERIES, registry.ORACLES, name)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "concept_id", "valid_from", "description", "source", "url", "invalidated_by"] and df.count() > 0
