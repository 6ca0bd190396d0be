"""Every registered query with SQL gives the rows of its SQL; the others run and have a stable schema."""

from __future__ import annotations

import math

import duckdb
import pytest

from bagweave.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


def key(row):
    return tuple((v is None, "" if isinstance(v, (int, float)) else str(v), v if isinstance(v, (int, float)) else 0) for v in row)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    if name not in registry.ORACLES:
        assert len(columns) == len(set(columns))
        return
    found = duck.sql(registry.ORACLES[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=key)
