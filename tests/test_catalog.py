"""Every catalogued query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lumenframe.plans import catalog

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tables, name):
    df = catalog.QUERIES[name](spark, SF)
    found = tables.execute(catalog.ORACLE_SQL[name])
    columns = sorted(df.columns)
    kinds = {d[0]: str(d[1]) for d in found.description}
    assert columns == sorted(kinds)
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([r[i] for i in at]) for r in found.fetchall())
