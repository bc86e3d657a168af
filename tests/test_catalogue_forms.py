"""Each query over changed graphs, files and semirings against its SQL, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from loomgraph import catalogue, catalogue_forms

FOLDER = os.environ.get("FORMS_SF_DIR", "/root/testdata/sf0.001")
NAMES = [n for n, f in catalogue.queries().items() if f.__module__ == catalogue_forms.__name__]


@pytest.fixture(scope="module")
def sql():
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    con = duckdb.connect()
    for table in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, sql, name):
    found = catalogue.queries()[name](spark, FOLDER)
    wanted = sql.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    rows = Counter(tuple(r) for r in found.select(*columns).collect())
    assert rows and rows == Counter(wanted.fetchall())
