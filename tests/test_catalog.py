"""Every catalog query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from quillrank.plans import catalog
from quillrank.plans.views import TABLES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return float(value) if type(value).__name__ == "Decimal" else value


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_oracle(spark, oracle, name):
    got = catalog.QUERIES[name](spark, DIR)
    want = oracle.execute(catalog.ORACLE[name])
    names, rows = table([d[0] for d in want.description], want.fetchall())
    assert table(got.columns, [tuple(r) for r in got.collect()]) == (names, rows)
