import math
from decimal import Decimal

import duckdb
import pytest

from weftgraph import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()
ORACLE, QUERIES = queries.oracle_sql(), queries.queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return float(v) if isinstance(v, (int, Decimal)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    found = duck.sql(ORACLE[name])
    order = sorted(got.columns)
    assert order == sorted(found.columns)
    at = [found.columns.index(c) for c in order]
    want = sorted(str([plain(r[i]) for i in at]) for r in found.fetchall())
    have = sorted(str([plain(r[c]) for c in order]) for r in got.collect())
    assert have == want


def test_every_query_is_held_against_something():
    assert set(QUERIES) == set(ORACLE)
