"""Driver queries of the core against their SQL in DuckDB, on the smallest tables: those through a store, or with CHRONOFACT_ALL_QUERIES=1 all."""

import math
import os

import duckdb
import pytest

from chronofact.plans import driver, driver_facts, driver_store  # noqa: F401  the others add to the first one's queries

THROUGH_A_STORE = [n for n, call in driver.QUERIES.items() if call.__module__ == driver_store.__name__]
NAMES = driver.QUERIES if os.environ.get("CHRONOFACT_ALL_QUERIES") else THROUGH_A_STORE
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return f"{float(v):.6g}" if isinstance(v, int) and not isinstance(v, bool) else str(v)


@pytest.mark.skipif(not os.path.exists(DATA), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(NAMES))
def test_query_equals_sql(spark, sql, name):
    got = driver.QUERIES[name](spark, DATA)
    want = sql.execute(driver.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    at = [got.columns.index(c) for c in columns]
    left = sorted(tuple(plain(r[i]) for i in at) for r in got.collect())
    right = sorted(tuple(map(plain, r)) for r in want.fetchall())
    assert left == right
