"""A number of -0.0, as rounding makes it of a small negative one, in the snapshots' text."""

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from chronofact.functions.values import canonical_json
from chronofact.plans import driver, driver_store  # noqa: F401  adds to the first one's queries


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("zeros")
    customers = pq.read_table("/root/testdata/sf0.001/customer.parquet")
    balances = customers["c_acctbal"].to_pylist()
    for i, (key, segment) in enumerate(zip(customers["c_custkey"].to_pylist(), customers["c_mktsegment"].to_pylist())):
        if key in (7, 8) or segment == "BUILDING" and key % 2:
            balances[i] = 0.0 if key == 8 else -0.0
    assert sum(str(b) == "-0.0" for b in balances) > 3
    pq.write_table(customers.set_column(customers.column_names.index("c_acctbal"), "c_acctbal", pa.array(balances)), os.path.join(at, "customer.parquet"))
    return str(at)


@pytest.mark.parametrize("name", ["snapshot_as_of", "snapshot_latest", "snapshot_backfill", "snapshot_states"])
def test_snapshots_equal_their_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{folder}/customer.parquet'")
    want = sorted(con.execute(driver.SQL[name]).fetchall())
    assert sorted(map(tuple, driver.QUERIES[name](spark, folder).collect())) == want
    assert name != "snapshot_states" or any('"value":-0}' in r[2] for r in want)


def test_zeros_have_one_text_unless_asked_otherwise():
    assert canonical_json([-0.0, 0.0]) == "[0,0]"
    assert canonical_json([-0.0, 0.0, 0], signed_zero=True) == "[-0,0,0]"
