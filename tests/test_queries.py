"""Every query with SQL gives the SQL's rows on the smallest data."""

import glob
import os

import duckdb
import pytest

from stratalake.plans.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
FAST = [n for n in ORACLES if n.startswith(("scan", "filter", "in_list", "kleene", "boolean", "predicate", "function_registry", "cross", "nested_p", "variant", "file_stats", "zone", "column_p", "dictionary", "prune", "iceberg", "manifest", "bloom", "index", "row_id", "log_r", "partition_t", "snapshot", "delta_e", "for_e", "dict_e", "runend", "datetime", "conflict", "window"))]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if v is None or v != v:
        return str(v) if v is not None else "None"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", FAST)
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    want = duck.execute(ORACLES[name])
    heads = [c[0] for c in want.description]
    assert sorted(heads) == names
    rows = sorted(tuple(plain(r[heads.index(c)]) for c in names) for r in want.fetchall())
    assert mine == rows


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() >= 0
