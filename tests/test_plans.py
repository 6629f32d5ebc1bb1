import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from pointloom.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_are_the_sqls(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    rows = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    at = [want.columns.index(c) for c in sorted(df.columns)]
    assert rows == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["dual_end_flag", "budget_select", "confidence_select", "percentile_clip", "ambiguity", "confident_depth_loss", "robust_extent", "routed_gradients", "ema_fold"])
def test_no_task_gathers_a_table_or_key(spark, name):
    plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().toString()
    assert "percentile(" not in plan and "collect_list(" not in plan
