"""Every registered query against its SQL, and the shape of its plan."""

import pytest
from compare import connect, differences

import __spark_entry__ as driver

# Queries of the training-data operators have tests of their own.
from tallyline.catalog import ORACLE, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con():
    from conftest import SF

    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_agrees_with_sql(spark, con, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    assert differences(frame, con, ORACLE[name]) is None
    plan = frame._jdf.queryExecution().executedPlan().toString()
    # No product of two tables, no Python in the data path.
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert bad not in plan


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    frame = driver.entry(spark)
    assert frame.columns == ["ACCT_NO", "SUM_TOTAL_DEBIT", "SUM_TOTAL_CREDIT", "SUM_NET"]
    assert frame.count() > 0


def test_filters_reach_the_scan(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = QUERIES["filter_compare"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :]
    for part in ("GreaterThan(o_totalprice", "LessThanOrEqual(o_custkey", "EqualTo(o_orderstatus", "GreaterThanOrEqual(o_custkey,3)"):
        assert part in pushed
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan


def test_sorted_results(spark, sf_dir):
    rows = QUERIES["sort_multi"](spark, sf_dir).collect()
    assert rows == sorted(rows, key=lambda r: (r.o_orderstatus, -r.o_totalprice))
    keys = [r.k for r in QUERIES["merge_sorted"](spark, sf_dir).collect()]
    assert keys == sorted(keys)
    keys = [r.CUST_KEY for r in QUERIES["sum_fields"](spark, sf_dir).collect()]
    assert keys == sorted(keys)
