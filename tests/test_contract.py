"""Driver contract and plan shape."""
import pytest

import __spark_entry__ as E
from oracle_compare import compare, duck
from tableprep.plans.catalog import ORACLE, QUERIES

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["o_orderkey", "o_custkey", "order_day", "priority", "double_key"]


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle_sf0001(spark, key):
    if key in ("slice_rows", "extract_tasks"):  # slice ends past 1,500 orders: the bounds check refuses
        from tableprep.errors import TablePrepError
        with pytest.raises(TablePrepError):
            E.queries()[key](spark, SF001)
        return
    con = duck(SF001)
    r = compare(spark, con, key, E.queries()[key], E.oracle_sql()[key], SF001)
    assert r["ok"], r


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_plan_has_no_single_partition_exchange(spark):
    from tableprep.operators.order import with_row_index
    li = spark.read.parquet(f"{SF01}/lineitem.parquet")
    out = with_row_index(li, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    out.count()
    plan = _plan(out)
    assert "SinglePartition" not in plan
    assert "hashpartitioning(_tp_bucket" in plan


def test_filters_reach_the_scan(spark):
    df = E.queries()["project_then_filter"](spark, SF01)
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThan(c_acctbal,5000.0)]" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in plan


@pytest.mark.parametrize("key", ["clean_tasks", "filter_arith", "split_parts", "sheets_combine",
                                 "validate_corrupt_json", "merge_with_source"])
def test_no_python_in_query_plans(spark, key):
    plan = _plan(E.queries()[key](spark, SF001))
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
