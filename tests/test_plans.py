import pytest

from gridloom import queries

SF = "/root/testdata/sf0.001"
#: Queries of Python functions, which is what they are for.
OPAQUE = {n for n in queries.QUERIES if "python" in n} | {"itask_partition_totals", "task_partition_rows"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_native_without_cross_joins(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    bad = ["CartesianProduct", "BroadcastNestedLoopJoin"]
    if name not in OPAQUE:
        bad += ["EvalPython", "PythonUDF", "MapInArrow", "InPandas", "InArrow"]
    assert not [word for word in bad if word in plan]


def test_scans_read_needed_columns_only(spark):
    plan = queries.QUERIES["mapreduce_multi_dot"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_extendedprice:double,l_discount:double>" in plan


def test_reductions_shuffle_partial_results_only(spark):
    plan = queries.QUERIES["mapreduce_dims_cols"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and plan.count("Exchange hashpartitioning") == 1
