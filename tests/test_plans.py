"""Plan shapes that matter at scale (checked on the executed physical plan)."""

import __spark_entry__ as E

from .conftest import SF_SMALL


def _plan(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_aux_features_one_aggregation_shuffle(spark):
    p = _plan(spark, "J1_aux_full_outer")
    assert p.count("Exchange hashpartitioning") == 1          # five sources, one groupBy
    assert "SortMergeJoin" not in p and "FullOuter" not in p


def test_threshold_sweep_scans_once_without_nested_loops(spark):
    p = _plan(spark, "A10_threshold_sweep")
    assert p.count("FileScan parquet") == 1
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p


def test_scans_are_pruned(spark):
    p = _plan(spark, "F2_rule_score_by_scheme")
    assert "o_orderpriority" not in p and "c_name" not in p      # unused columns never read


def test_latest_status_is_an_aggregate_not_a_window(spark):
    p = _plan(spark, "W1_latest_decision_status")
    assert "max_by" in p and "Window" not in p
