"""What the physical plans must and must not hold."""

import re

import pytest
from conftest import SF_DIR

from millrace.plans import QUERIES

BATCH = sorted(k for k in QUERIES if not k.startswith("stream_"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", BATCH)
def test_no_cross_or_nested_loop_join(spark, key):
    text = plan(QUERIES[key](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_partition_predicate_prunes(spark):
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", plan(QUERIES["partition_pruned_scan"](spark, SF_DIR))).group(1)
    assert "day" in filters


def test_bucketed_aggregate_has_no_shuffle(spark):
    assert "Exchange" not in plan(QUERIES["partitioned_bucketed_roundtrip"](spark, SF_DIR))


def test_equality_is_pushed_and_columns_pruned(spark):
    text = plan(QUERIES["equality_filter"](spark, SF_DIR))
    assert "In(o_orderpriority" in text and "EqualTo(o_orderstatus,F)" in text
    assert "o_totalprice" not in text


def test_classification_does_not_shuffle_the_log(spark):
    text = plan(QUERIES["classify_queries"](spark, SF_DIR))
    assert "SortMergeJoin" not in text
    # One small shuffle per shape of classifier, each then broadcast; none for the log.
    assert text.count("Exchange hashpartitioning") == text.count("BroadcastExchange") == 5


def test_group_limit_runs_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["topk_per_group"](spark, SF_DIR))
    assert "TakeOrderedAndProject" in plan(QUERIES["slowest_queries"](spark, SF_DIR))


def test_index_rules_read_each_input_few_times(spark):
    assert plan(QUERIES["index_rule_violations"](spark, SF_DIR)).count("FileScan") <= 16


def test_python_stays_out_of_plans(spark):
    for key in BATCH:
        if not key.startswith("vector_"):
            assert not re.search(r"BatchEvalPython|ArrowEvalPython|InPandas|InArrow", plan(QUERIES[key](spark, SF_DIR))), key
