"""Physical plans: what must and must not be in them."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry.queries()

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables not present")


def plan(spark, name):
    return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_cross_joins(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["c8_all_confidence", "c9_recalculate_confidence", "c10_tumbling_confidence", "t5_final_answer", "g2_is_correct_equivalent"])
def test_row_local_operators_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(spark, name)


@pytest.mark.parametrize("name, shuffles", [("v1_majority_vote", 2), ("v7_pass_at_k", 1), ("v5_set_weighted_vote", 1), ("k3_make_sets", 1)])
def test_number_of_shuffles(spark, name, shuffles):
    assert len(re.findall(r"Exchange hashpartitioning", plan(spark, name))) == shuffles


def test_columns_are_pruned_at_the_scan(spark):
    schema = plan(spark, "v7_pass_at_k").split("ReadSchema: ")[1]
    assert "props" not in schema and "ts:" not in schema


def test_set_sampling_limits_before_the_shuffle(spark):
    text = plan(spark, "k3_make_sets")
    assert text.index("WindowGroupLimit") < text.index("Exchange") < text.rindex("WindowGroupLimit")


@pytest.mark.parametrize("name", ["v1_majority_vote", "v2_weighted_vote_all", "v7_pass_at_k"])
def test_votes_are_counted_before_the_shuffle(spark, name):
    assert re.search(r"partial_(count|sum|min)", plan(spark, name))


def test_no_python_in_relational_queries(spark):
    for name in QUERIES:
        if name.startswith(("v", "k", "g", "t")):
            assert "EvalPython" not in plan(spark, name), name
