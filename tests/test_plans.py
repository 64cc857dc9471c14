"""What physical plans have to show: pruned scans, combined aggregates, bounded ranks, no cartesian products."""

import re

import pytest

from millrace.plans import catalogue

QUERIES = catalogue.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(QUERIES["scan_filter_project"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(l_quantity), IsNotNull(l_returnflag), GreaterThan(l_quantity,40.0), EqualTo(l_returnflag,R)]" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_returnflag:string>" in text


def test_aggregates_combine_before_the_shuffle(spark, sf_dir):
    for name in ("agg_group", "win_tumble", "nexmark_q18", "changelog_net", "changelog_upsert"):
        text = plan(QUERIES[name](spark, sf_dir))
        assert re.search(r"Aggregate\([^\n]*partial_", text), name


def test_top_n_keeps_n_in_each_task(spark, sf_dir):
    assert "WindowGroupLimit" in plan(QUERIES["topn_row_number"](spark, sf_dir))
    assert "WindowGroupLimit" in plan(QUERIES["last_n_avg"](spark, sf_dir))
    assert "TakeOrderedAndProject" in plan(QUERIES["order_limit"](spark, sf_dir))


def test_interval_joins_are_equality_joins(spark, sf_dir):
    text = plan(QUERIES["join_interval"](spark, sf_dir))
    assert re.search(r"(SortMerge|BroadcastHash|ShuffledHash)Join [^\n]*_bucket", text)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("stream", "iterate"))))
def test_no_cartesian_products(spark, sf_dir, name):
    assert "CartesianProduct" not in plan(QUERIES[name](spark, sf_dir))


def test_not_in_of_several_columns_is_no_nested_loop(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "NestedLoop" not in plan(QUERIES["anti_not_in_pairs"](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
