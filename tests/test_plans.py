"""The plans are those that scale: pruned and filtered scans, partial aggregation, one shuffle per aggregation."""

import os

import pytest

from tidewheel.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def plan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_topk(spark):
    text = plan(spark, "topk")
    assert "TakeOrderedAndProject" in text
    assert "GreaterThan(l_quantity,10.0)" in text and "GreaterThanOrEqual(l_shipdate" in text
    assert "ReadSchema: struct<l_suppkey:bigint,l_linenumber:int,l_quantity:double,l_shipdate:timestamp_ntz>" in text
    assert text.count("Exchange hashpartitioning") == 1 and "partial_sum" in text


@pytest.mark.parametrize("name", ["agg_multi_key", "agg_hist", "timeline_by_dimension", "timeline_week_sunday", "agg_pct_approx", "agg_card_est", "custom_column_in_agg"])
def test_one_shuffle(spark, name):
    text = plan(spark, name)
    assert text.count("Exchange hashpartitioning") == 1 and "partial_" in text
    assert "Join" not in text and "Python" not in text and "Arrow" not in text


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in plan(spark, "filter_eq")
    assert "In(event_type, [click,error])" in plan(spark, "filter_in")
    assert "StringStartsWith(p_brand,Brand#1)" in plan(spark, "filter_prefix")
    assert "LeftSemi" in plan(spark, "filter_in_long_list") and "LeftAnti" in plan(spark, "filter_not_in_long_list")


def test_samples_keep_the_best_only(spark):
    assert "TakeOrderedAndProject" in plan(spark, "samples_topk")


def test_a_request_for_all_rows(spark):
    from tidewheel.engine import Engine
    from tidewheel.plans.request import ALL_ROWS, Metric, QueryRequest
    from tidewheel.spec import TimeSpec

    assert "Limit" not in plan(spark, "custom_service")
    engine = Engine(spark)
    engine.catalog.register("many", spark.range(1500), TimeSpec("STATIC", value=1))
    request = QueryRequest("many", 0, 2, None, ["id"], [Metric("id", "COUNT")], top=ALL_ROWS)
    assert engine.query(request).count() == 1500
