"""The physical plans that carry the operators at scale."""

import re

import pytest
from pyspark.sql import functions as F

from plantwatch.operators import fleet, ordered, process
from plantwatch.registry import QUERIES
from plantwatch.registry.book import view
from tests.conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


LAZY = [n for n in QUERIES if n not in {"multilabel", "failure_report", "isolation_forest", "isolation_forest_report", "permutation_importance"}]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["sensor_readings", "alerts", "node_trend", "top_risk", "process_readings", "random_sample"])
def test_limits_keep_k_rows_per_task(spark, name):
    assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, SMALL))


@pytest.mark.parametrize("name", ["recent_stats", "last_n", "top_k_per_key", "alert_breakdown", "trend_slope"])
def test_groups_are_cut_before_the_shuffle(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert re.search(r"WindowGroupLimit .*Final", text) and re.search(r"WindowGroupLimit .*Partial", text)


def test_global_series_is_not_one_partition(spark):
    readings = view(spark, SMALL, "readings")
    text = plan(ordered.lag_windows_bucketed(readings, ["event_ts", "reading_id"], ["rpm"], 20, rows_per_slice=100))
    frames = [line for line in text.splitlines() if "collect_list" in line and "Window" in line]
    assert frames and all("[_slice" in line for line in frames)


def test_columns_and_filters_reach_the_scan(spark):
    readings = view(spark, SMALL, "readings")
    text = plan(fleet.equipment_summary(readings))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "props" not in schema and "value" not in schema
    lineitem = spark.read.parquet(f"{SMALL}/lineitem.parquet").filter(F.col("l_partkey") == 7)
    assert "EqualTo(l_partkey,7)" in plan(lineitem)


def test_large_nominals_are_not_broadcast(spark):
    raw, nominals = view(spark, SMALL, "process_measured"), view(spark, SMALL, "nominals")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan(process.attach_nominals(raw.select("tag", "regime", "value"), nominals))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rule_tables_are_broadcast(spark):
    for name in ("sensor_breaches", "mode_label", "attach_interventions"):
        assert "BroadcastHashJoin" in plan(QUERIES[name](spark, SMALL))
