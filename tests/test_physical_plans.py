"""What the plans must look like: filters and columns reach the scan, small sides aren't shuffled, no cross joins."""

import re

import pytest

from tidegate import queries as Q
from tidegate.operators import clean, evaluate, features
from tidegate.sources import store

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_date_range_and_columns_reach_the_scan(spark):
    text = plan(clean.date_range(Q.intraday(spark, SF), "2024-01-05", "2024-01-20"))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts", text) and re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(ts", text)
    assert "props" not in text and "user_id" not in text


def test_store_reads_prune_partitions(spark, tmp_path):
    rows = Q.fact(spark, SF).withColumnsRenamed({}).select("ts", "value", "fetched_at", "symbol", "interval")
    rows.write.partitionBy("symbol", "interval").parquet(str(tmp_path / "prices"))
    Q.meta(spark).select("name", "unit", "symbol", "interval").write.partitionBy("symbol", "interval").parquet(str(tmp_path / "meta"))
    text = plan(store.Store(spark, str(tmp_path)).load("1-URGENT", "F"))
    assert re.search(r"PartitionFilters: \[[^\]]*symbol[^\]]*1-URGENT", text)


def test_series_filter_passes_the_window(spark):
    text = plan(features.returns(Q.intraday(spark, SF)).where("series_id = 'click'"))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(event_type,click\)", text)


@pytest.mark.parametrize("name", ["log_return", "rolling_vol", "zscore_train", "segments", "det_hard_switch", "status_report", "empirical_summary", "route_a"])
def test_no_cross_joins(spark, name):
    text = plan(Q.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_returns_and_rolling_share_one_shuffle(spark):
    assert len(re.findall(r"Exchange hashpartitioning", plan(features.rolling(Q.intraday(spark, SF), "rolling_vol", 5)))) == 1


def test_as_of_sorts_once_and_joins_nothing(spark):
    bars = Q.eval_bars(spark, SF)
    text = plan(evaluate.as_of(Q.eval_events(spark, SF).select("series_id", "id", Q.F.col("start").alias("at")), bars))
    assert "Join" not in text


@pytest.mark.parametrize("name, sorts", [("calibration_verify", 4), ("scale_check", 4), ("empirical_summary", 8)])
def test_summaries_sort_the_rows_few_times(spark, name, sorts):
    """All sorts of a series may lie in one task, and each holds a page of memory at least."""
    assert len(re.findall(r"\bSort \[", plan(Q.QUERIES[name](spark, SF)))) <= sorts


def test_warnings_read_fits_and_regimes_once(spark):
    text = plan(Q.QUERIES["diagnostic_warnings"](spark, SF))
    assert len(re.findall(r"FlatMapGroupsInPandas ", text)) == 2
