"""Physical plans as they look when nothing is small enough to broadcast."""

import re

import pytest

import __spark_entry__ as contract
from seriesloom.operators import models

DATA = "/root/testdata/sf0.001"
QUERIES = ["scoreboard", "lag_features", "daily_pnl", "error_quartiles", "volatile_week", "rescaled_meta", "delay_aggregate", "acf_topk", "trend_split"]
# Shuffles of queries over regular series: those of the panel, and the operator's own.
SHUFFLES = {"sequence_windows": 8, "df_stat": 8, "seasonal_diff": 8, "daily_pnl": 8, "volatile_week": 12, "nth_window": 12}


@pytest.fixture
def big(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("name", QUERIES)
def test_no_cross_join_one_scan_no_single_task(big, name):
    plan = contract.queries()[name](big, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "Exchange SinglePartition" not in plan
    assert plan.count("FileScan") == 1


def test_only_used_columns_are_read(big):
    plan = contract.queries()["scoreboard"](big, DATA)._jdf.queryExecution().executedPlan().toString()
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"user_id", "ts", "value"}
    assert "IsNotNull(user_id)" in plan


@pytest.mark.parametrize("name", SHUFFLES)
def test_regular_series_are_not_numbered_again(big, name):
    plan = contract.queries()[name](big, DATA)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange (?:hash|range|Single)", plan)) <= SHUFFLES[name]


@pytest.mark.parametrize("name", ["interval_metrics", "calibration", "stacked_linear"])
def test_forecasts_add_up_no_sliding_frames(big, name, monkeypatch):
    fitted_on = []
    fit = models.LinearRegression.fit
    monkeypatch.setattr(models.LinearRegression, "fit", lambda self, df, *more: (fitted_on.append(df), fit(self, df, *more))[1])
    plan = contract.queries()[name](big, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "RowFrame, -24, -1)" not in plan
    # The fit scans its rows several times: they are read back, not made again.
    for df in fitted_on:
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
