"""Physical plans: no unbounded single-task windows, no cross joins, pruned scans."""

import re

import pytest
from frames import grid_frame

from hourloom import queries as registry
from hourloom.operators.windows import add_features, lag, rolling

SF = "/root/testdata/sf0.001"
registry.load()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["flagship_baseline", "hourly_grid", "lag_features", "halo_features", "feature_set_v2", "exceedance_24h", "join_station_left"]
)
def test_windows_never_run_in_one_task(spark, name):
    """A window over a single partition shows as SinglePartition right below its sort."""
    text = plan_of(registry.RUNNERS[name](spark, SF))
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if re.search(r"\bWindow \[", line):
            below = [x for x in lines[i + 1 : i + 4] if "Exchange" in x]
            assert not any("SinglePartition" in x for x in below), line


@pytest.mark.parametrize("name", sorted(set(registry.SQL) - {"median_impute", "standardize", "linear_closed_form"}))
def test_no_cross_joins_or_python_rows(spark, name):
    text = plan_of(registry.RUNNERS[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_scans_read_only_what_they_need(spark):
    text = plan_of(registry.RUNNERS["exceedance_24h"](spark, SF))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas and all("props" not in s and "user_id" not in s for s in schemas)


def test_buckets_are_spread_by_an_exchange_on_the_bucket(spark):
    df, _ = grid_frame(spark, 500)
    text = plan_of(add_features(df, [lag("l", "value", 1), rolling("m", "value", "mean", 24)], ["series"]))
    assert re.search(r"Exchange hashpartitioning\(series#\d+, _bucket", text)
    assert text.count("Exchange hashpartitioning") == 1


def test_profiles_combine_before_the_shuffle(spark):
    text = plan_of(registry.RUNNERS["diurnal_profile"](spark, SF))
    assert "partial_sum" in text and text.count("Exchange hashpartitioning") == 1
