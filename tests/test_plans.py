"""What the plans must look like to hold at scale."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from tidewater.plans import features, gold, serving

#: Cross joins with one row (a mean, a maximum, the bounds of time), or with the five shards.
ONE_ROW = {"eta_window_join", "geofence_arrivals", "box_geofence", "stop_islands", "speed_arrivals", "arrivals_union_anti", "departures_first_exit", "port_calls_full", "arrival_journeys", "port_congestion_hourly", "congestion_normalised", "q_port_congestion_latest", "median_fill", "port_stats", "sample_weights"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for m in (gold, serving, features) for n in m.QUERIES])
def test_no_cross_joins_and_no_row_at_a_time_python(spark, data, name):
    p = plan(entry.queries()[name](spark, data))
    assert "CartesianProduct" not in p and "BatchEvalPython" not in p
    assert "BroadcastNestedLoopJoin" not in p or name in ONE_ROW


def test_snapshot_reads_few_columns_and_pushes_its_filters(spark, data):
    p = plan(entry.queries()["q_last_positions"](spark, data))
    scan = next(line for line in p.splitlines() if "FileScan" in line and "navigational_status" in line)
    assert "raim" not in scan.split("ReadSchema")[1]
    assert all(re.search(rf"\b{k}", scan.split("PushedFilters")[1]) for k in ("ts", "lat", "lon"))
    assert "WindowGroupLimit" in p


@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p4_found", "p5_found", "p5_regions", "p6_found", "p7_found"])
def test_problem_queries_prune_columns(spark, data, name):
    p = plan(entry.queries()[name](spark, data))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", p)
    assert scans and all(len(columns.split(",")) <= 8 for columns in scans)
    assert "CartesianProduct" not in p and "NestedLoop" not in p
