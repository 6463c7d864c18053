"""What reaches the scan, and where a single task is allowed."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from lakeward.cases import load_all

QUERIES = [n for n in entry.queries() if n in load_all()]


@pytest.mark.parametrize(
    "name, pushed",
    [
        ("flt_recent", "GreaterThanOrEqual(ts,2024-01-11"),
        ("m_patient_daily", "GreaterThanOrEqual(ts,2024-01-11"),
        ("m_integration_prod", "GreaterThanOrEqual(ts,2024-01-11"),
        ("dq_accepted_range", "Or(LessThan(o_totalprice,5000.0),GreaterThan(o_totalprice,400000.0))"),
        ("dq_unique", "IsNotNull(l_orderkey)"),
        ("join_semi", "GreaterThan(c_acctbal,5000.0)"),
        ("agg_billing", "In(event_type, [click,purchase])"),
    ],
)
def test_filters_reach_the_scan(plan_of, name, pushed):
    assert pushed in plan_of(name)


@pytest.mark.parametrize(
    "name, columns",
    [
        ("src_parquet", "l_orderkey:bigint,l_linenumber:int,l_extendedprice:double"),
        ("agg_count", ""),
        ("dq_unique", "l_orderkey:bigint"),
        ("agg_distinct_values", "o_orderkey:bigint,o_custkey:bigint,o_orderpriority:string"),
        ("m_demo_last_week", "ts:timestamp_ntz,event_type:string"),
    ],
)
def test_only_needed_columns_are_read(plan_of, name, columns):
    assert f"ReadSchema: struct<{columns}>" in plan_of(name)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_window_gathers_all_rows(plan_of, name):
    """A window without a partition key is over ranges: one row per range, not per row of data."""
    plan = plan_of(name)
    windows = re.findall(r"Window \[.*?windowspecdefinition\((.*?), specifiedwindowframe", plan)
    unpartitioned = [w for w in windows if re.match(r"\S+ (ASC|DESC)", w)]
    assert all(re.match(r"_range#", w) for w in unpartitioned)
