"""Plans keep to what they need: columns and filters reach the scan, nothing is paired by a cross product."""

from __future__ import annotations

import re

import pytest

from tonearm.plans import core_registry

CORE = core_registry().queries


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_used(spark, sf):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", _plan(CORE["slice_seller_informativeness"](spark, sf)))
    assert schemas
    for s in schemas:
        assert {c.split(":")[0] for c in s.split(",")} <= {"l_suppkey", "l_shipdate", "l_extendedprice", "l_discount", "l_quantity"}


def test_filters_reach_the_scan(spark, sf):
    assert "GreaterThan(c_acctbal,5000.0)" in _plan(CORE["u03_semi"](spark, sf))


@pytest.mark.parametrize("name", ["slice_seller_informativeness", "x03_estimates", "x09_jackknife", "a01_contributor_summary", "a03_roll_up", "v09_coherence", "p02_exclude", "j04_priority_match"])
def test_no_products(spark, sf, name):
    plan = _plan(CORE[name](spark, sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_caps_prune_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in _plan(CORE["o04_cap_per_artist"](spark, sf)) and "WindowGroupLimit" in _plan(CORE["w03_ranked_influence"](spark, sf))
