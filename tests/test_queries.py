"""Registered queries against their SQL on the smallest tables.

A cross-section runs by default; set ALL_QUERIES=1 for every query (or use tools/check.py).
"""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CORE = (
    "densify_panel", "feat_price_stats", "baseline_cv", "wrmsse_for_models", "score_headline", "score_per_level",
    "error_concentration", "conformal_fit_pooled", "bootstrap_pvalues", "recon_bottom_up", "demand_route",
)
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else CORE


@pytest.fixture(scope="module")
def duck():
    return check.duck(SF)


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = check.spark_rows(entry.queries()[name](spark, SF))
    assert check.compare(got, check.duck_rows(duck, entry.oracle_sql()[name])) is None
