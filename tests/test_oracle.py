"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, duck

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
# TEST_ALL=1 runs all; otherwise every fourth, plus those whose plans are the most involved.
SLOW = {"train_boosted_trees"}
ALWAYS = {"top_customers", "cross_sell_pairs_parts", "pareto_share", "numeric_summary", "numeric_summary_by_group",
          "trends_by_group", "risk_score_by_group", "kpis", "quality_report", "audit", "health_score", "predict_linear"}
ALL = os.environ.get("TEST_ALL") == "1"
CHOSEN = [n for i, n in enumerate(QUERIES) if ALL or (n not in SLOW and (i % 4 == 0 or n in ALWAYS))]


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, con, name):
    problem, _, _ = compare(spark, con, name, QUERIES[name], ORACLE.get(name), FOLDER)
    assert problem is None, problem


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["name", "revenue", "pct_total"]
    assert out.count() == 20
