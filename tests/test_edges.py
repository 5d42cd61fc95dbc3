"""Every domain on tables that are empty, of one row, or without any value."""

from datetime import datetime

import pytest

from gridlore.operators import (
    audit, dashboard, finance, forecast, fraud, insights, inventory, people, profile, quality, risk, sales, tables,
)

SCHEMA = ("row_no long, customer string, product string, category string, region string, date timestamp, "
          "revenue double, profit double, stock double, salary double, department string, overtime double, "
          "attendance string, productivity double, location string")
ONE = (0, "c", "p", "k", "r", datetime(2024, 1, 6, 23), 100.0, 10.0, 0.0, 9.0, "d", 2.0, "ok", 1.0, "l")
NULLS = (None,) * 15

CASES = {"empty": [], "one_row": [ONE], "no_values": [(i, *NULLS[1:]) for i in range(12)],
         "constant": [(i, *ONE[1:]) for i in range(60)], "nan": [(i, *ONE[1:6], float("nan"), *ONE[7:]) for i in range(12)]}

RUNS = {
    "sales": lambda spark, df: sales.sales(df),
    "people": lambda spark, df: people.people(df, {"employee": "customer"}),
    "inventory": lambda spark, df: inventory.inventory(df, datetime(2024, 6, 1), {"item": "product"}),
    "finance": lambda spark, df: finance.financial_health(df),
    "finance_grouped": lambda spark, df: finance.financial_health(df, group_by=["region"]),
    "risk": lambda spark, df: risk.risk(df),
    "risk_grouped": lambda spark, df: risk.risk(df, ["region"]),
    "fraud": lambda spark, df: fraud.fraud(df),
    "fraud_grouped": lambda spark, df: {"p": fraud.suspicious_patterns(df, ["region"]),
                                        "a": fraud.anomalies_small(df, group_by=["region"])},
    "insights": lambda spark, df: insights.insights(df, ["date", "row_no"]),
    "insights_grouped": lambda spark, df: {"c": insights.insight_counts(df, ["date", "row_no"], ["region"]),
                                           "t": insights.top_performers(df, group_by=["region"])},
    "dashboard": lambda spark, df: dashboard.dashboard(df, ["row_no"]),
    "quality": lambda spark, df: {"report": quality.quality_report(df)},
    "clean": lambda spark, df: {"clean": quality.clean(df, quality.FIXES[:5] + quality.FIXES[6:7]),
                                "fixes": quality.fix_report(df, ["fill_missing_mean", "remove_outliers_iqr"])},
    "audit": lambda spark, df: {"audit": audit.audit(spark, {"t": df})},
    "profile": lambda spark, df: {**profile.summary_statistics(df), "s": profile.table_statistics(df),
                                  "i": profile.dataset_insights(df), "t": tables.detect_column_types(df)},
    "forecast": lambda spark, df: forecast.forecast(df, "date", "revenue", 3),
    "forecast_keyed": lambda spark, df: forecast.forecast(df, "date", "revenue", 3, ["region"]),
}


ALWAYS = ("empty", "no_values")
SOME = ("sales", "people", "inventory", "dashboard", "risk", "forecast")  # also on the other cases


@pytest.mark.parametrize("run,case", [(r, c) for r in RUNS for c in CASES if c in ALWAYS or r in SOME])
def test_edge(spark, run, case):
    df = spark.createDataFrame(CASES[case], SCHEMA)
    for name, result in RUNS[run](spark, df).items():
        rows = result.collect()
        for row in rows:
            for cell in row:
                assert cell == cell, (name, row)  # no NaN leaks out
