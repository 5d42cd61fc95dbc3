"""Whole-domain calls that find the columns by their names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from gridlore.operators.dashboard import dashboard
from gridlore.operators.insights import insights
from gridlore.operators.inventory import inventory
from gridlore.operators.people import people
from gridlore.operators.sales import sales
from gridlore.queries import business, insight
from gridlore.queries.core import union_all
from gridlore.queries.inputs import sales_input
from gridlore.queries.registry import ORACLE, Tables, query

# The columns as a user may have named them; the roles have to be found again.
_SALES = {"customer": "CustomerName", "product": "product_code", "article": "note", "category": "Kategori", "region": "city", "date": "Tgl Transaksi",
          "quantity": "qty", "revenue": "sales_total", "profit": "Laba"}
_STAFF = {"employee": "Full Name", "department": "dept", "location": "kantor", "salary": "base_pay"}
_SHEETS = {"employee": "pegawai", "attendance": "absensi", "date": "tanggal", "overtime": "overtime_hours", "salary": "wage", "productivity": "KPI"}
_STOCK = {"item": "SKU", "stock": "on_hand", "location": "warehouse", "date": "received_at"}


def _renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def _domain(prefix: str, call: Callable, parts: dict[str, str]) -> None:
    """One query per part of a domain's results, checked by the SQL of the operator itself."""
    for part, twin in parts.items():
        def run(spark, sf, part=part):
            return call(spark, sf)[part]

        query(f"{prefix}_{part}", ORACLE[twin])(run)


_domain("sales_call", lambda spark, sf: sales(_renamed(sales_input(Tables(spark, sf)), _SALES)), {
    "top_customers": "top_customers", "customer_segments": "customer_segments", "product_performance": "product_performance",
    "regional_analysis": "regional_analysis", "sales_totals": "sales_totals", "cross_sell_pairs": "cross_sell_pairs"})
_domain("people_call", lambda spark, sf: people(_renamed(business._staff(spark, sf), _STAFF)), {
    "salary_stats": "salary_stats", "salary_by_department": "salary_by_department", "headcount": "headcount",
    "headcount_by_location": "headcount_by_location", "duplicate_employees": "duplicate_employees"})
_domain("time_sheets_call", lambda spark, sf: people(_renamed(business._sheets(spark, sf), _SHEETS)), {
    "overtime_stats": "overtime_stats", "overtime_cost": "overtime_cost", "attendance_monthly": "attendance_monthly",
    "top_bottom_performers": "top_bottom_performers"})
_domain("inventory_call", lambda spark, sf: inventory(_renamed(business._stock(spark, sf), _STOCK), business._AS_OF), {
    "stock_classes": "stock_classes", "stock_aging": "stock_aging", "overstock_items": "overstock_items",
    "location_distribution": "location_distribution", "stock_totals": "stock_totals"})
_domain("insights_call", lambda spark, sf: insights(insight._series(spark, sf), insight._ORDER), {"counts": "insight_counts"})
_domain("dashboard_call", lambda spark, sf: dashboard(insight._series(spark, sf), insight._ORDER), {"insights": "dashboard_insights"})


@query("dashboard_call_kpis", insight._X + union_all([insight._cards(i, c) for i, c in enumerate(("o_orderkey", "o_totalprice", "rising"))]))
def q_dashboard_cards(spark, sf):
    return dashboard(insight._series(spark, sf), insight._ORDER)["kpis"]
