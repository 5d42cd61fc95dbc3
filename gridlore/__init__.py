"""Tabular analytics on Spark: DataFrame in, DataFrame out.

    from gridlore import build_session, sales, quality_report

Each domain module under ``gridlore.operators`` holds its operators; the names below are
the entry points that run a whole domain.
"""

from gridlore.functions.schema import columns_of, detect_roles, normalize_headers
from gridlore.operators.audit import audit
from gridlore.operators.dashboard import dashboard
from gridlore.operators.finance import financial_health
from gridlore.operators.forecast import forecast
from gridlore.operators.fraud import fraud
from gridlore.operators.insights import insights
from gridlore.operators.inventory import inventory
from gridlore.operators.people import people
from gridlore.operators.profile import dataset_insights, summary_statistics, table_statistics
from gridlore.operators.quality import clean, fix_report, quality_report
from gridlore.operators.regression import feature_importance, predict, train
from gridlore.operators.risk import risk
from gridlore.operators.sales import sales
from gridlore.operators.tables import detect_column_types, sql
from gridlore.session import build_session
from gridlore.sources.history import read_history, save_result
from gridlore.sources.jdbc import jdbc_columns, jdbc_preview, jdbc_tables, read_jdbc
from gridlore.sources.raw import read_raw
from gridlore.sources.tables import (
    coerce_types, from_rows, load_saved, read_table, read_workbook, write_table,
)

__all__ = [
    "audit", "build_session", "clean", "coerce_types", "columns_of", "dashboard", "dataset_insights",
    "detect_column_types", "detect_roles", "feature_importance", "financial_health", "fix_report", "forecast",
    "fraud", "from_rows", "insights", "inventory", "jdbc_columns", "jdbc_preview", "jdbc_tables", "load_saved",
    "normalize_headers", "people", "predict", "quality_report", "read_history", "read_jdbc", "read_raw", "read_table",
    "read_workbook", "risk", "sales", "save_result", "sql", "summary_statistics", "table_statistics", "train",
    "write_table",
]
