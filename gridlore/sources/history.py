"""A history of analysis results: appended parquet, partitioned by kind of analysis."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

PAGE = 20
PAGE_MAX = 100


def save_result(df: DataFrame, path: str, sheet: str, kind: str) -> str:
    """Appends a result and returns its id. Each row of the result is one JSON text, so a
    long result is written in parallel; the time is that of this write."""
    key = uuid.uuid4().hex
    body = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    rows = df.select(
        F.lit(key).alias("id"), F.lit(sheet).alias("sheet_name"), body.alias("result_json"),
        F.current_timestamp().alias("created_at"), F.lit(kind).alias("analysis_type"))
    rows.write.mode("append").partitionBy("analysis_type").parquet(path)
    return key


def read_history(spark: SparkSession, path: str, kind: str | None = None, limit: int = PAGE) -> DataFrame:
    """The rows of the newest ``limit`` results (1 to 100), newest first, ties by id. A kind
    reads only its own partition."""
    if not 1 <= limit <= PAGE_MAX:
        raise ValueError(f"limit must be 1 to {PAGE_MAX}")
    rows = spark.read.parquet(path)
    if kind is not None:
        rows = rows.where(F.col("analysis_type") == kind)
    newest = rows.groupBy("id").agg(F.max("created_at").alias("__at"))
    newest = newest.orderBy(F.desc("__at"), "id").limit(limit).select("id")
    page = rows.join(F.broadcast(newest), "id", "left_semi")
    return page.orderBy(F.desc("created_at"), "id")
