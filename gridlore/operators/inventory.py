"""Inventory: stock classes, ageing, reorder and overstock lists, locations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from gridlore.functions.numeric import as_double, mean_of, percent, rounded, without_nan
from gridlore.functions.schema import detect_roles
from gridlore.plans.quantiles import column_quantiles
from gridlore.plans.shape import quoted, top_per

# Fixed values of the rules.
LISTED = 20
REORDER_SHARE = 0.3
OVERSTOCK_QUANTILE = 0.9
AGE_BRACKETS = (("0-30 days", 0, 30), ("31-90 days", 31, 90), ("91-180 days", 91, 180),
                ("181-365 days", 181, 365), (">365 days", 366, None))


def _quantile(df: DataFrame, col: str, prob: float):
    """One exact quantile as a scalar subquery."""
    return column_quantiles(df, [col], [prob]).select("q0").scalar()


def _classified(df: DataFrame, stock: str) -> DataFrame:
    s = F.col("__s")
    rows = df.withColumn("__s", as_double(quoted(stock))).where(s.isNotNull())
    quartiles = column_quantiles(df, [stock], [0.25, 0.75]).select(F.struct("q0", "q1")).scalar()
    rows = rows.withColumn("__q", quartiles).withColumns(
        {"__low": F.col("__q.q0"), "__high": F.col("__q.q1")})
    # A value may be both: the classes are three separate tests.
    tests = F.array_compact(F.array(
        F.when(s == 0, F.lit("dead_stock")),
        F.when((s > 0) & (s <= F.col("__low")), F.lit("slow_moving")),
        F.when((s > F.col("__high")) & (F.col("__high") > 0), F.lit("fast_moving"))))
    return rows.withColumn("__classes", tests)


def stock_classes(df: DataFrame, stock: str = "stock") -> DataFrame:
    """(class, count, pct): dead = 0, slow in (0, Q1], fast above Q3, of rows with a stock."""
    rows = _classified(df, stock)
    names = ("dead_stock", "slow_moving", "fast_moving")
    wide = rows.agg(F.count("*").alias("n"),
                    *[F.count_if(F.array_contains("__classes", c)).alias(c) for c in names])
    return wide.where("n > 0").select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("class"), F.col(c).alias("count"),
                 percent(F.col(c), F.col("n")).alias("pct")) for c in names])))


def stock_class_items(df: DataFrame, item: str = "item", stock: str = "stock",
                      order_by: Sequence[str] | None = None, n: int = LISTED) -> DataFrame:
    """(class, item, rank): the first n items of each class, by item unless told otherwise."""
    rows = _classified(df, stock).select("*", F.explode("__classes").alias("class"))
    best = top_per(rows, ["class"], [quoted(c) for c in (order_by or [item])], n)
    return best.select("class", quoted(item).cast("string").alias("item"), "rank")


def stock_aging(df: DataFrame, as_of: datetime, date: str = "date", stock: str = "stock") -> DataFrame:
    """(bracket, count, total_value) by whole days up to ``as_of``; later dates stay out."""
    when = quoted(date).cast("timestamp")
    age = F.floor((F.lit(as_of).cast("timestamp").cast("double") - when.cast("double")) / 86400)
    bracket = F.lit(None).cast("string")
    for name, low, high in AGE_BRACKETS:
        inside = F.col("__age") >= low
        bracket = F.when(inside if high is None else inside & (F.col("__age") <= high), name).otherwise(bracket)
    rows = df.select(age.alias("__age"), quoted(stock).alias("__s"))
    rows = rows.where(F.col("__age").isNotNull() & F.col("__s").isNotNull())
    out = rows.withColumn("bracket", bracket).where("bracket is not null")
    return out.groupBy("bracket").agg(F.count("*").alias("count"), rounded(F.sum("__s"), 2).alias("total_value"))


def reorder_suggestions(df: DataFrame, item: str = "item", stock: str = "stock",
                        order_by: Sequence[str] | None = None, n: int = LISTED) -> DataFrame:
    """(item, current_stock, reorder_point, suggested_qty): items below max(1, 0.3 x median);
    the quantity is max(mean - stock, twice the reorder point), cut to a whole number."""
    s = as_double(quoted(stock))
    mean = df.agg(mean_of(s)).scalar()
    point = F.greatest(F.lit(1.0), _quantile(df, stock, 0.5) * REORDER_SHARE)
    rows = df.withColumns({"__s": s, "__point": point, "__mean": mean})
    low = rows.where(F.col("__s") < F.col("__point"))
    listed = low.orderBy(*[quoted(c) for c in (order_by or [item])]).limit(n)
    quantity = F.greatest(F.col("__mean") - F.col("__s"), F.col("__point") * 2)
    return listed.select(
        quoted(item).cast("string").alias("item"), F.col("__s").alias("current_stock"),
        rounded(F.col("__point"), 2).alias("reorder_point"),
        F.floor(quantity).cast("bigint").alias("suggested_qty"))


def overstock_items(df: DataFrame, item: str = "item", stock: str = "stock",
                    order_by: Sequence[str] | None = None, n: int = LISTED) -> DataFrame:
    """(item, stock, recommended_max): the first n items above the 90 % quantile."""
    rows = df.withColumns({"__s": as_double(quoted(stock)),
                           "__max": _quantile(df, stock, OVERSTOCK_QUANTILE)})
    over = rows.where(F.col("__s") > F.col("__max"))
    listed = over.orderBy(*[quoted(c) for c in (order_by or [item])]).limit(n)
    return listed.select(quoted(item).cast("string").alias("item"), F.col("__s").alias("stock"),
                         rounded(F.col("__max"), 2).alias("recommended_max"))


def location_distribution(df: DataFrame, location: str = "location", n: int = LISTED) -> DataFrame:
    """(location, count, percentage) of the n locations with most rows."""
    counts = df.where(quoted(location).isNotNull()).groupBy(
        quoted(location).cast("string").alias("location")).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    best = counts.orderBy(F.desc("count"), "location").limit(n).withColumn("__total", total)
    return best.select("location", "count", percent(F.col("count"), F.col("__total")).alias("percentage"))


def stock_totals(df: DataFrame, stock: str = "stock") -> DataFrame:
    """Number of rows and total stock."""
    return df.agg(F.count("*").alias("items"),
                  rounded(F.coalesce(F.sum(quoted(stock)), F.lit(0)), 2).alias("total_stock"))


def inventory(df: DataFrame, as_of: datetime, roles: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """Every inventory result the table has the columns for."""
    found = detect_roles(df, "inventory", roles)
    table = df.select(*[without_nan(df, quoted(c), c).alias(r) for r, c in found.items()])
    out: dict[str, DataFrame] = {}
    if "stock" in found:
        out["stock_classes"] = stock_classes(table)
        out["stock_totals"] = stock_totals(table)
        if "item" in found:
            out["stock_class_items"] = stock_class_items(table)
            out["reorder_suggestions"] = reorder_suggestions(table)
            out["overstock_items"] = overstock_items(table)
        if "date" in found:
            out["stock_aging"] = stock_aging(table, as_of)
    if "location" in found:
        out["location_distribution"] = location_distribution(table)
    return out
