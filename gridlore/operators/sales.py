"""Sales analytics: customers, segments, trend, products, regions, product pairs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window, functions as F

from gridlore.functions.numeric import percent, rounded, without_nan
from gridlore.functions.schema import detect_roles
from gridlore.plans.position import running_total
from gridlore.plans.shape import quoted

# Fixed values of the rules below.
TOP_N = 20
TOP_PAIRS = 10
PARETO_SHARE = 0.8
DAILY_SPAN_DAYS = 35
WEEKLY_SPAN_DAYS = 180


def sales_table(df: DataFrame, roles: Mapping[str, str] | None = None) -> DataFrame:
    """The table reduced to the sales roles it has, under the role names."""
    found = detect_roles(df, "sales", roles)
    return df.select(*[without_nan(df, quoted(col), col).alias(role) for role, col in found.items()])


def _revenue_by(df: DataFrame, key: str, revenue: str, *more) -> DataFrame:
    known = df.where(quoted(key).isNotNull())
    total = F.coalesce(F.sum(quoted(revenue)), F.lit(0)).alias("__rev")
    return known.groupBy(quoted(key).alias(key)).agg(total, *more)


def _total(grouped: DataFrame):
    return grouped.agg(F.sum("__rev").cast("double")).scalar()


def top_customers(df: DataFrame, customer: str = "customer", revenue: str = "revenue",
                  n: int = TOP_N) -> DataFrame:
    """(name, revenue, pct_total) of the n best customers; empty if total revenue <= 0."""
    grouped = _revenue_by(df, customer, revenue)
    total = _total(grouped)
    return (
        grouped.orderBy(F.desc("__rev"), quoted(customer)).limit(n)
        .withColumn("__total", total).where(F.col("__total") > 0)
        .select(
            quoted(customer).cast("string").alias("name"),
            rounded(F.col("__rev"), 2).alias("revenue"),
            percent(F.col("__rev"), F.col("__total")).alias("pct_total"),
        )
    )


def customer_segments(df: DataFrame, customer: str = "customer",
                      revenue: str = "revenue") -> DataFrame:
    """Three rows: high (> 2 x mean revenue per customer), medium, low (<= 0.5 x mean)."""
    grouped = _revenue_by(df, customer, revenue).select(F.col("__rev").cast("double"))
    mean = grouped.agg(F.avg("__rev")).scalar()
    rev = F.col("__rev")
    grouped = grouped.withColumn("__mean", mean).withColumn(
        "__segment",
        F.when(rev > F.col("__mean") * 2, "high").when(rev > F.col("__mean") * 0.5, "medium")
        .otherwise("low"),
    )
    names = ("high", "medium", "low")
    aggs = [F.count("*").alias("customers"), F.sum(rev).alias("total")]
    for s in names:
        here = F.col("__segment") == s
        aggs += [F.count_if(here).alias(f"n_{s}"),
                 F.coalesce(F.sum(F.when(here, rev)), F.lit(0.0)).alias(f"r_{s}")]
    rows = F.array(*[
        F.struct(
            F.lit(s).alias("segment"),
            F.col(f"n_{s}").alias("customers"),
            percent(F.col(f"n_{s}"), F.col("customers")).alias("pct_customers"),
            percent(F.col(f"r_{s}"), F.col("total")).alias("pct_revenue"),
        )
        for s in names
    ])
    wide = grouped.agg(*aggs).where((F.col("total") > 0) & (F.col("customers") > 1))
    return wide.select(F.inline(rows))


def pareto_share(df: DataFrame, customer: str = "customer", revenue: str = "revenue",
                 share: float = PARETO_SHARE) -> DataFrame:
    """Share of customers (%) whose cumulated revenue, best first, stays within 80 %."""
    grouped = _revenue_by(df, customer, revenue)
    order = [F.desc("__rev"), quoted(customer).asc()]
    running = running_total(grouped, order, "__rev")
    total = F.sum("__rev").cast("double").alias("total")
    all_in = grouped.agg(total).scalar()
    out = running.withColumn("__total", all_in).agg(
        F.count("*").alias("customers"),
        F.count_if(F.col("running").cast("double") <= F.col("__total") * share).alias("top_customers"),
    )
    return out.where("customers > 1").select(
        "customers", "top_customers",
        percent(F.col("top_customers"), F.col("customers")).alias("pct_customers"),
    )


def sales_trend(df: DataFrame, date: str = "date", revenue: str = "revenue") -> DataFrame:
    """(grain, period, revenue, growth): daily up to 35 days of data, weekly (weeks start
    on Monday) up to 180, monthly beyond. Growth is against the previous period present
    and only if that was positive. Period is the first day of the day, week or month."""
    known = df.select(quoted(date).cast("timestamp").alias("__d"), quoted(revenue).alias("__r"))
    known = known.where(F.col("__d").isNotNull() & F.col("__r").isNotNull())
    seconds = F.max("__d").cast("double") - F.min("__d").cast("double")
    days = F.floor(seconds / 86400)
    grain = known.agg(
        F.when(days <= DAILY_SPAN_DAYS, "day").when(days <= WEEKLY_SPAN_DAYS, "week")
        .otherwise("month")
    ).scalar()
    unit = F.col("__grain")
    start = (
        F.when(unit == "day", F.date_trunc("day", "__d"))
        .when(unit == "week", F.date_trunc("week", "__d"))
        .otherwise(F.date_trunc("month", "__d"))
    )
    # Days of at most 36 dates, weeks of half a year, or calendar months: a short table.
    periods = known.withColumn("__grain", grain).groupBy(
        unit.alias("grain"), start.alias("period")
    ).agg(F.sum("__r").alias("__s"))
    before = F.lag("__s").over(Window.partitionBy("grain").orderBy("period"))
    periods = periods.withColumn("__prev", before.cast("double"))
    now = F.col("__s").cast("double")
    growth = F.when(F.col("__prev") > 0, percent(now - F.col("__prev"), F.col("__prev")))
    return periods.select("grain", "period", rounded(now, 2).alias("revenue"),
                          growth.alias("growth")).orderBy("period")


def trend_direction(trend: DataFrame) -> DataFrame:
    """Average growth of a ``sales_trend`` and its direction (above 2 up, below -2 down)."""
    avg = F.avg("growth")
    return trend.agg(
        F.max("grain").alias("grain"), F.count("growth").alias("periods"),
        rounded(avg, 2).alias("avg_growth"),
        F.when(avg > 2, "rising").when(avg > -2, "stable").when(avg.isNotNull(), "falling")
        .alias("direction"),
    )


def product_performance(df: DataFrame, product: str = "product", revenue: str = "revenue",
                        profit: str | None = None, n: int = TOP_N) -> DataFrame:
    """(product, revenue, profit, margin, pct_total) of the n best products."""
    gain = F.coalesce(F.sum(quoted(profit)), F.lit(0)) if profit else F.lit(None).cast("double")
    grouped = _revenue_by(df, product, revenue, gain.alias("__gain"))
    total = _total(grouped)
    best = grouped.orderBy(F.desc("__rev"), quoted(product)).limit(n).withColumn("__total", total)
    rev, won = F.col("__rev"), F.col("__gain")
    return best.select(
        quoted(product).cast("string").alias("product"),
        rounded(rev, 2).alias("revenue"),
        rounded(won, 2).alias("profit"),
        F.when(rev > 0, percent(won, rev)).alias("margin"),
        F.when(F.col("__total") > 0, percent(rev, F.col("__total"))).otherwise(0.0)
        .alias("pct_total"),
    )


def regional_analysis(df: DataFrame, region: str = "region", revenue: str = "revenue",
                      n: int = TOP_N) -> DataFrame:
    """(region, revenue, count, pct_revenue) of the n best regions."""
    grouped = _revenue_by(df, region, revenue, F.count(quoted(revenue)).alias("count"))
    total = _total(grouped)
    best = grouped.orderBy(F.desc("__rev"), quoted(region)).limit(n).withColumn("__total", total)
    return best.select(
        quoted(region).cast("string").alias("region"),
        rounded(F.col("__rev"), 2).alias("revenue"),
        "count",
        F.when(F.col("__total") > 0, percent(F.col("__rev"), F.col("__total"))).otherwise(0.0)
        .alias("pct_revenue"),
    )


def sales_totals(df: DataFrame, revenue: str = "revenue") -> DataFrame:
    """Total revenue and number of rows."""
    total = F.coalesce(F.sum(quoted(revenue)), F.lit(0))
    return df.agg(rounded(total, 2).alias("total_revenue"), F.count("*").alias("transactions"))


def sales(df: DataFrame, roles: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """Every sales result the table has the columns for, one lazy DataFrame each."""
    from gridlore.operators.product_pairs import cross_sell_pairs

    table = sales_table(df, roles)
    has = set(table.columns).issuperset
    out: dict[str, DataFrame] = {}
    if has({"customer", "revenue"}):
        out["top_customers"] = top_customers(table)
        out["customer_segments"] = customer_segments(table)
        out["pareto_share"] = pareto_share(table)
    if has({"date", "revenue"}):
        out["sales_trend"] = sales_trend(table)
        out["trend_direction"] = trend_direction(out["sales_trend"])
    if has({"product", "revenue"}):
        gain = "profit" if "profit" in table.columns else None
        out["product_performance"] = product_performance(table, profit=gain)
    if has({"region", "revenue"}):
        out["regional_analysis"] = regional_analysis(table)
    if has({"customer", "product"}):
        out["cross_sell_pairs"] = cross_sell_pairs(table)
    if has({"revenue"}):
        out["sales_totals"] = sales_totals(table)
    return out
