"""Trends, anomalies, correlations and top performers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gridlore.functions.numeric import as_double, mean_of, rounded
from gridlore.functions.schema import columns_of
from gridlore.operators.profile import correlations
from gridlore.plans.position import position_trend
from gridlore.plans.shape import column_rows, measured_join, melt_numeric, quoted, same_keys, top_per
from gridlore.session import pin

# Fixed values of the rules.
MIN_VALUES = 5
MIN_CHANGE_PCT = 5.0
Z_LIMIT = 3.0
TOP_ANOMALIES = 50
MIN_CORRELATION = 0.5
MAX_CATEGORIES = 50
TOP_CATEGORIES = 5
TINY = 1e-9


def _numbers(df: DataFrame, cols, group_by) -> list[str]:
    return list(cols or [c for c in columns_of(df, "numeric") if c not in group_by])


def trends(df: DataFrame, order_by: Sequence[str], cols: Sequence[str] | None = None,
           group_by: Sequence[str] = ()) -> DataFrame:
    """(metric, direction, change_pct): least-squares slope over the rows in order, as % of
    the mean over the whole length; at least 5 values and 5 % change. The absolute mean
    is the base, so a negative mean does not flip the direction."""
    cols = _numbers(df, cols, group_by)
    ids = [*group_by, *[c for c in order_by if c not in group_by]]
    cells = melt_numeric(df, cols, ids)
    fits = position_trend(cells, [*group_by, "column"], order_by, "value")
    change = F.col("slope") * F.col("n") / F.abs("mean") * 100
    fits = fits.where((F.col("n") >= MIN_VALUES) & (F.abs("mean") >= TINY))
    fits = fits.withColumn("__change", change).where(F.abs("__change") >= MIN_CHANGE_PCT)
    return fits.select(
        *map(quoted, group_by), F.col("column").alias("metric"),
        F.when(F.col("__change") > 0, "up").otherwise("down").alias("direction"),
        rounded(F.col("__change"), 2).alias("change_pct"))


def _scored(df: DataFrame, cols, ids, group_by, min_values: int) -> DataFrame:
    """(group_by, ids, column, value, z): cells with their distance in standard deviations."""
    stats = column_rows(df, cols, {
        "n": lambda c: F.count(as_double(c)),
        "mean": lambda c: mean_of(as_double(c)),
        "sd": lambda c: F.stddev_samp(as_double(c)),
    }, group_by).where((F.col("n") >= min_values) & (F.col("sd") >= TINY))
    stats = stats.select(*map(quoted, group_by), "column", "mean", "sd")
    cells = melt_numeric(df, cols, [*group_by, *ids])
    if group_by:
        stats = pin(stats)
    joined = measured_join(cells, stats, [*group_by, "column"], small_right=not group_by)
    return joined.withColumn("z", F.abs((F.col("value") - F.col("mean")) / F.col("sd")))


def _far_cells(df: DataFrame, cols: Sequence[str] | None, ids: Sequence[str], group_by: Sequence[str]) -> DataFrame:
    """All cells more than 3 standard deviations from their column's mean."""
    cols = [c for c in _numbers(df, cols, group_by) if c not in ids]
    return _scored(df, cols, ids, group_by, MIN_VALUES).where(F.col("z") > Z_LIMIT)


def anomalies_zscore(df: DataFrame, cols: Sequence[str] | None = None, ids: Sequence[str] = (),
                     group_by: Sequence[str] = (), n: int = TOP_ANOMALIES) -> DataFrame:
    """(ids, column, value, z_score): more than 3 standard deviations from the mean, the
    n furthest over all columns (per group when grouped)."""
    cells = _far_cells(df, cols, ids, group_by)
    order = [F.desc("z"), F.col("column"), F.col("value"), *map(quoted, ids)]
    best = top_per(cells, group_by, order, n) if group_by else cells.orderBy(*order).limit(n)
    return best.select(*map(quoted, [*group_by, *ids]), "column", "value",
                       rounded(F.col("z"), 4).alias("z_score"))


def strong_correlations(df: DataFrame, cols: Sequence[str] | None = None,
                        group_by: Sequence[str] = ()) -> DataFrame:
    """(col_1, col_2, pearson, strength, direction) for |r| >= 0.5, strongest first."""
    r = F.col("correlation")
    found = correlations(df, cols, group_by).where(F.abs(r) >= MIN_CORRELATION)
    return found.orderBy(F.desc(F.abs(r)), "col_1", "col_2").select(
        *map(quoted, group_by), "col_1", "col_2", rounded(r, 4).alias("pearson"),
        F.when(F.abs(r) >= 0.8, "very_strong").when(F.abs(r) >= 0.6, "strong").otherwise("moderate")
        .alias("strength"),
        F.when(r > 0, "positive").otherwise("negative").alias("direction"))


def few_valued(df: DataFrame, cols: Sequence[str], limit: int) -> list[str]:
    """Columns that may have at most ``limit`` distinct values, from one sketch pass.

    Keeps everything up to twice the limit, far beyond the sketch's error at such
    counts; the exact test follows on the grouped result. It spares grouping columns
    of free text or keys.
    """
    if not cols:
        return []
    row = df.agg(*[F.approx_count_distinct(quoted(c)) for c in cols]).first()
    return [c for c, k in zip(cols, row) if k <= 2 * limit + 10]


def category_means(df: DataFrame, cats: Sequence[str], metrics: Sequence[str],
                   low: int, high: int, group_by: Sequence[str] = ()) -> DataFrame:
    """(group_by, cat_no, column, value, metric_no, metric, mean) for text columns with low to
    high distinct values (in the group), one grouped pass for all of them."""
    # per group there may be few values where the whole table has many
    cats = [c for c in cats if group_by or c in few_valued(df, cats, high)]
    keys = [quoted(g) for g in group_by]
    if not cats or not metrics:
        empty = df.limit(0).select(*keys)
        return empty.select(*keys, *[F.lit(None).cast(t).alias(n) for n, t in (
            ("cat_no", "int"), ("column", "string"), ("value", "string"), ("metric_no", "int"),
            ("metric", "string"), ("mean", "double"))])
    cells = F.array(*[F.struct(F.lit(i).alias("cat_no"), F.lit(c).alias("column"),
                               quoted(c).alias("value")) for i, c in enumerate(cats)])
    numbers = [as_double(quoted(m)).alias(f"m{j}") for j, m in enumerate(metrics)]
    long = df.select(*keys, *numbers, F.inline(cells)).where(F.col("value").isNotNull())
    per = long.groupBy(*keys, "cat_no", "column", "value").agg(
        *[mean_of(F.col(f"m{j}")).alias(f"m{j}") for j in range(len(metrics))])
    by = [*group_by, "column"]
    kept = per.groupBy(*map(quoted, by)).agg(F.count("*").alias("k")).where(F.col("k").between(low, high))
    per = same_keys(per, kept.drop("k"), by, small_right=not group_by)
    pairs = F.array(*[F.struct(F.lit(j).alias("metric_no"), F.lit(m).alias("metric"),
                               F.col(f"m{j}").alias("mean")) for j, m in enumerate(metrics)])
    return per.select(*keys, "cat_no", "column", "value", F.inline(pairs)).where("mean is not null")


def top_performers(df: DataFrame, cols: Sequence[str] | None = None,
                   metrics: Sequence[str] | None = None, group_by: Sequence[str] = ()) -> DataFrame:
    """(column, metric, category, value, rank): per text column with 2 to 50 values and each
    of the numeric columns (``metrics``, or else all), the 5 categories with the highest mean."""
    cats = list(cols or [c for c in columns_of(df, "text") if c not in group_by])
    metrics = list(metrics or _numbers(df, None, group_by))
    means = category_means(df, cats, metrics, 2, MAX_CATEGORIES, group_by)
    best = top_per(means, [*group_by, "column", "metric"], [F.desc("mean"), F.col("value")], TOP_CATEGORIES)
    return best.select(*map(quoted, group_by), "column", "metric", F.col("value").alias("category"),
                       rounded(F.col("mean"), 4).alias("value"), "rank")


def insight_counts(df: DataFrame, order_by: Sequence[str], group_by: Sequence[str] = ()) -> DataFrame:
    """(name, value): rows, columns, columns per kind, and how many trends, anomalies (all,
    not only those listed) and correlations were found; each of them for every group, 0 included."""
    keys = [quoted(g) for g in group_by]
    zero = F.lit(0).cast("bigint")
    sizes = {"columns": len(df.columns), **{
        f"{k}_columns": len([c for c in columns_of(df, k) if c not in group_by]) for k in ("numeric", "text", "date")}}
    found = {"trends": trends(df, order_by, group_by=group_by), "anomalies": _far_cells(df, None, (), group_by),
             "correlations": strong_correlations(df, group_by=group_by)}

    def counted(frame, name):
        marks = [F.lit(1 if n == name else 0).cast("bigint").alias(n) for n in ("rows", *found)]
        return frame.select(*keys, *marks)

    # one counter per finding next to the rows' own, summed in one aggregate
    base = df.groupBy(*keys).agg(F.count("*").alias("rows")).select(*keys, "rows", *[zero.alias(n) for n in found])
    for name, part in found.items():
        base = base.unionByName(counted(part, name))
    sums = base.groupBy(*keys).agg(*[F.coalesce(F.sum(n), zero).alias(n) for n in ("rows", *found)])
    facts = [("rows", F.col("rows")), *[(n, F.lit(v).cast("bigint")) for n, v in sizes.items()],
             *[(n, F.col(n)) for n in found]]
    return sums.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in facts])))


def insights(df: DataFrame, order_by: Sequence[str]) -> dict[str, DataFrame]:
    """All insight results, one lazy DataFrame each."""
    return {
        "trends": trends(df, order_by),
        "anomalies": anomalies_zscore(df),
        "correlations": strong_correlations(df),
        "top_performers": top_performers(df),
        "counts": insight_counts(df, order_by),
    }
