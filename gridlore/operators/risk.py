"""Risk scoring: four dimensions, weighted to one score, for a table or per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gridlore.functions.numeric import as_double, mean_of, rounded
from gridlore.functions.schema import columns_of
from gridlore.plans.position import position_trend
from gridlore.plans.shape import column_rows, melt_numeric, quoted, same_keys, top_per, value_counts

# Fixed values of the rules.
WEIGHTS = {"volatility": 0.3, "concentration": 0.25, "trend": 0.25, "missing": 0.2}
HIGH_VARIATION = 0.5
LEVELS = ((75.0, "critical"), (50.0, "high"), (25.0, "medium"))


def _names(cond, name):
    """Sorted list of names as one text; at most one name per column of the table."""
    return F.concat_ws(",", F.array_sort(F.collect_set(F.when(cond, name))))


def _dimension(frame: DataFrame, keys, name: str) -> DataFrame:
    return frame.select(*keys, F.lit(name).alias("name"), rounded(F.col("score"), 2).alias("score"),
                        F.lit(WEIGHTS[name]).alias("weight"), "reason")


def _all_groups(df: DataFrame, found: DataFrame, group_by: Sequence[str]) -> DataFrame:
    """Groups without a finding score 0 (with no group, an empty table gives no row)."""
    if not group_by:
        return found
    keys = [quoted(g) for g in group_by]
    every = df.groupBy(*keys).agg(F.count("*").alias("__rows"))
    out = same_keys(every, found, group_by, "left")
    return out.select(*keys, F.coalesce("score", F.lit(0.0)).alias("score"),
                      F.coalesce("reason", F.lit("")).alias("reason"))


def volatility_risk(df: DataFrame, cols: Sequence[str] | None = None,
                    group_by: Sequence[str] = ()) -> DataFrame:
    """100 x the largest coefficient of variation (>= 5 values), up to 100; the reason lists
    the columns above 0.5."""
    cols = list(cols or [c for c in columns_of(df, "numeric") if c not in group_by])
    keys = [quoted(g) for g in group_by]
    stats = column_rows(df, cols, {
        "n": lambda c: F.count(as_double(c)), "m": lambda c: mean_of(as_double(c)),
        "s": lambda c: F.stddev_samp(as_double(c))}, group_by)
    cv = F.when((F.col("n") >= 5) & (F.col("m") != 0) & (F.col("s") > 0), F.col("s") / F.abs("m"))
    out = stats.withColumn("cv", cv).groupBy(*keys).agg(
        F.least(F.lit(100.0), F.coalesce(F.max("cv"), F.lit(0.0)) * 100).alias("score"),
        _names(F.col("cv") > HIGH_VARIATION, F.col("column")).alias("reason"))
    return _dimension(out, keys, "volatility")


def concentration_risk(df: DataFrame, cols: Sequence[str] | None = None,
                       group_by: Sequence[str] = ()) -> DataFrame:
    """Per text column (>= 10 values, >= 2 distinct): share of the top value if above .5, as
    %, else 80 x share of the top three if above .8; the largest over the columns."""
    cols = list(cols or [c for c in columns_of(df, "text") if c not in group_by])
    keys = [quoted(g) for g in group_by]
    by = [*group_by, "column"]
    counts = value_counts(df, cols, group_by)
    whole = counts.groupBy(*map(quoted, by)).agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    top = top_per(counts, by, [F.desc("n"), F.col("value")], 3)
    top = top.groupBy(*map(quoted, by)).agg(F.max("n").alias("first"), F.sum("n").alias("three"))
    both = same_keys(top, whole, by, small_right=not group_by)
    one, three = F.col("first") / F.col("total"), F.col("three") / F.col("total")
    score = F.when(one > 0.5, one * 100).when(three > 0.8, three * 80)
    score = F.when((F.col("total") >= 10) & (F.col("k") >= 2), score)
    out = both.withColumn("s", score).groupBy(*keys).agg(
        F.least(F.lit(100.0), F.coalesce(F.max("s"), F.lit(0.0))).alias("score"),
        _names(F.col("s").isNotNull(), F.col("column")).alias("reason"))
    return _dimension(_all_groups(df, out, group_by), keys, "concentration")


def trend_risk(df: DataFrame, dates: Sequence[str] | None = None, cols: Sequence[str] | None = None,
               group_by: Sequence[str] = (), tie_break: Sequence[str] = ()) -> DataFrame:
    """Slope over date order of the numeric columns and dates given, or else of all: a decline of more than 10 % of the mean scores twice the decline, up to 100. Rows of
    one date come in the order of ``tie_break`` (unique, if given), else of the value."""
    dates = list(dates) if dates else columns_of(df, "date")
    cols = list(cols) if cols else [c for c in columns_of(df, "numeric") if c not in group_by]
    keys = [quoted(g) for g in group_by]
    fits = None
    for date in dates:
        ids = [*group_by, date, *[t for t in tie_break if t not in group_by]]
        cells = melt_numeric(df.where(quoted(date).isNotNull()), cols, ids)
        order = [date, *[t for t in tie_break if t != date], "value"]
        fit = position_trend(cells, [*group_by, "column"], order, "value", ties=not tie_break)
        fits = fit if fits is None else fits.unionByName(fit)
    drop = F.col("slope") * F.col("n") / F.abs("mean") * 100
    drop = F.when((F.col("n") >= 5) & ~F.col("flat") & (F.col("mean") != 0), drop)
    s = F.when(F.col("d") < -10, F.least(F.lit(100.0), F.abs("d") * 2))
    out = fits.withColumn("d", drop).withColumn("s", s).groupBy(*keys).agg(
        F.coalesce(F.max("s"), F.lit(0.0)).alias("score"),
        _names(F.col("s").isNotNull(), F.col("column")).alias("reason"))
    return _dimension(_all_groups(df, out, group_by), keys, "trend")


def missing_risk(df: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """2 x % of null cells, up to 100; the reason lists the columns above 20 %."""
    cols = [c for c in df.columns if c not in group_by]
    keys = [quoted(g) for g in group_by]
    stats = column_rows(df, cols, {"filled": lambda c: F.count(c)}, group_by,
                        extra={"rows": F.count("*")})
    gone = F.col("rows") - F.col("filled")
    out = stats.groupBy(*keys).agg(
        F.least(F.lit(100.0), F.try_divide(F.sum(gone) * 100.0, F.sum("rows").cast("double")) * 2)
        .alias("score"),
        _names(gone * 100.0 > F.col("rows") * 20.0, F.col("column")).alias("reason"))
    out = out.withColumn("score", F.coalesce("score", F.lit(0.0)))
    return _dimension(out, keys, "missing")


def risk_dimensions(df: DataFrame, group_by: Sequence[str] = (), tie_break: Sequence[str] = ()) -> DataFrame:
    """(name, score, weight, reason) of the dimensions. One without suitable columns
    scores 0, as it still counts in the weighted mean."""
    numbers = [c for c in columns_of(df, "numeric") if c not in group_by]
    texts = [c for c in columns_of(df, "text") if c not in group_by]
    dates = columns_of(df, "date")
    keys = [quoted(g) for g in group_by]

    def zero(name):
        blank = df.groupBy(*keys).agg(F.lit(0.0).alias("score"), F.lit("").alias("reason"))
        return _dimension(blank, keys, name)

    parts = [
        volatility_risk(df, numbers, group_by) if numbers else zero("volatility"),
        concentration_risk(df, texts, group_by) if texts else zero("concentration"),
        trend_risk(df, dates, numbers, group_by, tie_break) if dates and numbers else zero("trend"),
        missing_risk(df, group_by),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def risk_score(dimensions: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """(overall_score, risk_level): weighted mean of the dimensions within 0 to 100."""
    keys = [quoted(g) for g in group_by]
    mean = F.try_divide(F.sum(F.col("score") * F.col("weight")), F.sum("weight"))
    out = dimensions.groupBy(*keys).agg(
        rounded(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(mean, F.lit(0.0)))), 2)
        .alias("overall_score"))
    level = F.lit("low")
    for bound, name in reversed(LEVELS):
        level = F.when(F.col("overall_score") >= bound, name).otherwise(level)
    return out.withColumn("risk_level", level)


def risk(df: DataFrame, group_by: Sequence[str] = (), tie_break: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The dimensions and the overall score."""
    dimensions = risk_dimensions(df, group_by, tie_break)
    return {"dimensions": dimensions, "score": risk_score(dimensions, group_by)}
