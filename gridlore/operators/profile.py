"""Aggregation and profiling of whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from gridlore.functions.numeric import (
    as_double, mean_of, percent, rounded, sample_kurtosis, sample_skew,
)
from gridlore.functions.schema import columns_of
from gridlore.plans.gram import pair_correlations
from gridlore.plans.quantiles import column_quantiles
from gridlore.plans.shape import column_rows, key_counts, quoted, same_keys, top_per, top_texts, value_counts
from gridlore.session import pin

#: Columns whose pairs are aggregated side by side.
FEW_COLUMNS = 12
AGGREGATES = {
    "sum": F.sum, "mean": mean_of, "count": F.count, "min": F.min, "max": F.max,
    "std": F.stddev_samp, "var": F.var_samp,
}


def group_agg(df: DataFrame, key: str, col: str, fn: str = "sum") -> DataFrame:
    """(key, col): one aggregate per key, sorted by key."""
    return df.groupBy(quoted(key)).agg(AGGREGATES[fn](quoted(col)).alias(col)).orderBy(quoted(key))


def top_values(df: DataFrame, cols: Sequence[str] | None = None, n: int = 10) -> DataFrame:
    """(column, value, count, rank): the n most frequent non-null values per text column."""
    best = top_texts(df, list(cols or columns_of(df, "text")), n)
    return best.select("column", "value", F.col("n").alias("count"), "rank")


def value_distribution(df: DataFrame, cols: Sequence[str] | None = None, n: int = 20) -> DataFrame:
    """(column, value, count, pct): as ``top_values`` with the share of non-null cells."""
    cols = list(cols or columns_of(df, "text"))
    totals = column_rows(df, cols, {"__total": lambda c: F.count(c)}).select("column", "__total")
    best = top_texts(df, cols, n)
    return same_keys(best, totals, ["column"], small_right=True).select(
        "column", "value", F.col("n").alias("count"),
        percent(F.col("n"), F.col("__total")).alias("pct"),
    )


def numeric_summary(df: DataFrame, cols: Sequence[str] | None = None,
                    group_by: Sequence[str] = (), accuracy: int | None = None) -> DataFrame:
    """(column, count, mean, std, min, max, p25, median, p75) per numeric column."""
    cols = cols or [c for c in columns_of(df, "numeric") if c not in group_by]
    basic = column_rows(df, cols, {
        "count": lambda c: F.count(as_double(c)),
        "mean": lambda c: mean_of(as_double(c)),
        "std": lambda c: F.stddev_samp(as_double(c)),
        "min": lambda c: F.min(as_double(c)),
        "max": lambda c: F.max(as_double(c)),
    }, group_by)
    q = column_quantiles(df, cols, [0.25, 0.5, 0.75], group_by, accuracy)
    q = q.select(*map(quoted, group_by), "column", F.col("q0").alias("p25"),
                 F.col("q1").alias("median"), F.col("q2").alias("p75"))
    return same_keys(basic, q, [*group_by, "column"], "left", small_right=not group_by).select(
        *map(quoted, group_by), "column", "count",
        *[rounded(F.col(c), 4).alias(c)
          for c in ("mean", "std", "min", "max", "p25", "median", "p75")],
    )


def correlations(df: DataFrame, cols: Sequence[str] | None = None,
                 group_by: Sequence[str] = ()) -> DataFrame:
    """(col_1, col_2, correlation): Pearson over rows where both are present.

    One pass over the rows; pairs without a result drop out. The pairs of a few columns are
    aggregated side by side, those of many by Gram matrices, whose plan does not grow.
    """
    cols = list(cols or [c for c in columns_of(df, "numeric") if c not in group_by])
    pairs = list(combinations(cols, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "col_1 string, col_2 string, correlation double")
    if len(cols) > FEW_COLUMNS:
        name = F.array(*map(F.lit, cols))
        return pair_correlations(df, cols, group_by).select(
            *map(quoted, group_by), name[F.col("i")].alias("col_1"), name[F.col("j")].alias("col_2"), F.col("r").alias("correlation"))
    aggs = []
    for i, (a, b) in enumerate(pairs):
        x, y = as_double(quoted(a)), as_double(quoted(b))
        # not F.corr, which raises on a constant column in ANSI mode
        spread = [F.stddev_pop(F.when(y.isNotNull(), x)), F.stddev_pop(F.when(x.isNotNull(), y))]
        aggs.append(F.try_divide(F.covar_pop(x, y), spread[0] * spread[1]).alias(f"r{i}"))
    rows = F.array(*[
        F.struct(F.lit(a).alias("col_1"), F.lit(b).alias("col_2"), F.col(f"r{i}").alias("correlation"))
        for i, (a, b) in enumerate(pairs)
    ])
    wide = df.groupBy(*map(quoted, group_by)).agg(*aggs)
    out = wide.select(*map(quoted, group_by), F.inline(rows))
    return out.where(F.col("correlation").isNotNull() & ~F.isnan("correlation"))


def _text_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, unique, top, top_freq): distinct values and the most frequent one."""
    counts = pin(key_counts(df, cols))
    unique = counts.groupBy("column").agg(F.count("*").alias("unique"))
    top = top_texts(df, cols, 1, counts).select("column", F.col("value").alias("top"), F.col("n").alias("top_freq"))
    return same_keys(unique, top, ["column"], small_right=True)


def table_statistics(df: DataFrame) -> DataFrame:
    """One row per column: type, missing cells, numeric figures or text figures."""
    texts, numbers = columns_of(df, "text"), columns_of(df, "numeric")
    kinds = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, t)])
    out = column_rows(df, df.columns, {"filled": lambda c: F.count(c)},
                      extra={"row_count": F.count("*")})
    out = out.select(
        "column", kinds[F.col("column")].alias("dtype"), "row_count",
        (F.col("row_count") - F.col("filled")).alias("missing"),
    )
    if numbers:
        out = same_keys(out, numeric_summary(df, numbers), ["column"], "left", small_right=True)
    if texts:
        out = same_keys(out, _text_summary(df, texts), ["column"], "left", small_right=True)
    return out


def summary_statistics(df: DataFrame) -> dict[str, DataFrame]:
    """Results ``columns``, ``numeric``, ``categorical`` and ``correlation``."""
    texts, numbers = columns_of(df, "text"), columns_of(df, "numeric")
    kinds = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, t)])
    filled = column_rows(df, df.columns, {"filled": lambda c: F.count(c)},
                         extra={"rows": F.count("*")})
    gone = F.col("rows") - F.col("filled")
    out = {"columns": filled.select(
        "column", kinds[F.col("column")].alias("dtype"), "rows", gone.alias("missing"),
        F.coalesce(percent(gone, F.col("rows")), F.lit(0.0)).alias("missing_pct"),
    )}
    if numbers:
        out["numeric"] = _describe(df, numbers)
    if texts:
        out["categorical"] = categorical_summary(df, texts)
    if len(numbers) >= 2:
        r = correlations(df, numbers)
        out["correlation"] = r.withColumn("correlation", rounded(F.col("correlation"), 4))
    return out


def _describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    basic = column_rows(df, cols, {
        "count": lambda c: F.count(as_double(c)),
        "mean": lambda c: mean_of(as_double(c)),
        "std": lambda c: F.stddev_samp(as_double(c)),
        "min": lambda c: F.min(as_double(c)),
        "max": lambda c: F.max(as_double(c)),
        "skew": lambda c: sample_skew(as_double(c)),
        "kurtosis": lambda c: sample_kurtosis(as_double(c)),
    })
    names = ("p5", "p25", "p50", "p75", "p95")
    q = column_quantiles(df, cols, [0.05, 0.25, 0.5, 0.75, 0.95])
    q = q.select("column", *[F.col(f"q{i}").alias(n) for i, n in enumerate(names)])
    figures = ("mean", "std", "min", *names, "max", "skew", "kurtosis")
    return same_keys(basic, q, ["column"], "left", small_right=True).select(
        "column", "count", *[rounded(F.col(c), 4).alias(c) for c in figures])


def categorical_summary(df: DataFrame, cols: Sequence[str] | None = None, n: int = 10) -> DataFrame:
    """(column, unique_count, missing_count, value, count, rank): top n, null counted too."""
    cols = cols or columns_of(df, "text")
    counts = value_counts(df, cols, keep_null=True)
    whole = counts.groupBy("column").agg(
        F.count("value").alias("unique_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing_count"),
    )
    best = top_per(counts, ["column"], [F.desc("n"), F.asc_nulls_last("value")], n)
    return same_keys(best, whole, ["column"], small_right=True).select(
        "column", "unique_count", "missing_count", "value", F.col("n").alias("count"), "rank")


def dataset_insights(df: DataFrame) -> DataFrame:
    """(code, column, text, value, value_2, value_3, value_4), the facts worth telling:

    rows_columns, missing (cells, %), duplicates (rows, %), range (min, max, mean,
    median), skewed_right / skewed_left (skewness), constant_text, few_values (distinct,
    most common), many_values (distinct), period (first and last day).
    """
    texts, numbers, dates = (columns_of(df, k) for k in ("text", "numeric", "date"))

    def fact(code, column=None, text=None, values=()):
        cells = [F.lit(None).cast("double") if v is None else v.cast("double") for v in values]
        cells += [F.lit(None).cast("double")] * (4 - len(cells))
        return F.struct(
            code.alias("code") if not isinstance(code, str) else F.lit(code).alias("code"),
            (F.lit(None).cast("string") if column is None else column).alias("column"),
            (F.lit(None).cast("string") if text is None else text).alias("text"),
            *[c.alias(n) for c, n in zip(cells, ("value", "value_2", "value_3", "value_4"))],
        )

    def rows_of(frame, *facts):
        return frame.select(F.inline(F.array_compact(F.array(*facts))))

    width = len(df.columns)
    filled = column_rows(df, df.columns, {"filled": lambda c: F.count(c)},
                         extra={"rows": F.count("*")})
    whole = filled.agg(F.max("rows").alias("rows"),
                       F.sum(F.col("rows") - F.col("filled")).alias("gone"))
    whole = whole.where("rows > 0")
    parts = [rows_of(
        whole, fact("rows_columns", values=[F.col("rows"), F.lit(width)]),
        fact("missing", values=[F.col("gone"), percent(F.col("gone"), F.col("rows") * width, 1)]),
    )]
    copies = df.groupBy(*map(quoted, df.columns)).agg(F.count("*").alias("__n")).agg(
        F.sum("__n").alias("rows"), F.sum(F.col("__n") - 1).alias("extra"))
    parts.append(rows_of(copies.where("extra > 0"), fact(
        "duplicates", values=[F.col("extra"), percent(F.col("extra"), F.col("rows"), 1)])))
    if numbers:
        stats = _describe(df, numbers).where("count > 0")
        skew = F.col("skew")
        parts.append(rows_of(
            stats,
            fact("range", F.col("column"),
                 values=[F.col(c) for c in ("min", "max", "mean", "p50")]),
            F.when(F.abs(skew) > 1, fact(
                F.when(skew > 0, "skewed_right").otherwise("skewed_left"), F.col("column"),
                values=[skew])),
        ))
    if texts:
        stats = same_keys(
            filled.where(F.col("column").isin(*texts)).select("column"),
            _text_summary(df, texts), ["column"], "left", small_right=True)
        k = F.coalesce(F.col("unique"), F.lit(0))
        parts.append(rows_of(stats, fact(
            F.when(k <= 1, "constant_text").when(k < 20, "few_values").otherwise("many_values"),
            F.col("column"), F.when((k > 1) & (k < 20), F.col("top")), [k])))
    if dates:
        span = column_rows(df, dates, {
            "first": lambda c: F.date_format(F.min(c), "yyyy-MM-dd"),
            "last": lambda c: F.date_format(F.max(c), "yyyy-MM-dd")}).where("first is not null")
        parts.append(rows_of(span, fact("period", F.col("column"),
                                        F.concat_ws("/", "first", "last"))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def table_dimensions(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, columns, rows, max_column, max_value): size of each table and the maximum
    of its first numeric column."""
    out = None
    for name, df in tables.items():
        numbers = columns_of(df, "numeric")
        top = F.max(as_double(quoted(numbers[0]))) if numbers else F.lit(None).cast("double")
        row = df.agg(F.count("*").alias("rows"), top.alias("max_value")).select(
            F.lit(name).alias("table"), F.lit(len(df.columns)).cast("bigint").alias("columns"), "rows",
            F.lit(numbers[0] if numbers else None).cast("string").alias("max_column"), "max_value")
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no tables")
    return out
