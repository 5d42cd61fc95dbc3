"""Data-quality checks and fixes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gridlore.functions.numeric import as_double, mean_of, number_from_text, percent, rounded
from gridlore.functions.schema import columns_of
from gridlore.plans.quantiles import column_quantiles
from gridlore.plans.shape import column_rows, key_counts, melt_numeric, quoted, same_keys, text_key

# Texts a spreadsheet shows for a failed formula.
ERROR_TOKENS = ("#REF!", "#DIV/0!", "#N/A", "#VALUE!", "#####", "#NULL!", "#NUM!", "#NAME?")

# Names of the fixes, in the order they are documented.
FIXES = ("remove_duplicates", "fill_missing_mean", "fill_missing_median", "fill_missing_mode",
         "drop_missing_high", "remove_outliers_iqr", "strip_whitespace",
         "drop_constant_columns")

ISSUE = ("type string, severity string, column string, metric string, value double, "
         "total bigint")


def _row(kind: str, severity, column, metric, value: Column, total: Column) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.lit(kind).alias("type"), as_col(severity).alias("severity"),
        as_col(column).cast("string").alias("column"), as_col(metric).alias("metric"),
        value.cast("double").alias("value"), total.cast("bigint").alias("total"))


def _issue(frame: DataFrame, *row) -> DataFrame:
    return frame.select(F.inline(F.array(_row(*row))))


def _none(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], ISSUE)


# Checks that need figures of single columns only share one pass over the table. Each is
# the figures it reads and the issue rows (null where all is well) made of them.


def _filled(c):
    return F.count(c)


def _missing_rows() -> list[Column]:
    gone = F.col("rows") - F.col("filled")
    pct = percent(gone, F.col("rows"))
    severity = F.when(pct > 50, "high").when(pct > 20, "medium").otherwise("low")
    return [F.when(gone > 0, _row("missing_values", severity, F.col("column"), "missing_pct", pct, F.col("rows")))]


def _negative_rows() -> list[Column]:
    pct = percent(F.col("neg"), F.col("values"))
    severity = F.when(pct > 5, "medium").otherwise("low")
    return [F.when(F.col("neg") > 0, _row("invalid_data", severity, F.col("column"), "negative_pct", pct, F.col("values")))]


def _token_rows() -> list[Column]:
    return [F.when(F.col(f"t{i}") > 0, _row("invalid_data", "high", F.col("column"), t, F.col(f"t{i}"), F.col("filled")))
            for i, t in enumerate(ERROR_TOKENS)]


def _constant_rows() -> list[Column]:
    distinct = F.when(F.col("filled") > 0, 1).otherwise(0)
    return [F.when(F.col("same") == 1, _row("constant_column", "low", F.col("column"), "distinct", distinct, F.col("rows")))]


_FIGURES = {
    "filled": _filled,
    "values": lambda c: F.count(as_double(c)),
    "neg": lambda c: F.count_if(as_double(c) < 0),
    "same": lambda c: F.coalesce((F.min(c) == F.max(c)).cast("int"), F.lit(1)),
    **{f"t{i}": (lambda c, t=t: F.count_if(c.contains(t))) for i, t in enumerate(ERROR_TOKENS)},
}
_TOKEN_FIGURES = [f"t{i}" for i in range(len(ERROR_TOKENS))]


def _column_issues(df: DataFrame, cols: Sequence[str], figures: Sequence[str], rows: Sequence[Column],
                   only: dict[str, Sequence[str]] | None = None) -> DataFrame:
    if not cols:
        return _none(df)
    stats = column_rows(df, cols, {f: _FIGURES[f] for f in figures}, extra={"rows": F.count("*")}, only=only)
    return stats.select(F.inline(F.array_compact(F.array(*rows))))


def check_missing(df: DataFrame) -> DataFrame:
    """Columns with nulls: % missing; above 50 high, above 20 medium."""
    return _column_issues(df, df.columns, ["filled"], _missing_rows())


def check_negatives(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Numeric columns with values below 0; above 5 % of the values medium."""
    return _column_issues(df, cols or columns_of(df, "numeric"), ["values", "neg"], _negative_rows())


def check_error_tokens(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Cells holding a spreadsheet error text, per column and token, taken literally."""
    return _column_issues(df, cols or columns_of(df, "text"), ["filled", *_TOKEN_FIGURES], _token_rows())


def check_constant(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Columns with at most one distinct value: smallest equals largest, no count needed."""
    return _column_issues(df, cols or df.columns, ["filled", "same"], _constant_rows())


def check_columns(df: DataFrame) -> DataFrame:
    """Missing cells, negatives, error tokens and constant columns in one pass."""
    numbers, texts = columns_of(df, "numeric"), columns_of(df, "text")
    only = {"values": numbers, "neg": numbers, **{t: texts for t in _TOKEN_FIGURES}}
    rows = [*_missing_rows(), *_negative_rows(), *_token_rows(), *_constant_rows()]
    return _column_issues(df, df.columns, list(_FIGURES), rows, only)


def check_duplicates(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier one (nulls equal); above 5 % medium.

    Copies collapse to one counted row in each task before the shuffle, in which a short key
    stands for a long text.
    """
    texts = set(columns_of(df, "text"))
    keys = [(text_key(quoted(c)) if c in texts else quoted(c)).alias(f"__k{i}") for i, c in enumerate(df.columns)]
    copies = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    stats = copies.agg(F.sum("__n").alias("rows"), F.sum(F.col("__n") - 1).alias("extra"))
    stats = stats.where("extra > 0")
    severity = F.when(F.col("extra") > F.col("rows") * 0.05, "medium").otherwise("low")
    return _issue(stats, "duplicates", severity, F.lit(None), "duplicate_rows",
                  F.col("extra"), F.col("rows"))


def iqr_bounds(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, n, q1, q3, lower, upper): the fences 1.5 IQR outside the quartiles."""
    q = column_quantiles(df, cols, [0.25, 0.75])
    reach = (F.col("q1") - F.col("q0")) * 1.5
    return q.select("column", "n", F.col("q0").alias("first"), F.col("q1").alias("third"),
                    (F.col("q0") - reach).alias("lower"), (F.col("q1") + reach).alias("upper"))


def check_outliers_iqr(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """% of values outside the fences (>= 10 values, IQR not 0); > 10 high, > 5 medium."""
    cols = cols or columns_of(df, "numeric")
    if not cols:
        return _none(df)
    bounds = iqr_bounds(df, cols).where("n >= 10 and first <> third")
    cells = same_keys(melt_numeric(df, cols), bounds, ["column"], small_right=True)
    out = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    stats = cells.groupBy("column").agg(F.count("*").alias("n"), F.count_if(out).alias("out"))
    stats = stats.where("out > 0").withColumn("pct", percent(F.col("out"), F.col("n")))
    severity = F.when(F.col("pct") > 10, "high").when(F.col("pct") > 5, "medium").otherwise("low")
    return _issue(stats, "outliers", severity, F.col("column"), "outlier_pct",
                  F.col("pct"), F.col("n"))


def distinct_per_column(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """(column, rows, filled, distinct). Exact (up to 128-bit hashes of long texts): values are
    grouped per column in one query and then counted, so no column's values meet in one task.
    ``approx`` uses a sketch."""
    if approx:
        return column_rows(df, cols, {"filled": lambda c: F.count(c),
                                      "distinct": lambda c: F.approx_count_distinct(c)},
                           extra={"rows": F.count("*")})
    base = column_rows(df, cols, {"filled": lambda c: F.count(c)}, extra={"rows": F.count("*")})
    per = key_counts(df, cols).groupBy("column").agg(F.count("*").alias("distinct"))
    return same_keys(base, per, ["column"], "left", small_right=True).withColumn(
        "distinct", F.coalesce("distinct", F.lit(0)))


def check_high_cardinality(df: DataFrame, cols: Sequence[str] | None = None,
                           approx: bool = False) -> DataFrame:
    """Text columns with more distinct values than max(50, half of the rows)."""
    cols = cols or columns_of(df, "text")
    if not cols:
        return _none(df)
    stats = distinct_per_column(df, cols, approx)
    many = F.col("distinct") > F.greatest(F.lit(50.0), F.col("rows") * 0.5)
    return _issue(stats.where(many), "high_cardinality", F.lit("low"), F.col("column"),
                  "distinct", F.col("distinct"), F.col("rows"))


def quality_report(df: DataFrame) -> DataFrame:
    """All checks together; those on single columns share one pass."""
    checks = (check_columns, check_duplicates, check_outliers_iqr, check_high_cardinality)
    return reduce(DataFrame.unionByName, [check(df) for check in checks])


# Fixes. Those that depend on the data first run one small aggregate when called and
# use its few numbers as literals, so the fixed table itself stays one narrow pass.


def remove_duplicates(df: DataFrame) -> DataFrame:
    """One of each set of equal rows."""
    return df.dropDuplicates()


def _one_row(df: DataFrame, exprs: dict[str, Column]) -> dict:
    if not exprs:
        return {}
    row = df.agg(*[e.alias(f"x{i}") for i, e in enumerate(exprs.values())]).first()
    return {name: row[i] for i, name in enumerate(exprs)}


def _with_fill(df: DataFrame, fill: dict[str, object]) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    filled = []
    for c in df.columns:
        value = fill.get(c)
        if value is None:
            filled.append(quoted(c))
        elif isinstance(value, float) and c in columns_of(df, "numeric"):
            whole = kinds[c].typeName() in ("byte", "short", "integer", "long")
            cell = as_double(quoted(c)) if whole else quoted(c)
            if kinds[c].typeName() in ("double", "float"):
                cell = as_double(quoted(c))
            filled.append(F.coalesce(cell, F.lit(value)).alias(c))
        else:
            filled.append(F.coalesce(quoted(c), F.lit(value)).alias(c))
    return df.select(*filled)


def fill_missing_mean(df: DataFrame) -> DataFrame:
    """Nulls of numeric columns become the mean (whole numbers turn double); in text
    columns with any number-like cell they become the mean of those, as text."""
    exprs = {c: F.when(F.count(as_double(quoted(c))) < F.count("*"), mean_of(as_double(quoted(c))))
             for c in columns_of(df, "numeric")}
    for c in columns_of(df, "text"):
        exprs[c] = F.when(F.count(quoted(c)) < F.count("*"),
                          mean_of(number_from_text(quoted(c))).cast("string"))
    return _with_fill(df, _one_row(df, exprs))


def fill_missing_median(df: DataFrame) -> DataFrame:
    """Nulls of numeric columns become the median."""
    cols = columns_of(df, "numeric")
    short = _one_row(df, {c: F.count(as_double(quoted(c))) < F.count("*") for c in cols})
    cols = [c for c in cols if short[c]]
    if not cols:
        return df
    rows = column_quantiles(df, cols, [0.5]).collect()
    return _with_fill(df, {r["column"]: r["q0"] for r in rows})


def fill_missing_mode(df: DataFrame) -> DataFrame:
    """Nulls of any column become its most frequent value, the smallest among ties."""
    gaps = _one_row(df, {c: F.count(quoted(c)) < F.count("*") for c in df.columns})
    fill: dict[str, object] = {}
    groups = ("numeric", "text", "date", "boolean")
    for cols in ([c for c in columns_of(df, kind) if gaps[c]] for kind in groups):
        for same in _by_type(df, cols):
            fill.update(_modes(df, same))
    return _with_fill(df, {c: v for c, v in fill.items()})


def _by_type(df: DataFrame, cols: Sequence[str]) -> list[list[str]]:
    types: dict[str, list[str]] = {}
    for c in cols:
        types.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    return list(types.values())


def _modes(df: DataFrame, cols: Sequence[str]) -> dict[str, object]:
    cells = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).alias("value")) for c in cols])
    counts = df.select(F.inline(cells)).where("value is not null").groupBy("column", "value").agg(
        F.count("*").alias("n"))
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("b"))
    return {r["column"]: r["b"]["value"] for r in best.collect()}


def drop_missing_high(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Without the columns of which more than half is null."""
    stats = _one_row(df, {"": F.count("*"), **{c: F.count(quoted(c)) for c in df.columns}})
    rows = stats.pop("")
    return df.drop(*[c for c, n in stats.items() if rows and (rows - n) / rows > threshold])


def remove_outliers_iqr(df: DataFrame) -> DataFrame:
    """Rows inside the fences in every numeric column; a null there drops the row."""
    cols = columns_of(df, "numeric")
    if not cols:
        return df
    tests = [quoted(r["column"]).cast("double").between(r["lower"], r["upper"])
             for r in iqr_bounds(df, cols).collect()]
    if len(tests) < len(cols):  # a column without any value lets no row pass
        return df.limit(0)
    return df.where(reduce(lambda a, b: a & b, tests))


def stripped(col: Column) -> Column:
    """Text without white space (tabs and line ends included) at either end."""
    return F.regexp_replace(F.regexp_replace(col, r"^\s+", ""), r"\s+$", "")


def strip_whitespace(df: DataFrame) -> DataFrame:
    """Trims text columns; a null stays null."""
    texts = set(columns_of(df, "text"))
    return df.select(*[stripped(quoted(c)).alias(c) if c in texts else quoted(c) for c in df.columns])


def drop_constant_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold at most one distinct value."""
    same = _one_row(df, {c: F.coalesce(F.min(quoted(c)) == F.max(quoted(c)), F.lit(True))
                         for c in df.columns})
    return df.drop(*[c for c, constant in same.items() if constant])


_STEPS = {
    "remove_duplicates": remove_duplicates,
    "fill_missing_mean": fill_missing_mean,
    "fill_missing_median": fill_missing_median,
    "fill_missing_mode": fill_missing_mode,
    "drop_missing_high": drop_missing_high,
    "remove_outliers_iqr": remove_outliers_iqr,
    "strip_whitespace": strip_whitespace,
    "drop_constant_columns": drop_constant_columns,
}


def _step(label: str):
    try:
        return _STEPS[label.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown fix {label!r}; known: {', '.join(FIXES)}") from None


def clean(df: DataFrame, fixes: Sequence[str]) -> DataFrame:
    """Applies the fixes in the order given."""
    for step in [_step(f) for f in fixes]:
        df = step(df)
    return df


def fix_report(df: DataFrame, fixes: Sequence[str]) -> DataFrame:
    """(step, fix, change, column, n): what each fix in turn did to the table.

    Changes: rows_removed, column_dropped, nulls_filled (cells), cells_stripped.
    """
    parts = []
    for number, label in enumerate(fixes, 1):
        after = _step(label)(df)
        name = label.strip().lower()
        parts.append(_changes(df, after, number, name))
        df = after
    out = reduce(DataFrame.unionByName, parts)
    return out.where("n > 0")


def _changes(before: DataFrame, after: DataFrame, number: int, fix: str) -> DataFrame:
    def named(frame, change):
        return frame.select(F.lit(number).alias("step"), F.lit(fix).alias("fix"),
                            F.lit(change).alias("change"), F.col("column"), F.col("n"))

    spark = before.sparkSession
    nothing = spark.createDataFrame([], "step int, fix string, change string, column string, n bigint")
    if fix in ("remove_duplicates", "remove_outliers_iqr"):
        left = after.agg(F.count("*")).scalar()
        gone = before.agg(F.count("*").alias("n")).select(
            F.lit(None).cast("string").alias("column"), (F.col("n") - left).alias("n"))
        return named(gone, "rows_removed")
    if fix in ("drop_missing_high", "drop_constant_columns"):
        dropped = [(c, 1) for c in before.columns if c not in after.columns]
        if not dropped:
            return nothing
        return named(spark.createDataFrame(dropped, "column string, n bigint"), "column_dropped")
    if fix == "strip_whitespace":
        cols = columns_of(before, "text")
        if not cols:
            return nothing
        cells = column_rows(before, cols, {"n": lambda c: F.count_if(stripped(c) != c)})
        return named(cells, "cells_stripped")
    holes = lambda frame, name: column_rows(frame, frame.columns, {
        name: lambda c: F.count("*") - F.count(c)}).select("column", name)
    both = same_keys(holes(before, "had"), holes(after, "has"), ["column"], small_right=True)
    return named(both.select("column", (F.col("had") - F.col("has")).alias("n")), "nulls_filled")
