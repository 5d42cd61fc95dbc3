"""Fraud rules: duplicates, timing, round numbers, first digits, small-table outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gridlore.functions.numeric import as_double, first_significant_digit, rounded
from gridlore.functions.schema import columns_of
from gridlore.operators.insights import _scored
from gridlore.plans.shape import column_rows, quoted, same_keys, top_per

# Fixed values of the rules.
BENFORD = {"1": 0.301, "2": 0.176, "3": 0.125, "4": 0.097, "5": 0.079, "6": 0.067, "7": 0.058,
           "8": 0.051, "9": 0.046}
BENFORD_MIN_VALUES = 50
BENFORD_TOLERANCE = 0.05
ROUND_THRESHOLDS = (100, 500, 1000, 5000, 10000, 50000, 100000)
ROUND_MIN_HITS = 3
NIGHT_FROM, NIGHT_TO = 22, 4
SMALL_TABLE_Z = 2.5
SMALL_TABLE_HIGH_Z = 3.5
POINTS_PER_ANOMALY, POINTS_PER_PATTERN = 5, 15
MIN_VALUES = 5


def anomalies_small(df: DataFrame, cols: Sequence[str] | None = None, ids: Sequence[str] = (),
                    group_by: Sequence[str] = ()) -> DataFrame:
    """(ids, column, value, score, severity): |z| > 2.5 among at least 3 values; the score is
    z/5 up to 1; above 3.5 high. Stands in for the isolation forest on tiny tables."""
    cols = [c for c in (cols or columns_of(df, "numeric")) if c not in (*ids, *group_by)]
    cells = _scored(df, cols, ids, group_by, 3).where(F.col("z") > SMALL_TABLE_Z)
    return cells.select(
        *map(quoted, [*group_by, *ids]), "column", "value",
        rounded(F.least(F.lit(1.0), F.col("z") / 5), 4).alias("score"),
        F.when(F.col("z") > SMALL_TABLE_HIGH_Z, "high").otherwise("medium").alias("severity"))


def duplicate_groups(df: DataFrame, cols: Sequence[str] | None = None,
                     skip_null_keys: bool = False) -> DataFrame:
    """(cols, count): sets of rows equal in the given columns (all by default)."""
    cols = list(cols or df.columns)
    rows = df.dropna(how="any", subset=cols) if skip_null_keys else df
    return rows.groupBy(*map(quoted, cols)).agg(F.count("*").alias("count")).where("count > 1")


def timing_patterns(df: DataFrame, dates: Sequence[str] | None = None,
                    group_by: Sequence[str] = ()) -> DataFrame:
    """(column, weekend, night, count): rows on Saturday or Sunday, and from 22:00 to 04:59
    when the column holds more than one time of day; the first date column with hits, of those given or else of all.
    """
    dates = list(dates) if dates else columns_of(df, "date")
    clock = lambda c: F.pmod(F.unix_micros(c.cast("timestamp")), F.lit(86_400_000_000))
    late = lambda c: (F.hour(c) >= NIGHT_FROM) | (F.hour(c) <= NIGHT_TO)
    stats = column_rows(df, dates, {
        "n": lambda c: F.count(c),
        "weekend": lambda c: F.count_if(F.weekday(c) >= 5),
        "__night": lambda c: F.count_if(late(c)),
        "__timed": lambda c: F.min(clock(c)) != F.max(clock(c)),
    }, group_by).where(F.col("n") >= MIN_VALUES)
    stats = stats.withColumn("night", F.when(F.col("__timed"), F.col("__night")).otherwise(0).cast("bigint"))
    stats = stats.withColumn("count", F.col("weekend") + F.col("night")).where("count > 0")
    first = F.min_by(F.struct("column", "weekend", "night", "count"), "column_no").alias("p")
    return stats.groupBy(*map(quoted, group_by)).agg(first).where("p is not null").select(
        *map(quoted, group_by), "p.*")


def timing_examples(df: DataFrame, date: str, n: int = 5) -> DataFrame:
    """(kind, at): the n earliest weekend rows and the n earliest night rows."""
    at = quoted(date).cast("timestamp")
    rows = df.where(at.isNotNull()).select(at.alias("at"))
    weekend = rows.where(F.weekday("at") >= 5).orderBy("at").limit(n)
    night = rows.where((F.hour("at") >= NIGHT_FROM) | (F.hour("at") <= NIGHT_TO)).orderBy("at").limit(n)
    return weekend.select(F.lit("weekend").alias("kind"), "at").unionByName(
        night.select(F.lit("night").alias("kind"), "at"))


def round_numbers(df: DataFrame, cols: Sequence[str] | None = None,
                  group_by: Sequence[str] = ()) -> DataFrame:
    """(column, threshold, count): values that are multiples of 100, 500, ... 100000, at
    least 3 of them. All columns and thresholds are counted in one pass."""
    cols = [c for c in (cols or columns_of(df, "numeric")) if c not in group_by]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, threshold bigint, count bigint")
    stats = column_rows(df, cols, {
        "n": lambda c: F.count(as_double(c)),
        **{f"t{t}": (lambda c, t=t: F.count_if((as_double(c) >= t) & (as_double(c) % F.lit(float(t)) == 0)))
           for t in ROUND_THRESHOLDS},
    }, group_by).where(F.col("n") >= MIN_VALUES)
    hits = F.array(*[F.struct(F.lit(t).cast("bigint").alias("threshold"), F.col(f"t{t}").alias("count"))
                     for t in ROUND_THRESHOLDS])
    return stats.select(*map(quoted, group_by), "column", F.inline(hits)).where(
        F.col("count") >= ROUND_MIN_HITS)


def benford(df: DataFrame, cols: Sequence[str] | None = None, group_by: Sequence[str] = (),
            only_deviant: bool = False) -> DataFrame:
    """(column, digit, n, actual, expected, deviation, deviant): shares of the first
    significant digits of positive values (at least 50) against the fixed table; a digit
    more than 0.05 off is deviant. A digit that never occurs has share 0. Without ``cols``
    all numeric columns are taken."""
    if cols is None:
        cols = [c for c in columns_of(df, "numeric") if c not in group_by]
    digits = df.select(*map(quoted, group_by), *[
        F.when(as_double(quoted(c)) > 0, first_significant_digit(as_double(quoted(c)))).alias(c) for c in cols])
    stats = column_rows(digits, cols, {
        "total": lambda c: F.count_if(c != ""),
        **{f"d{d}": (lambda c, d=d: F.count_if(c == d)) for d in BENFORD},
    }, group_by).where(F.col("total") >= BENFORD_MIN_VALUES)
    rows = F.array(*[F.struct(F.lit(d).alias("digit"), F.col(f"d{d}").alias("n"), F.lit(e).alias("expected"))
                     for d, e in BENFORD.items()])
    out = stats.select(*map(quoted, group_by), "column", "total", F.inline(rows))
    share = F.col("n").cast("double") / F.col("total")
    off = F.abs(share - F.col("expected"))
    out = out.select(
        *map(quoted, group_by), "column", "digit", "n", rounded(share, 4).alias("actual"), "expected",
        rounded(off, 4).alias("deviation"), (off > BENFORD_TOLERANCE).alias("deviant"))
    return out.where("deviant") if only_deviant else out


def suspicious_patterns(df: DataFrame, group_by: Sequence[str] = (),
                        dates: Sequence[str] | None = None,
                        numbers: Sequence[str] | None = None) -> DataFrame:
    """(pattern, column, count): one row per pattern found. Duplicates count the sets of
    equal rows, round numbers the (column, threshold) pairs, first digits the deviant
    digits of a column."""
    keys = [quoted(g) for g in group_by]

    def found(frame, pattern, column, count):
        return frame.select(*keys, F.lit(pattern).alias("pattern"), column.cast("string").alias("column"),
                            count.cast("bigint").alias("count"))

    none = F.lit(None)
    sets = duplicate_groups(df, skip_null_keys=True).groupBy(*keys).agg(F.count("*").alias("k"))
    parts = [found(sets.where("k > 0"), "duplicate_rows", none, F.col("k"))]
    if dates or columns_of(df, "date"):
        timing = timing_patterns(df, dates, group_by)
        parts.append(found(timing, "unusual_timing", F.col("column"), F.col("count")))
    if numbers or [c for c in columns_of(df, "numeric") if c not in group_by]:
        rounds = round_numbers(df, numbers, group_by).groupBy(*keys).agg(F.count("*").alias("k"))
        parts.append(found(rounds.where("k > 0"), "round_numbers", none, F.col("k")))
        off = benford(df, numbers, group_by, only_deviant=True).groupBy(*keys, "column").agg(
            F.count("*").alias("k"))
        parts.append(found(off, "first_digits", F.col("column"), F.col("k")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fraud_score(anomalies: DataFrame, patterns: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """(anomalies, patterns, fraud_score): min(100, 5 per anomaly + 15 per pattern found)."""
    keys = [quoted(g) for g in group_by]
    zero = F.lit(0).cast("bigint")
    hits = anomalies.select(*keys, F.lit(1).cast("bigint").alias("a"), zero.alias("p")).unionByName(
        patterns.where("count > 0").select(*keys, zero.alias("a"), F.lit(1).cast("bigint").alias("p")))
    out = hits.groupBy(*keys).agg(F.coalesce(F.sum("a"), zero).alias("anomalies"),
                                  F.coalesce(F.sum("p"), zero).alias("patterns"))
    score = F.col("anomalies") * POINTS_PER_ANOMALY + F.col("patterns") * POINTS_PER_PATTERN
    return out.withColumn("fraud_score", F.least(F.lit(100.0), score.cast("double")))


def fraud(df: DataFrame, seed: int = 42) -> dict[str, DataFrame]:
    """Anomalies (isolation forest, or z-scores below 5 rows), patterns and the score."""
    from gridlore.operators.isolation import isolation_results

    out = {"patterns": suspicious_patterns(df)}
    if columns_of(df, "numeric"):
        # the list is cut to its top rows, the score is not
        out["anomalies"], every = isolation_results(df, seed=seed)
        out["score"] = fraud_score(every, out["patterns"])
    return out
