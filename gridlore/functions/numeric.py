"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
WHOLE_PATTERN = r"^\s*[+-]?\d+\s*$"
#: Usual date forms beside ISO, in order of preference, and what their texts look like.
USUAL_DATES = {
    "M/d/yyyy": r"\d{1,2}/\d{1,2}/\d{4}",
    "d/M/yyyy": r"\d{1,2}/\d{1,2}/\d{4}",
    "d.M.yyyy": r"\d{1,2}\.\d{1,2}\.\d{4}",
    "yyyy/M/d": r"\d{4}/\d{1,2}/\d{1,2}",
}


def rounded(col: Column, digits: int) -> Column:
    """Half-up rounding of a double, without noise from its binary tail.

    The detour over DECIMAL(38,10) makes 1.00499999999999989 round like 1.005. Values
    too large for it keep the plain double rounding.
    """
    exact = F.round(col.try_cast("decimal(38,10)"), digits).cast("double")
    return F.coalesce(exact, F.round(col.cast("double"), digits))


def mean_of(col: Column) -> Column:
    """Average as exact-sum / count (``avg`` of a decimal would cut to a few digits)."""
    return F.try_divide(F.sum(col).cast("double"), F.count(col).cast("double"))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, rounded; null for a zero denominator."""
    return rounded(F.try_divide(part.cast("double") * 100.0, whole.cast("double")), digits)


def number_from_text(col: Column) -> Column:
    """Text to double; anything that is not a plain number becomes null."""
    return F.when(col.rlike(NUMBER_PATTERN), F.trim(col).try_cast("double"))


def whole_from_text(col: Column) -> Column:
    """Text to bigint; null for anything else, also for what needs more than 64 bits."""
    return F.when(col.rlike(WHOLE_PATTERN), F.trim(col).try_cast("bigint"))


def usual_time(col: Column, form: str) -> Column:
    """Text to timestamp by one of ``USUAL_DATES``, with or without a time of day."""
    shape = rf"^\s*{USUAL_DATES[form]}( \d{{1,2}}:\d{{2}}(:\d{{2}})?)?\s*$"
    return F.when(col.rlike(shape), F.try_to_timestamp(F.trim(col), F.lit(f"{form}[ H:mm[:ss]]")))


def time_from_text(col: Column, formats: tuple[str, ...] = ()) -> Column:
    """Text to timestamp: ISO forms first, then the given patterns in order."""
    tries = [F.trim(col).try_cast("timestamp")]
    tries += [F.try_to_timestamp(F.trim(col), F.lit(fmt)) for fmt in formats]
    return F.coalesce(*tries)


def as_double(col: Column) -> Column:
    """Double with NaN turned into null, so that counts and comparisons skip it."""
    d = col.cast("double")
    return F.when(~F.isnan(d), d)


def without_nan(df: DataFrame, col: Column, name: str) -> Column:
    """The column, NaN turned null if it is a floating one."""
    floating = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    return F.when(~F.isnan(col), col) if floating else col


def sample_skew(col: Column) -> Column:
    """Bias-corrected skewness (Spark's own is the population form)."""
    n = F.count(col).cast("double")
    return F.when(n > 2, F.skewness(col) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(col: Column) -> Column:
    """Bias-corrected excess kurtosis."""
    n = F.count(col).cast("double")
    return F.when(
        n > 3,
        F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(col) + 6),
    )


def first_significant_digit(col: Column) -> Column:
    """Leading non-zero digit of a number, right for 0.004 and 1.0E-5 too."""
    return F.regexp_extract(col.cast("string"), "[1-9]", 0)


def grade(value: Column, *steps: tuple[float, str], otherwise: str) -> Column:
    """First label whose bound the value exceeds, bounds given from high to low."""
    out = None
    for bound, label in steps:
        test = value > F.lit(bound)
        out = F.when(test, label) if out is None else out.when(test, label)
    return F.when(value.isNotNull(), out.otherwise(otherwise))
