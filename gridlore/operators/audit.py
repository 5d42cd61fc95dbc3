"""Audit of several tables at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridlore.functions.numeric import as_double
from gridlore.functions.schema import columns_of, has_keyword
from gridlore.plans.position import in_chunks
from gridlore.plans.shape import column_rows, measured_join, quoted
from gridlore.session import pin

# Names of columns that should not be negative, error texts, bounds.
NON_NEGATIVE_NAMES = (
    "qty", "quantity", "count", "total", "sum", "amount", "price", "cost", "revenue", "profit",
    "age", "year", "month", "day", "hour", "percentage", "rate", "score", "id", "index",
    "number", "unit", "size", "length",
)
ERROR_PATTERNS = (
    ("ref", r"#REF!"), ("div_zero", r"#DIV/0!"), ("not_available", r"#N/A"),
    ("value", r"#VALUE!"), ("narrow_column", r"^#{5,}"), ("null", r"#NULL!"),
    ("num", r"#NUM!"), ("name", r"#NAME\?"),
)
HEADER_SYMBOLS = r"""[ #@!$%^&*()+=\[\]{}|\\;:'",.<>/?~`]"""
LONGEST_GAP = 20

ISSUE = ("severity string, category string, sheet string, column string, row_from bigint, "
         "row_to bigint, n bigint")


def _row(severity: str, category, sheet, column=None, row_from=None, row_to=None, n=None) -> Column:
    def cell(v, kind):
        if v is None:
            return F.lit(None).cast(kind)
        return (v if isinstance(v, Column) else F.lit(v)).cast(kind)

    return F.struct(
        F.lit(severity).alias("severity"), cell(category, "string").alias("category"),
        cell(sheet, "string").alias("sheet"), cell(column, "string").alias("column"),
        cell(row_from, "bigint").alias("row_from"), cell(row_to, "bigint").alias("row_to"),
        cell(n, "bigint").alias("n"))


def _issue(frame: DataFrame, *row, **more) -> DataFrame:
    return frame.select(F.inline(F.array(_row(*row, **more))))


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ISSUE)


def empty_workbook(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """One high issue when there is no table at all."""
    rows = [] if tables else [("high", "empty_workbook", None, None, None, None, 0)]
    return spark.createDataFrame(rows, ISSUE)


def empty_sheet(sheet: str, df: DataFrame) -> DataFrame:
    """A table without rows, or with rows of nulls only. Looks for one filled row."""
    found = df.dropna(how="all").select(F.lit(1).alias("x")).limit(1)
    none = found.agg(F.count("*").alias("n")).where("n = 0")
    return _issue(none, "high", "empty_sheet", sheet, n=F.col("n"))


def inconsistent_columns(sheet: str, raw: DataFrame, cells: str, expected, row_no: str) -> DataFrame:
    """Raw rows (an array of cells each) whose length is not the header's, one issue per
    row; ``n`` is the length found. Longer rows are reported like shorter ones."""
    want = expected if isinstance(expected, Column) else F.lit(expected)
    size = F.size(quoted(cells))
    wrong = raw.where(size != want)
    number = quoted(row_no) + 1
    return _issue(wrong, "medium", "inconsistent_columns", sheet, row_from=number, row_to=number, n=size)


def ragged_rows(raw: DataFrame, sheet: str | Column | None = None, continued: bool = False) -> DataFrame:
    """Records of ``read_raw`` that are longer or shorter than the header of their file. Rows
    are counted from 1 after the header; the sheet is the file unless named.

    ``continued`` says that the files of a sheet, which follow each other in the order of paths
    as those of a folder do, are one table: its header is the first record of the first file,
    and rows are counted on from file to file.
    """
    if continued:
        name = F.col("file") if sheet is None else sheet if isinstance(sheet, Column) else F.lit(sheet)
        rows = raw.withColumn("__sheet", name)
        first = rows.where("file_row = 0").groupBy("__sheet").agg(
            F.min("row_no").alias("__first"), F.min_by(F.size("cells"), "row_no").alias("__width"))
        rows = measured_join(rows, pin(first), ["__sheet"]).withColumn("__row", F.col("row_no") - F.col("__first") - 1)
        return inconsistent_columns(F.col("__sheet"), rows.where("__row >= 0"), "cells", F.col("__width"), "__row")
    header = pin(raw.where("file_row = 0").select("file_no", F.size("cells").alias("__width")))
    rows = measured_join(raw.where("file_row > 0").withColumn("__row", F.col("file_row") - 1), header, ["file_no"])
    name = F.col("file") if sheet is None else sheet
    return inconsistent_columns(name, rows, "cells", F.col("__width"), "__row")


def _columns_to_watch(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [c for c in columns_of(df, "numeric") if any(has_keyword(c, k) for k in names)]


_FIGURES = {
    "filled": lambda c: F.count(c),
    "neg": lambda c: F.count_if(as_double(c) < 0),
    **{name: (lambda c, p=pattern: F.count_if(c.rlike(p))) for name, pattern in ERROR_PATTERNS},
}


def _empty_rows(sheet) -> list[Column]:
    return [F.when(F.col("filled") == 0, _row("medium", "empty_column", sheet, F.col("column"), n=F.col("rows")))]


def _negative_rows(sheet) -> list[Column]:
    return [F.when(F.col("neg") > 0, _row("medium", "unexpected_negative", sheet, F.col("column"), n=F.col("neg")))]


def _text_rows(sheet) -> list[Column]:
    return [F.when(F.col(name) > 0, _row("high", f"suspicious_text:{name}", sheet, F.col("column"), n=F.col(name)))
            for name, _ in ERROR_PATTERNS]


def _column_issues(df: DataFrame, cols: Sequence[str], figures: Sequence[str], rows: Sequence[Column],
                   only: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    if not cols:
        return _none(df.sparkSession)
    stats = column_rows(df, cols, {f: _FIGURES[f] for f in figures}, extra={"rows": F.count("*")}, only=only)
    return stats.select(F.inline(F.array_compact(F.array(*rows))))


def empty_column(sheet: str, df: DataFrame) -> DataFrame:
    """Columns without any value."""
    return _column_issues(df, df.columns, ["filled"], _empty_rows(sheet))


def unexpected_negative(sheet: str, df: DataFrame,
                        names: Sequence[str] = NON_NEGATIVE_NAMES) -> DataFrame:
    """Numeric columns with values below 0 although a word of their name says otherwise."""
    return _column_issues(df, _columns_to_watch(df, names), ["neg"], _negative_rows(sheet))


def suspicious_text(sheet: str, df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Cells that show a spreadsheet error, per column and kind of error."""
    return _column_issues(df, cols or columns_of(df, "text"), [n for n, _ in ERROR_PATTERNS], _text_rows(sheet))


def column_issues(sheet: str, df: DataFrame, names: Sequence[str] = NON_NEGATIVE_NAMES) -> DataFrame:
    """Empty columns, unexpected negatives and suspicious texts in one pass."""
    texts = columns_of(df, "text")
    only = {"neg": _columns_to_watch(df, names), **{n: texts for n, _ in ERROR_PATTERNS}}
    rows = [*_empty_rows(sheet), *_negative_rows(sheet), *_text_rows(sheet)]
    return _column_issues(df, df.columns, list(_FIGURES), rows, only)


def header_lint(catalogue: DataFrame, sheet: str = "table", ordinal: str = "ordinal",
                name: str = "name") -> DataFrame:
    """Checks the names in a catalogue of columns, one row per column of any number of
    tables: empty, with a space or symbol, or starting with a digit."""
    header = quoted(name)
    bare = F.length(F.trim(F.regexp_replace(F.coalesce(header, F.lit("")), r"\s", " "))) == 0
    kind = (F.when(bare, "empty_header")
            .when(header.rlike(HEADER_SYMBOLS), "header_special_chars")
            .when(header.rlike(r"^[0-9]"), "header_starts_with_digit"))
    found = catalogue.withColumn("__kind", kind).where(F.col("__kind").isNotNull())
    return _issue(found, "low", F.col("__kind"), quoted(sheet), header, n=quoted(ordinal))


def catalogue_of(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, ordinal, name) of the given tables."""
    rows = [(t, i + 1, c) for t, df in tables.items() for i, c in enumerate(df.columns)]
    return spark.createDataFrame(rows, "table string, ordinal bigint, name string")


def merged_cell_gaps(sheet: str, df: DataFrame, row_no: str, cols: Sequence[str] | None = None,
                     chunk: int = 1_000_000) -> DataFrame:
    """Runs of 1 to 19 nulls between two filled cells of a text column (>= 2 nulls in it).

    A window over all rows would be one task. Since a gap spans at most 20 rows, rows are
    windowed in chunks that repeat the 20 rows before them; the result is the same.
    """
    cols = [c for c in (cols or columns_of(df, "text")) if c != row_no]
    if not cols:
        return _none(df.sparkSession)
    at = quoted(row_no)
    w = Window.partitionBy("__chunk").orderBy(row_no).rangeBetween(-LONGEST_GAP, -1)
    rows = in_chunks(df.select(at, *map(quoted, cols)), row_no, LONGEST_GAP, chunk)
    previous = [F.max(F.when(quoted(c).isNotNull(), at)).over(w).alias(f"p{i}")
                for i, c in enumerate(cols)]
    seen = rows.select(at.alias("at"), "__own", *previous,
                       *[quoted(c).isNotNull().alias(f"f{i}") for i, c in enumerate(cols)])
    gaps = F.array(*[
        F.struct(F.lit(c).alias("column"),
                 F.when(F.col(f"f{i}"), F.col(f"p{i}")).alias("start"))
        for i, c in enumerate(cols)])
    found = seen.where("__own").select("at", F.inline(gaps)).where(F.col("at") - F.col("start") > 1)
    nulls = column_rows(df, cols, {"nulls": lambda c: F.count("*") - F.count(c)}).where("nulls >= 2")
    found = found.join(F.broadcast(nulls.select("column")), "column", "left_semi")
    return _issue(found, "low", "merged_cell_gap", sheet, F.col("column"),
                  F.col("start") + 1, F.col("at") + 1, F.col("at") - F.col("start") - 1)


def audit(spark: SparkSession, tables: Mapping[str, DataFrame], row_no: str = "row_no",
          raw: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """All checks over all tables, sorted from high to low severity.

    Gaps are looked for in tables that carry ``row_no``, ragged rows in the records of the
    tables' files, handed over in ``raw`` as ``read_raw`` gives them.
    """
    parts = [empty_workbook(spark, tables)]
    for sheet, df in tables.items():
        parts += [empty_sheet(sheet, df), column_issues(sheet, df)]
        if row_no in df.columns:
            parts.append(merged_cell_gaps(sheet, df, row_no))
        if raw and sheet in raw:
            parts.append(ragged_rows(raw[sheet], sheet))
    if tables:
        parts.append(header_lint(catalogue_of(spark, tables)))
    order = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return reduce(DataFrame.unionByName, parts).orderBy(order, "sheet", "category", "column", "row_from")
