"""Reading, typing and writing tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gridlore.functions.numeric import (
    USUAL_DATES, number_from_text, time_from_text, usual_time, whole_from_text,
)
from gridlore.functions.schema import columns_of, unique_names
from gridlore.plans.position import number_file_rows
from gridlore.plans.shape import column_rows, quoted
from gridlore.sources.raw import read_raw

TYPED_SHARE = 0.5
MOSTLY_NULL_SHARE = 0.9
TEXT_FORMATS = ("csv", "json", "text")


def coerce_types(df: DataFrame, threshold: float = TYPED_SHARE, dates: bool = True,
                 formats: tuple[str, ...] = ()) -> DataFrame:
    """Text columns turned into numbers, else into timestamps, where at least half of all
    rows parse; cells that do not parse become null. Columns over 90 % null stay text.

    Numbers are bigint if all of a column are whole and fit, else double. Timestamps are
    read as ISO, then by ``formats``, then by the one usual form (month or day first) that
    reads most cells of the column, month first where both read as many.

    One aggregate over all text columns decides; the result is a single projection.
    """
    types = decide_types(df, threshold, dates, formats)
    out = []
    for c in df.columns:
        kind, form = types.get(c, ("text", None))
        if kind == "integer":
            out.append(whole_from_text(quoted(c)).alias(c))
        elif kind == "numeric":
            out.append(number_from_text(quoted(c)).alias(c))
        elif kind == "date":
            out.append(_time(quoted(c), formats, form).alias(c))
        else:
            out.append(quoted(c))
    return df.select(*out)


def _time(c, formats: tuple[str, ...], form: str):
    return F.coalesce(time_from_text(c, formats), usual_time(c, form))


def _times(i: int) -> str:
    return f"times_{i}"


def type_evidence(df: DataFrame, formats: tuple[str, ...] = (), dates: bool = True) -> DataFrame:
    """(column, rows, filled, numbers, wholes, times_0, ...) for the text columns, with one
    count of times per usual form."""
    counts = {
        "filled": lambda c: F.count(c),
        "numbers": lambda c: F.count(number_from_text(c)),
        "wholes": lambda c: F.count(whole_from_text(c)),
    }
    for i, form in enumerate(USUAL_DATES if dates else ()):
        counts[_times(i)] = lambda c, form=form: F.count(_time(c, formats, form))
    return column_rows(df, columns_of(df, "text"), counts, extra={"rows": F.count("*")}).select(
        "column", "rows", *counts)


def type_decision(evidence: DataFrame, threshold: float = TYPED_SHARE, dates: bool = True) -> DataFrame:
    """(column, type, form): integer, numeric, date or text; the usual form of dates."""
    need = F.greatest(F.lit(1.0), F.col("rows") * threshold)
    sparse = (F.col("rows") - F.col("filled")) > F.col("rows") * MOSTLY_NULL_SHARE
    enough = F.col("numbers") >= need
    kind = F.when(sparse, "text").when(enough & (F.col("wholes") == F.col("numbers")), "integer").when(enough, "numeric")
    form = F.lit(None).cast("string")
    if dates:
        most = F.greatest(*[_times(i) for i in range(len(USUAL_DATES))])
        kind = kind.when(most >= need, "date")
        form = F.coalesce(*[F.when(F.col(_times(i)) == most, name) for i, name in enumerate(USUAL_DATES)])
    return evidence.select("column", kind.otherwise("text").alias("type"), form.alias("form"))


def decide_types(df: DataFrame, threshold: float = TYPED_SHARE, dates: bool = True,
                 formats: tuple[str, ...] = ()) -> dict[str, tuple[str, str | None]]:
    """Column -> (integer / numeric / date / text, usual date form) for the text columns;
    runs one aggregate."""
    if not columns_of(df, "text"):
        return {}
    rows = type_decision(type_evidence(df, formats, dates), threshold, dates).collect()
    return {r["column"]: (r["type"], r["form"]) for r in rows}


def from_rows(spark: SparkSession, headers: Sequence[str | None] | None,
              rows: Sequence[Sequence[Any]], dates: bool = True,
              formats: tuple[str, ...] = ()) -> DataFrame:
    """A typed table from a 2-D range handed over by the caller. Short rows are padded;
    longer ones are an error (``raw_rows`` keeps them for the audit)."""
    width = len(headers) if headers is not None else max((len(r) for r in rows), default=0)
    names = unique_names(headers if headers is not None else [None] * width)
    if any(len(r) > width for r in rows):
        raise ValueError("a row is longer than the header")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    cells = [tuple(_text(v) for v in r) + (None,) * (width - len(r)) for r in rows]
    table = spark.createDataFrame(cells, schema)
    return coerce_types(table, dates=dates, formats=formats) if width else table


def raw_rows(spark: SparkSession, rows: Sequence[Sequence[Any]]) -> DataFrame:
    """(row_no, cells): the range as it is, whatever the length of its rows."""
    data = [(i, [_text(v) for v in r]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "row_no bigint, cells array<string>")


def _text(v: Any) -> str | None:
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(v)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", dates: bool = True,
               row_no: bool = False, formats: tuple[str, ...] = (), **options: Any) -> DataFrame:
    """A table from parquet, orc, json or csv files. CSV is read as text with a header and
    then typed (see ``coerce_types`` for ``dates`` and ``formats``); cells beyond the header
    become columns named as those without a header are. ``row_no`` adds the 0-based position
    in the files (by file path, then by row).

    CSV is cut by ``read_raw``, so quoted cells may hold line breaks, and its options are
    ``header``, ``sep`` and ``quote``. With any other option Spark's own CSV reader is used,
    which takes one line as one record and drops cells beyond the header."""
    if fmt == "csv" and not set(options) - {"header", "sep", "quote"}:
        return coerce_types(_csv_cells(spark, path, row_no, **options), dates=dates, formats=formats)
    reader = spark.read.options(**{k: str(v) for k, v in options.items()})
    if fmt == "csv":
        if "header" not in options:
            reader = reader.option("header", True)
        raw = reader.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
        raw = raw.toDF(*unique_names(raw.columns))
        return coerce_types(number_file_rows(raw) if row_no else raw, dates=dates, formats=formats)
    table = reader.format(fmt).load(path)
    return number_file_rows(table) if row_no else table


def _csv_cells(spark: SparkSession, path: str, row_no: bool, header: Any = True, sep: str = ",", quote: str = '"') -> DataFrame:
    """Text columns of CSV files, as many as the longest record has cells."""
    header = str(header).lower() == "true"
    raw = read_raw(spark, path, sep, quote, trim=True)
    first = F.any_value(F.when(F.col("row_no") == 0, F.col("cells")), ignoreNulls=True)
    names, width = raw.agg(first, F.max(F.size("cells"))).first()
    names = list(names or []) if header else []
    names = unique_names(names + [None] * ((width or 0) - len(names)))
    out = [F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(names)]
    if row_no:
        out.append((F.col("row_no") - (F.col("file_no") + 1 if header else 0)).alias("row_no"))
    return (raw.where("file_row > 0") if header else raw).select(*out)


def read_workbook(spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet",
                  **options: Any) -> dict[str, DataFrame]:
    """Several tables by name, empty ones included."""
    return {name: read_table(spark, path, fmt, **options) for name, path in paths.items()}


def load_saved(spark: SparkSession, name: str) -> DataFrame | None:
    """A saved table by catalog name, or None."""
    return spark.table(name) if spark.catalog.tableExists(name) else None


def plain_values(df: DataFrame, dates_as_text: bool = False) -> DataFrame:
    """NaN and infinite numbers turned null; dates as ISO text where asked for."""
    out = []
    for f in df.schema.fields:
        c = quoted(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            bad = F.isnan(c) | (F.abs(c) == float("inf"))
            out.append(F.when(~bad, c).alias(f.name))
        elif dates_as_text and isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out.append(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error",
                partition_by: Sequence[str] = ()) -> None:
    """Writes the table with plain values; text formats get ISO dates, CSV a header and doubled
    quotes within quoted cells."""
    table = plain_values(df, dates_as_text=fmt in TEXT_FORMATS)
    writer = table.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
