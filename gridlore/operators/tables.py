"""Projection, filtering, typing labels and ad-hoc SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlore.functions.numeric import number_from_text
from gridlore.functions.schema import columns_of
from gridlore.plans.shape import column_rows, quoted

# Texts that look like a truth value.
BOOLEAN_LIKE = ("true", "false", "yes", "no", "1", "0", "y", "n", "t", "f")

NUMERIC_SHARE = 0.8


def range_filter(df: DataFrame, col: str, low: float, high: float) -> DataFrame:
    """Rows with low <= col <= high; text is read as a number, nulls drop out."""
    if col in columns_of(df, "text"):
        return df.where(number_from_text(quoted(col)).between(low, high))
    return df.where(quoted(col).between(low, high))


def detect_column_types(df: DataFrame) -> DataFrame:
    """(column, label): boolean, date, numeric, text or mixed.

    Boolean means two distinct values that both look like truth values; text counts as
    numeric when more than 80 % of it parses. Runs one aggregate when called, and a second
    one over the columns that may be boolean: there every value must be the smallest or
    the largest, so no distinct values are collected.
    """
    if not df.columns:
        raise ValueError("no columns")
    kinds = {c: kind for kind in ("numeric", "text", "date", "boolean") for c in columns_of(df, kind)}
    words = [c for c in df.columns if kinds.get(c) in ("numeric", "text")]
    looks = lambda c: F.lower(c.cast("string")).isin(*BOOLEAN_LIKE)
    facts = {}
    if words:
        stats = column_rows(df, words, {
            "n": lambda c: F.count(c),
            "truthy": lambda c: F.coalesce(F.bool_and(looks(c)), F.lit(False)),
            "low": lambda c: F.min(c.cast("string")),
            "high": lambda c: F.max(c.cast("string")),
            "numbers": lambda c: F.count(number_from_text(c.cast("string"))),
        })
        facts = {r["column"]: r for r in stats.collect()}
    maybe = [c for c, r in facts.items() if r["truthy"] and r["low"] != r["high"]]
    others = {}
    if maybe:
        third = [F.count_if(~quoted(c).cast("string").isin(facts[c]["low"], facts[c]["high"])) for c in maybe]
        others = dict(zip(maybe, df.agg(*third).first()))

    def label(c):
        kind = kinds.get(c, "mixed")
        if others.get(c) == 0:
            return "boolean"
        if kind == "text":
            return "numeric" if facts[c]["numbers"] > facts[c]["n"] * NUMERIC_SHARE else "text"
        return kind

    return df.sparkSession.createDataFrame([(c, label(c)) for c in df.columns], "column string, label string")


def preview(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """First n rows in the given order."""
    return df.orderBy(*map(quoted, order_by)).limit(n)


def sql(tables: DataFrame | Mapping[str, DataFrame], query: str) -> DataFrame:
    """Runs one SELECT over a table called ``data``, or over several named tables.

    Views live in a session of their own, so they cannot clash. Names may be written in
    double quotes. An empty table still runs the query.
    """
    named = {"data": tables} if isinstance(tables, DataFrame) else dict(tables)
    if not named:
        raise ValueError("no tables")
    if not re.match(r"(?is)^\s*(select|with|values|from|table|\()", query):
        raise ValueError("only a query that reads is allowed")
    home: SparkSession = next(iter(named.values())).sparkSession
    child = home.newSession()
    for key, value in (("spark.sql.session.timeZone", "UTC"),
                       ("spark.sql.shuffle.partitions", home.conf.get("spark.sql.shuffle.partitions")),
                       ("spark.sql.ansi.enabled", "true"),
                       ("spark.sql.ansi.doubleQuotedIdentifiers", "true")):
        child.conf.set(key, value)
    for name, table in named.items():
        _publish(child, table, name)
    return child.sql(query)


def _publish(child: SparkSession, table: DataFrame, name: str) -> None:
    # A view belongs to the session of its frame; the global catalog passes it on.
    key = "v" + uuid.uuid4().hex
    table.createOrReplaceGlobalTempView(key)
    child.table(f"global_temp.{key}").createOrReplaceTempView(name)
    child.catalog.dropGlobalTempView(key)


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None, how: str = "any") -> DataFrame:
    """Rows without (any / all) nulls in the given columns."""
    return df.dropna(how=how, subset=list(subset) if subset else None)


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The first row of each key under ``order_by``, as one aggregate.

    ``min_by`` keeps one row per key and task, so a key with very many rows is reduced
    before the shuffle (a row_number window would sort them all in one task).
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(list(keys))
    order = F.struct(*map(quoted, order_by))
    first = F.min_by(F.struct(*map(quoted, rest)), order).alias("__row")
    return df.groupBy(*map(quoted, keys)).agg(first).select(
        *map(quoted, keys), *[F.col("__row")[c].alias(c) for c in rest]
    ).select(*map(quoted, df.columns))


def sort_dedupe(df: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """One row per key, the first under ``order_by``, sorted by key."""
    return first_per_key(df, [key], order_by).orderBy(quoted(key))
