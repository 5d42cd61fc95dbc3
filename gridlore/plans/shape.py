"""Wide aggregates turned into rows, melting, and small keyed joins."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridlore.functions.numeric import as_double
from gridlore.session import pin


def quoted(name: str) -> Column:
    """Column by exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def column_rows(
    df: DataFrame,
    cols: Sequence[str],
    stats: Mapping[str, Callable[[Column], Column]],
    group_by: Sequence[str] = (),
    extra: Mapping[str, Column] | None = None,
    only: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """One row per column (and group) with the given aggregates.

    All columns are aggregated side by side in one pass, without multiplying the input
    rows; the single wide row of each group is then split into rows. ``extra`` holds
    whole-table aggregates repeated on each row; ``only`` limits a (whole-number) figure to
    some of the columns and leaves it null for the others.
    """
    extra, only = dict(extra or {}), dict(only or {})
    missing = F.lit(None).cast("bigint")
    aggs = [expr.alias(f"x{k}") for k, expr in enumerate(extra.values())]
    for i, name in enumerate(cols):
        aggs += [fn(quoted(name)).alias(f"s{i}_{j}") for j, (stat, fn) in enumerate(stats.items())
                 if name in only.get(stat, cols)]
    if not cols:
        raise ValueError("no columns to aggregate")
    wide = df.groupBy(*map(quoted, group_by)).agg(*aggs)
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("column_no"),
            F.lit(name).alias("column"),
            *[(F.col(f"s{i}_{j}") if name in only.get(stat, cols) else missing).alias(stat)
              for j, stat in enumerate(stats)],
        )
        for i, name in enumerate(cols)
    ])
    kept = [quoted(g) for g in group_by]
    kept += [F.col(f"x{k}").alias(name) for k, name in enumerate(extra)]
    return wide.select(*kept, F.inline(rows))


def melt_numeric(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = (),
                 numbered: bool = False) -> DataFrame:
    """(ids, column, value double) for the non-missing numeric cells; ``numbered`` gives the
    place of the column in ``cols`` as ``column_no`` instead of its name."""
    values = [as_double(quoted(c)).alias(f"v{i}") for i, c in enumerate(cols)]
    return _melt(df, cols, ids, values, numbered=numbered)


def melt_text(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = (),
              keep_null: bool = False) -> DataFrame:
    """(ids, column, value string) for the cells, nulls left out unless asked for."""
    values = [quoted(c).cast("string").alias(f"v{i}") for i, c in enumerate(cols)]
    return _melt(df, cols, ids, values, keep_null)


def _melt(df, cols, ids, values, keep_null=False, numbered=False):
    cells = F.array(*[
        F.struct((F.lit(i).alias("column_no") if numbered else F.lit(name).alias("column")),
                 F.col(f"v{i}").alias("value"))
        for i, name in enumerate(cols)
    ])
    out = df.select(*map(quoted, ids), *values).select(*map(quoted, ids), F.inline(cells))
    return out if keep_null else out.where(F.col("value").isNotNull())


def value_counts(df: DataFrame, cols: Sequence[str], group_by: Sequence[str] = (),
                 keep_null: bool = False) -> DataFrame:
    """(group_by, column, value, n): one grouped count for all columns together."""
    cells = melt_text(df, cols, group_by, keep_null)
    return cells.groupBy(*map(quoted, group_by), "column", "value").agg(F.count("*").alias("n"))


#: Bytes of a text that stands for itself in a key; of a longer one the first characters and a
#: 128-bit hash do, which together have more.
KEY_BYTES, KEY_CHARS = 48, 32


def text_key(c: Column) -> Column:
    """A short text that is equal for equal texts only (up to a 128-bit hash) and begins like them."""
    return F.when(F.octet_length(c) <= KEY_BYTES, c).otherwise(F.concat(F.substring(c, 1, KEY_CHARS), F.md5(c.cast("binary"))))


def key_counts(df: DataFrame, cols: Sequence[str], group_by: Sequence[str] = ()) -> DataFrame:
    """(group_by, column, key, n): ``value_counts`` without nulls, and without long texts in the shuffle."""
    keys = [text_key(quoted(c).cast("string")).alias(f"v{i}") for i, c in enumerate(cols)]
    cells = _melt(df, cols, group_by, keys).withColumnRenamed("value", "key")
    return cells.groupBy(*map(quoted, group_by), "column", "key").agg(F.count("*").alias("n"))


def top_texts(df: DataFrame, cols: Sequence[str], k: int, counts: DataFrame | None = None) -> DataFrame:
    """(column, value, n, rank): the k most frequent values per column, ties by value.

    Counted by key; only texts that may win, told by count and first characters, are read whole.
    """
    counts = key_counts(df, cols) if counts is None else counts
    start = F.substring("key", 1, KEY_CHARS)
    near = Window.partitionBy("column").orderBy(F.desc("n"), start)
    first = pin(counts.withColumn("__rank", F.rank().over(near)).where(F.col("__rank") <= k).select("column", "key", "n"))
    long = F.octet_length("key") > KEY_BYTES
    texts = first.where(~long).select("column", F.col("key").alias("value"), "n")
    if first.where(long).limit(1).count():
        wanted = sorted(r["column"] for r in first.where(long).select("column").distinct().collect())
        whole = melt_text(df, wanted).where(F.octet_length("value") > KEY_BYTES).withColumn("key", text_key(F.col("value")))
        found = measured_join(whole, first.where(long).withColumnRenamed("n", "__n"), ["column", "key"])
        texts = texts.unionByName(found.groupBy("column", "key").agg(F.min("value").alias("value"), F.max("__n").alias("n")).drop("key"))
    return top_per(texts, ["column"], [F.desc("n"), F.col("value")], k)


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
            rank: str = "rank") -> DataFrame:
    """First k rows per key; Spark cuts to k per task before the shuffle."""
    w = Window.partitionBy(*map(quoted, keys)).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
              small_right: bool = False) -> DataFrame:
    """Equi-join in which a null key equals a null key; the keys appear once.

    ``small_right`` broadcasts the right side. Pass it only where that side has one row
    per column of a table, per order range, or another bound that does not grow with
    the data.
    """
    if not keys:
        raise ValueError("keys needed")
    tagged = right
    for i, key in enumerate(keys):
        tagged = tagged.withColumnRenamed(key, f"__key{i}")
    if small_right:
        tagged = F.broadcast(tagged)
    cond = None
    for i, key in enumerate(keys):
        test = left[key].eqNullSafe(tagged[f"__key{i}"])
        cond = test if cond is None else cond & test
    return left.join(tagged, cond, how).drop(*[f"__key{i}" for i in range(len(keys))])


# Largest number of rows sent to every executor after counting them.
BROADCAST_ROWS = 100_000


def measured_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
                  small_right: bool = False) -> DataFrame:
    """``same_keys`` for a large left side and a lookup table of unknown size.

    The lookup table, which must be pinned or cheap, is counted up to the limit: within it
    the table is broadcast and the left side stays where it is; beyond it both sides are
    shuffled and AQE splits hot keys.
    """
    if not small_right:
        small_right = right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return same_keys(left, right, keys, how, small_right)
