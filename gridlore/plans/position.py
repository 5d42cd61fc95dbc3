"""Row positions and things measured along them, without a one-task window.

Rows are range-partitioned on the order columns and sorted inside each range.
``monotonically_increasing_id`` then carries the range number and the row's index in it,
so only one small row per range (and key) is needed to line the ranges up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from gridlore.plans.shape import quoted, same_keys
from gridlore.session import pin

_INDEX_BITS = 33
_INDEX_MASK = (1 << _INDEX_BITS) - 1


def _ranged(df: DataFrame, by: Sequence[str]) -> DataFrame:
    order = [quoted(c) for c in by]
    mark = F.monotonically_increasing_id()
    return (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__mark", mark)
        .withColumn("__range", F.shiftright("__mark", _INDEX_BITS))
        .withColumn("__at", F.col("__mark").bitwiseAND(F.lit(_INDEX_MASK)))
        .drop("__mark")
    )


def with_position(df: DataFrame, order_by: Sequence[str], melted: bool = False,
                  name: str = "row_no") -> DataFrame:
    """Adds the 0-based position under ``order_by`` (list a unique tie-break last).

    ``melted`` numbers the rows of each value of ``column`` on its own. The ranges are
    pinned with a reliable checkpoint, because they are read twice.
    """
    keys = ["column"] if melted else []
    ranged = pin(_ranged(df, [*keys, *order_by]))
    return _line_up(ranged, keys, name)


def with_previous(df: DataFrame, order: str, position: str = "__pos", previous: str = "__previous") -> DataFrame:
    """Adds the 0-based position under a unique column and that column's value one row before.

    Both are found within a range of rows and carried over its end by one small row per range.
    """
    ranged = pin(_ranged(df, [order]))
    starts = ranged.groupBy("__range").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"), F.max(quoted(order)).alias("__top"))
    lined = Window.orderBy("__range")
    starts = starts.select("__range", "__first", F.lag("__top").over(lined).alias("__above"), F.coalesce(
        F.sum("__n").over(lined.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    local = F.lag(quoted(order)).over(Window.partitionBy("__range").orderBy("__at"))
    joined = same_keys(ranged.withColumn("__local", local), starts, ["__range"], small_right=True)
    return joined.withColumn(position, F.col("__before") + F.col("__at") - F.col("__first")).withColumn(
        previous, F.coalesce("__local", "__above")).drop("__range", "__at", "__first", "__before", "__above", "__local")


def number_file_rows(df: DataFrame, name: str = "row_no") -> DataFrame:
    """Adds the 0-based position by file path, then by row, to a table read from files.

    A file is read in splits, each by one task from front to back, whatever splits Spark
    packs into that task. So the first mark and the row count of every split, lined up by
    path and start, give the position: one small row per split, and no shuffle of the rows.
    """
    marked = df.select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__at"))
    starts = marked.groupBy("__file", "__block").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("__file", "__block", (
        F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    placed = same_keys(marked, starts, ["__file", "__block"], small_right=True)
    return placed.withColumn(name, F.col("__at") + F.col("__shift")).drop("__file", "__block", "__at", "__shift")


def _line_up(ranged: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    # One row per range plus one per melted column: bounded by partitions and schema.
    starts = ranged.groupBy(*keys, "__range").agg(
        F.count("*").alias("__n"), F.min("__at").alias("__first")
    )
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = starts.select(
        *keys, "__range", "__first",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
    )
    joined = same_keys(ranged, starts, [*keys, "__range"], small_right=True)
    position = F.col("__before") + F.col("__at") - F.col("__first")
    return joined.withColumn(name, position).drop("__range", "__at", "__before", "__first")


def position_trend(df: DataFrame, keys: Sequence[str], order_by: Sequence[str],
                   value: str, ties: bool = False) -> DataFrame:
    """(keys, n, mean, slope, flat): least squares of the non-null values on their position.

    Each range yields count, mean and covariance with the local index. Covariance does
    not change under a shift of the index, so ranges merge like partial aggregates and
    no row ever needs its global position. One shuffle of the rows, none after it.

    ``ties`` is for an order that is not unique: equal (order, value) cells are collapsed
    to one counted cell first, so that a huge run of copies cannot fill one range.
    """
    names = [quoted(k) for k in keys]
    rest = [c for c in order_by if c not in keys and c != value]
    cells = df.select(*names, *map(quoted, rest), quoted(value).cast("double").alias("__y"))
    cells = cells.where(F.col("__y").isNotNull() & ~F.isnan("__y"))
    by = [*keys, *["__y" if c == value else c for c in order_by]]
    if ties:
        by = by if "__y" in by else [*by, "__y"]
        copies = cells.groupBy(*names, *map(quoted, rest), "__y").agg(F.count("*").alias("__w"))
        local = Window.partitionBy(*names, "__range").orderBy("__at")
        ranged = _ranged(copies, by)
        # middle of the places taken by the copies, counted from the start of the range
        middle = F.sum("__w").over(local) - (F.col("__w") + 1) / 2.0
        w, x, y = F.col("__w"), F.col("__x"), F.col("__y")
        parts = ranged.withColumn("__x", middle).groupBy(*names, "__range").agg(
            F.sum(w).cast("double").alias("__n"),
            (F.sum(w * y) / F.sum(w)).alias("__m"),
            ((F.sum(w * x * y) - F.sum(w * x) * F.sum(w * y) / F.sum(w)) / F.sum(w)).alias("__c"),
            F.min(y).alias("__lo"),
            F.max(y).alias("__hi"),
        )
    else:
        parts = _ranged(cells, by).groupBy(*names, "__range").agg(
            F.count("*").cast("double").alias("__n"),
            F.avg("__y").alias("__m"),
            F.covar_pop("__y", F.col("__at").cast("double")).alias("__c"),
            F.min("__y").alias("__lo"),
            F.max("__y").alias("__hi"),
        )
    whole = Window.partitionBy(*names)
    before = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__all", F.sum("__n").over(whole)).withColumn(
        "__mid",
        F.coalesce(F.sum("__n").over(before), F.lit(0.0)) + (F.col("__n") - 1) / 2
        - (F.col("__all") - 1) / 2,
    )
    fitted = parts.groupBy(*names).agg(
        F.sum("__n").alias("__n"),
        F.sum(F.col("__n") * F.col("__m")).alias("__s"),
        F.sum(F.col("__n") * (F.col("__c") + F.col("__mid") * F.col("__m"))).alias("__cxy"),
        F.min("__lo").alias("__lo"),
        F.max("__hi").alias("__hi"),
    )
    n = F.col("__n")
    return fitted.select(
        *names, n.cast("bigint").alias("n"), (F.col("__s") / n).alias("mean"),
        F.try_divide(F.col("__cxy") * 12, n * (n * n - 1)).alias("slope"),
        (F.col("__lo") == F.col("__hi")).alias("flat"),
    )


def running_total(df: DataFrame, order_by: Sequence[F.Column], value: str,
                  name: str = "running") -> DataFrame:
    """Adds the running sum of ``value`` along ``order_by`` over the whole table."""
    mark = F.monotonically_increasing_id()
    ranged = pin(
        df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
        .withColumn("__at", mark)
    ).withColumn("__range", F.shiftright("__at", _INDEX_BITS))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__range").agg(F.sum(value).alias("__s"))
    starts = starts.select("__range", F.sum("__s").over(before).alias("__before"))
    local = F.sum(value).over(Window.partitionBy("__range").orderBy("__at"))
    return (
        same_keys(ranged.withColumn("__local", local), starts, ["__range"], small_right=True)
        .withColumn(name, F.col("__local") + F.coalesce(F.col("__before"), F.lit(0)))
        .drop("__range", "__at", "__before", "__local")
    )


def in_chunks(df: DataFrame, position: str, halo: int, chunk: int = 1_000_000) -> DataFrame:
    """Splits numbered rows into equal chunks for windows that look back ``halo`` rows.

    Adds ``__chunk`` and ``__own``; the last rows of a chunk are repeated, with
    ``__own`` false, at the head of the next one.
    """
    home = F.floor(F.col(position) / chunk)
    tail = F.col(position) % chunk >= chunk - halo
    both = F.array(
        F.struct(home.alias("__chunk"), F.lit(True).alias("__own")),
        F.struct((home + 1).alias("__chunk"), F.lit(False).alias("__own")),
    )
    one = F.slice(both, 1, 1)
    return df.select("*", F.inline(F.when(tail, both).otherwise(one)))
