"""Rows that are copies of each other but for a changed cell.

Two rows that differ in one column at most agree on all columns without it. So every row is keyed
once for each column left out, and rows under one key are near duplicates without any comparison
of pairs. Classes are connected rows: the smallest id goes from rows to keys and back until nothing
changes, with a shortcut over the id that was found last. A key that very many rows share costs one
partial minimum in each task.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridlore.functions.numeric import as_double
from gridlore.plans.shape import quoted
from gridlore.session import pin

#: Columns that rows need beyond the changes allowed, so that not everything is alike.
LEAST_EQUAL = 2


def plain_cell(df: DataFrame, name: str) -> Column:
    """A cell as it is compared: texts trimmed, in lower case, with single blanks; whole numbers
    and decimals exact, other numbers as doubles without NaN."""
    kind, c = df.schema[name].dataType, quoted(name)
    if isinstance(kind, T.StringType):
        return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return as_double(c) if isinstance(kind, (T.FloatType, T.DoubleType)) else c


def _keys(df: DataFrame, cols: Sequence[str], changes: int) -> Column:
    """One 128-bit key per choice of ``changes`` columns left out."""
    def cell(i: int, seed: int) -> Column:
        c = plain_cell(df, cols[i])
        return F.xxhash64(F.lit(seed), F.lit(i), c.isNull(), c)

    hashes = [[cell(i, seed) for i in range(len(cols))] for seed in (1, 2)]

    def without(left_out) -> list[Column]:
        out = []
        for each in hashes:
            rest = [h for i, h in enumerate(each) if i not in left_out]
            total = rest[0]
            for h in rest[1:]:
                total = total.bitwiseXOR(h)
            out.append(total)
        return out

    return F.array(*[
        F.struct(F.lit(no).alias("no"), *[k.alias(n) for k, n in zip(without(left_out), ("k1", "k2"))])
        for no, left_out in enumerate(combinations(range(len(cols)), changes))])


def near_duplicate_rows(df: DataFrame, id: str, cols: Sequence[str] | None = None, max_changes: int = 1) -> DataFrame:
    """(id, class_id, members) of every row with a near duplicate.

    Near duplicates differ in at most ``max_changes`` of the columns (all but the id by default),
    missing cells being equal; classes follow from them by steps, and carry their smallest id.
    Ids are unique and not null; rows without one take no part. Cells are compared as
    ``plain_cell`` says. Nothing is sampled, capped or windowed. Cells are told by 128-bit hashes.
    """
    cols = [c for c in (cols or df.columns) if c != id]
    if max_changes < 1 or len(cols) < max_changes + LEAST_EQUAL:
        raise ValueError(f"at least {max_changes + LEAST_EQUAL} columns are needed beside the id")
    rows = df.where(quoted(id).isNotNull())
    keyed = rows.select(quoted(id).alias("id"), F.inline(_keys(rows, cols, max_changes)))
    key = ["no", "k1", "k2"]
    shared = keyed.groupBy(*key).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").drop("hi")
    members = pin(keyed.join(shared, key))
    labels = pin(members.groupBy("id").agg(F.min("lo").alias("label")))
    members, mark = members.drop("lo"), None
    while True:
        # the least label under each key, then over each row's keys, then that row's own label
        under = members.join(labels, "id").groupBy(*key).agg(F.min("label").alias("least"))
        found = members.join(under, key).groupBy("id").agg(F.min("least").alias("label"))
        above = labels.select(F.col("id").alias("a"), F.col("label").alias("up"))
        labels = pin(found.join(above, F.col("label") == F.col("a"), "left").select("id", F.least("label", F.coalesce("up", "label")).alias("label")))
        now = labels.agg(F.count("*"), F.sum(F.xxhash64("id", "label").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    sizes = labels.groupBy("label").agg(F.count("*").alias("members"))
    return labels.join(sizes, "label").select("id", F.col("label").alias("class_id"), "members")
