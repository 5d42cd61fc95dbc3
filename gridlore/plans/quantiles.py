"""Exact quantiles without holding a group's values in one task.

``F.percentile`` keeps every distinct value of a group in memory. Here a sketch only
brackets the wanted ranks, a second pass counts what lies below each bracket and which
values lie inside, and ranks are then resolved among the few values of one slice of the
bracket. The answer is exact (linear interpolation between neighbours); the sketch
decides how much is left to sort, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from gridlore.plans.shape import measured_join, melt_numeric, quoted, same_keys
from gridlore.session import pin

SKETCH_ACCURACY = 10000
SLICES = 1024


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    accuracy: int | None = None,
    small_keys: bool = False,
) -> DataFrame:
    """(keys, n, q0, q1, ...) for the non-null values of each key.

    ``accuracy`` asks for the sketch alone (rank error n/accuracy). ``small_keys`` states
    that the number of keys does not grow with the data, so brackets may be broadcast.
    """
    if list(probs) != sorted(probs):
        raise ValueError("probabilities must ascend")
    cells = df.select(*map(quoted, keys), quoted(value).cast("double").alias("__v"))
    cells = cells.where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    names = [quoted(k) for k in keys]
    if accuracy is not None:
        sketch = F.percentile_approx("__v", list(probs), accuracy)
        out = cells.groupBy(*names).agg(F.count("*").alias("n"), sketch.alias("__q"))
        return out.select(*names, "n", *[F.col("__q")[i].alias(f"q{i}") for i in range(len(probs))])

    # The bracket must reach a rank or two past the sketch's error on both sides, so small
    # groups get a wider one; those below 200 values are taken whole.
    every = range(len(probs))
    bounds = [b for p in probs for slack in (2.0 / SKETCH_ACCURACY, 0.02)
              for b in (max(0.0, p - slack), min(1.0, p + slack))]
    sketch = cells.groupBy(*names).agg(
        F.expr("count(*) AS __n"), F.expr("min(__v) AS __min"), F.expr("max(__v) AS __max"),
        F.percentile_approx("__v", bounds, SKETCH_ACCURACY).alias("__q"),
    )

    def edge(i, side, end):
        return (f"CASE WHEN __n >= {2 * SKETCH_ACCURACY} THEN __q[{4 * i + side}] "
                f"WHEN __n >= 200 THEN __q[{4 * i + 2 + side}] ELSE {end} END")

    brackets = sketch.select(*names, "__n", *[F.expr(e) for i in every for e in (
        f"{edge(i, 0, '__min')} AS __lo{i}", f"{edge(i, 1, '__max')} AS __hi{i}")])
    if not small_keys:
        brackets = pin(brackets)

    # One pass over the values: a value inside some bracket is counted by itself, any
    # other only by how many brackets lie wholly below it (probabilities ascend).
    inside = " OR ".join(f"(__v BETWEEN __lo{i} AND __hi{i})" for i in every)
    passed = " + ".join(f"CAST(__v > __hi{i} AS INT)" for i in every)
    zones = measured_join(cells, brackets, keys, small_right=small_keys).groupBy(
        *names,
        F.expr(f"CASE WHEN NOT ({inside}) THEN {passed} END AS __zone"),
        F.expr(f"CASE WHEN {inside} THEN __v END AS __x"),
    ).agg(F.expr("count(*) AS __c"))

    # From here on rows are distinct bracketed values, not cells. Each bracket is cut into
    # slices of equal width; a rank is then looked for in the one slice that holds it.
    def place(i):
        width = f"((__hi{i} - __lo{i}) / {SLICES}.0D)"
        at = (f"CASE WHEN {width} > 0 AND {width} < double('Infinity') THEN "
              f"least({SLICES - 1}, CAST(floor((__x - __lo{i}) / {width}) AS INT)) ELSE 0 END")
        return (f"CASE WHEN __zone <= {i} OR __x < __lo{i} THEN named_struct('__i', {i}, '__slice', -1, '__at', NULL) "
                f"WHEN __x <= __hi{i} THEN named_struct('__i', {i}, '__slice', {at}, '__at', __x) END")

    places = ", ".join(map(place, every))
    spread = same_keys(zones, brackets, keys, small_right=small_keys).select(
        *names, "__n", "__c", F.expr(f"inline(array_compact(array({places})))"))
    rank = "element_at(array(" + ", ".join(f"{float(p)!r}D" for p in probs) + "), __i + 1) * (__n - 1)"
    spread = spread.withColumn("__rank", F.expr(rank))
    low, high = "floor(__rank)", "least(floor(__rank) + 1, __n - 1)"
    slices = spread.groupBy(*names, "__i", "__slice").agg(
        F.expr("sum(__c) AS __sc"), F.expr("max(__n) AS __n"), F.expr("max(__rank) AS __rank"))
    w = Window.partitionBy(*names, "__i").orderBy("__slice")
    slices = slices.withColumn("__start", F.sum("__sc").over(w) - F.col("__sc")).where(
        f"__slice >= 0 AND __start <= {high} AND __start + __sc > {low}"
    ).select(*names, "__i", "__slice", "__start")

    kept = same_keys(spread, slices, [*keys, "__i", "__slice"], small_right=small_keys)
    w = Window.partitionBy(*names, "__i", "__slice").orderBy("__at")
    kept = kept.withColumn("__to", F.col("__start") + F.sum("__c").over(w))

    def picked(i, wanted):
        hit = f"max(CASE WHEN __i = {i} AND __to - __c <= {wanted} AND {wanted} < __to THEN __at END)"
        # The sketch guarantees the bracket; if it ever failed, fail rather than guess.
        return f"coalesce({hit}, CAST(raise_error('quantile bracket missed') AS DOUBLE))"

    part = lambda i: f"max(CASE WHEN __i = {i} THEN __rank - floor(__rank) END)"
    return kept.groupBy(*names).agg(F.expr("max(__n) AS n"), *[
        F.expr(f"{picked(i, low)} + ({picked(i, high)} - {picked(i, low)}) * {part(i)} AS q{i}") for i in every])


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                     group_by: Sequence[str] = (), accuracy: int | None = None) -> DataFrame:
    """(group_by, column, n, q0, ...) for several columns in one query."""
    # short whole-number keys group and join faster than names
    cells = melt_numeric(df, cols, group_by, numbered=True)
    out = quantiles(cells, [*group_by, "column_no"], "value", probs, accuracy, small_keys=not group_by)
    names = F.array(*map(F.lit, cols))
    return out.select(*map(quoted, group_by), names[F.col("column_no")].alias("column"),
                      "n", *[f"q{i}" for i in range(len(probs))])
