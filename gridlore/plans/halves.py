"""Sums over the two halves of columns in a given order, without sorting the rows.

The row order is looked at as one number after the other: the first order column, the second,
and so on to the value itself. A sketch brackets the key of the cell in the middle; one scan then
counts and sums what lies below, on, between and above the two ends of the bracket, and only the
cells between (or on an end, with the next key) are looked at again. A bracket narrows the rows a
few thousand times, so two or three scans leave some ten thousand cells, which are sorted. All
columns share each scan; nothing is shuffled but the cells left at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gridlore.functions.numeric import as_double, mean_of
from gridlore.plans.shape import quoted

#: Cells of a column that are sorted.
FEW = 200_000
ACCURACY = 10_000
#: Bytes of a text that one double holds exactly.
TEXT_STEP = 6

_LOWEST = float("-inf")


def _number(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(_LOWEST))  # nulls come first


class _Keys:
    """The order columns as doubles, one after the other, then the values."""

    def __init__(self, df: DataFrame, order_by: Sequence[str], longest: dict[str, int]):
        self.parts = []
        for name in order_by:
            c, kind = quoted(name), df.schema[name].dataType
            if isinstance(kind, T.DateType):
                self.parts.append([_number(F.unix_date(c))])
            elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.LongType)):
                whole = c if isinstance(kind, T.LongType) else F.unix_micros(c.cast("timestamp"))
                low = whole.bitwiseAND(F.lit((1 << 32) - 1))
                self.parts.append([_number(F.shiftright(whole, 32)), _number(low)])
            elif isinstance(kind, T.DecimalType):
                first = c.cast("double")
                exact = F.lit(None).cast("double") if kind.precision <= 15 else (c - first.try_cast(f"decimal({kind.precision},{kind.scale})")).cast("double")
                self.parts.append([_number(first), _number(exact)])
            elif isinstance(kind, T.StringType):
                self.parts.append((c, 1 + (longest.get(name) or 0) // TEXT_STEP))
            else:
                self.parts.append([_number(c)])

    def at(self, level: int) -> Column | None:
        """The key of a level; None where only the value is left."""
        for part in self.parts:
            steps = part[1] if isinstance(part, tuple) else len(part)
            if level < steps:
                if not isinstance(part, tuple):
                    return part[level]
                c = part[0].cast("binary")
                code = F.rpad(F.hex(F.substring(c, level * TEXT_STEP + 1, TEXT_STEP)), 2 * TEXT_STEP, "0")
                # a text that ends here comes before one that goes on with zeros, and after null
                return _number(F.conv(code, 16, 10).cast("double") + F.when(F.octet_length(c) > level * TEXT_STEP, 1.0).otherwise(0.0))
            level -= steps
        return None


class _Search:
    """Where the middle of one column can be, and the sums outside."""

    def __init__(self, no: int, value: Column, n: int):
        self.no, self.value, self.n, self.half = no, value, n, n // 2
        self.level, self.where = 0, value.isNotNull()
        self.before = 0  # cells before those that are left
        self.left = n
        self.first = self.rest = 0.0

    def narrow(self, key: Column, lo: float, hi: float, zones: Sequence[tuple[int, float]]) -> int:
        """Goes on in the zone of the middle: below, on lo, between, on hi, above."""
        found = [key < lo, key == lo, (key > lo) & (key < hi), (key == hi) & F.lit(lo != hi), key > hi]
        for i, (n, total) in enumerate(zones):
            if self.before + n <= self.half:
                self.before += n
                self.first += total
                continue
            self.where, self.left = self.where & found[i], n
            self.level += i in (1, 3)
            self.rest += sum(z[1] for z in zones[i + 1:])
            return i
        raise AssertionError("the middle is in no zone")


def column_facts(df: DataFrame, cols: Sequence[str], order_by: Sequence[str]) -> tuple[int, list[dict]]:
    """(rows, facts per column): n, total, mean, min, max, first_sum (of the first n div 2
    cells in order), rest_sum (of all others) and second_sum (rest_sum less the last cell of
    an odd number), over the cells that are not missing.

    Cells in equal places of ``order_by`` are ordered by value. Runs a few jobs when called.
    """
    values = [as_double(quoted(c)) for c in cols]
    texts = [c for c in order_by if isinstance(df.schema[c].dataType, T.StringType)]
    order = F.struct(*[quoted(c) for c in order_by])
    aggs = [F.count("*").alias("rows"), *[F.max(F.octet_length(quoted(c))).alias(f"t{k}") for k, c in enumerate(texts)]]
    for i, v in enumerate(values):
        aggs += [F.count(v).alias(f"n{i}"), F.sum(v).alias(f"s{i}"), mean_of(v).alias(f"m{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"),
                 F.max_by(v, F.when(v.isNotNull(), F.struct(order, v))).alias(f"last{i}")]
    seen = df.agg(*aggs).first()
    keys = _Keys(df, order_by, {c: seen[f"t{k}"] for k, c in enumerate(texts)})
    searches = [_Search(i, v, seen[f"n{i}"]) for i, v in enumerate(values)]

    while wide := [s for s in searches if s.left > FEW]:
        key_of = {}
        for s in wide:
            key = keys.at(s.level)
            key_of[s.no] = s.value if key is None else key
        share = {s.no: (s.half - s.before) / s.left for s in wide}
        brackets = df.agg(*[F.percentile_approx(
            F.when(s.where, key_of[s.no]), [max(0.0, share[s.no] - 2 / ACCURACY), min(1.0, share[s.no] + 2 / ACCURACY)], ACCURACY).alias(f"b{s.no}")
            for s in wide]).first()
        zones = []
        for s in wide:
            key, (lo, hi) = key_of[s.no], brackets[f"b{s.no}"]
            zone = F.when(key < lo, 0).when(key == lo, 1).when(key < hi, 2).when(key == hi, 3).otherwise(4)
            zones += [f(F.when(s.where & (zone == z), s.value)).alias(f"{name}{s.no}_{z}") for z in range(5) for name, f in (("n", F.count), ("s", F.sum))]
        row = df.agg(*zones).first()
        for s in wide:
            lo, hi = brackets[f"b{s.no}"]
            by_value = keys.at(s.level) is None
            zone = s.narrow(key_of[s.no], lo, hi, [(row[f"n{s.no}_{z}"], row[f"s{s.no}_{z}"] or 0.0) for z in range(5)])
            if by_value and zone in (1, 3):  # equal values: no matter which come first
                each, m = (lo if zone == 1 else hi), s.half - s.before
                s.first, s.rest, s.left = s.first + m * each, s.rest + (s.left - m) * each, 0

    few = [s for s in searches if s.left]
    if few:
        cells = F.array_compact(F.array(*[F.when(s.where, F.struct(F.lit(s.no).alias("no"), s.value.alias("v"))) for s in few]))
        place = Window.partitionBy("no").orderBy(*[f"o{k}" for k in range(len(order_by))], "v")  # at most FEW cells a column
        taken = F.create_map(*[F.lit(x) for s in few for x in (s.no, s.half - s.before)])
        some = df.select(*[quoted(c).alias(f"o{k}") for k, c in enumerate(order_by)], F.inline(cells)).withColumn("at", F.row_number().over(place))
        is_first = F.col("at") <= taken[F.col("no")]
        for r in some.groupBy("no").agg(F.sum(F.when(is_first, F.col("v"))).alias("a"), F.sum(F.when(~is_first, F.col("v"))).alias("b")).collect():
            searches[r["no"]].first += r["a"] or 0.0
            searches[r["no"]].rest += r["b"] or 0.0

    facts = []
    for i, (c, s) in enumerate(zip(cols, searches)):
        odd_last = (seen[f"last{i}"] or 0.0) if s.n % 2 else 0.0
        facts.append({"column": c, "n": s.n, "total": seen[f"s{i}"], "mean": seen[f"m{i}"], "min": seen[f"lo{i}"], "max": seen[f"hi{i}"],
                      "first_sum": s.first if s.half else None, "rest_sum": s.rest if s.n else None,
                      "second_sum": s.rest - odd_last if s.half else None})
    return seen["rows"], facts
