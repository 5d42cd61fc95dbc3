"""Products bought by the same customers: exact top pairs without expanding big baskets.

Counting pairs by joining every basket with itself emits k*k/2 rows for a basket of k
products, which one huge basket makes impossible. The k most frequent pairs are found
exactly with far less:

1. Among the most widely bought products the pairs are counted. The k-th best count is a
   floor: no pair below it can be in the answer, and a pair never counts more than its rarer
   product does, so products bought by fewer customers than the floor drop out. While much
   work is left, the list is widened, which raises the floor.
2. The largest baskets, fewer than half the floor, are set aside. A pair that reaches the
   floor must be in at least floor - set-aside of the other baskets. Only those are expanded;
   the survivors are then looked up in the baskets set aside, by joins on product and customer.
3. Where very many pairs would just reach the floor, as when every product was bought once,
   only pairs above it are counted so. Of those that equal it the first by name are wanted:
   pairs are counted for some first products at a time, in order of name, until there are enough.

Products are numbered in the order of their names. A customer's products come as one list, or a
block of it, and Arrow batches turn lists into pair numbers, which are shuffled as sorted runs to as
many tasks as the pairs need and counted there. Where a pair goes follows from a hash of both
products, and copies collapse before they are sent, so neither a product in every basket nor a pair
in every basket is one task. A basket is cut into blocks of products, and each two blocks are one
row, so a huge basket is many tasks. Every pair that can be in the answer is counted in full.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from gridlore.operators.sales import TOP_PAIRS
from gridlore.plans.position import with_position
from gridlore.plans.shape import quoted
from gridlore.session import pin

# The functions run in tasks travel with them: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDELY_BOUGHT = 64
MIN_ROWS = 10
MIN_CUSTOMERS = 3
#: Products of a block of one basket.
BLOCK = 1024
#: Pairs that are expanded without looking for less work: so many, or so many per basket row.
EASY_PAIRS, EASY_PER_ROW = 2_000_000, 64

#: Pairs held by a task before they are sent, and pairs counted by one task.
RUN, PER_TASK = 1 << 22, 1 << 21
MOST_TASKS = 1 << 14
_ODD = 0x9E3779B97F4A7C15


def _numbers_within(lists: pa.ListArray, bits: int) -> Iterator[np.ndarray]:
    """Pair numbers (smaller product, larger product) of every two products of a list."""
    flat = lists.values.to_numpy().view(np.uint64)
    offsets = lists.offsets.to_numpy()
    starts, sizes = offsets[:-1], np.diff(offsets)
    for k in np.unique(sizes[sizes > 1]).tolist():
        rows = np.sort(flat[starts[sizes == k][:, None] + np.arange(k)], axis=1)
        i, j = np.triu_indices(k, 1)
        step = max(1, RUN // len(i))
        for at in range(0, len(rows), step):
            some = rows[at:at + step]
            yield ((some[:, i] << np.uint64(bits)) | some[:, j]).ravel()


def _numbers_between(left: pa.Array, right: pa.Array, bits: int) -> Iterator[np.ndarray]:
    """Pair numbers of a product of one list with one of the other."""
    for i in range(len(left)):
        a = left[i].values.to_numpy().view(np.uint64)[:, None]
        b = right[i].values.to_numpy().view(np.uint64)[None, :]
        yield ((np.minimum(a, b) << np.uint64(bits)) | np.maximum(a, b)).ravel()


def _summed(numbers: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers, ascending, with how often each occurs."""
    if counts is None:
        numbers = np.sort(numbers)
    else:
        order = np.argsort(numbers)
        numbers, counts = numbers[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
    if counts is None:
        return numbers[first], np.diff(np.append(first, len(numbers))).astype(np.int64)
    return numbers[first], np.add.reduceat(counts, first)


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, ...: the empty ones cost nothing when compressed."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _values(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _runs(batches: Iterator[pa.RecordBatch], bits: int, wide: int, parts: int) -> Iterator[pa.RecordBatch]:
    """One row per part and run: its hashed pair numbers as ascending differences, and their counts
    unless all are 1."""
    mask, shift = np.uint64((1 << wide) - 1), wide - (parts.bit_length() - 1)
    edges = np.arange(parts, dtype=np.uint64) << np.uint64(shift) if parts > 1 else np.zeros(1, np.uint64)

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        numbers, counts = _summed((np.concatenate(held) * np.uint64(_ODD)) & mask, None)
        cuts = np.append(np.searchsorted(numbers, edges), len(numbers))
        rows = []
        for part in np.flatnonzero(np.diff(cuts)).tolist():
            own, many = numbers[cuts[part]:cuts[part + 1]], counts[cuts[part]:cuts[part + 1]]
            rows.append((part, _planes(np.diff(own, prepend=np.uint64(0))), None if many.max() == 1 else _planes(many)))
        part, run, many = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(run, pa.binary()), pa.array(many, pa.binary())],
                                          ["part", "run", "counts"])

    held, size = [], 0
    for batch in batches:
        left, right = batch.column("a"), batch.column("b")
        alone = right.is_null()
        for numbers in _numbers_within(left.filter(alone), bits):
            held.append(numbers)
            size += len(numbers)
            if size >= RUN:
                yield sent(held)
                held, size = [], 0
        crossed = alone.to_numpy(zero_copy_only=False) == 0
        if crossed.any():
            for numbers in _numbers_between(left.filter(pa.array(crossed)), right.filter(pa.array(crossed)), bits):
                held.append(numbers)
                size += len(numbers)
                if size >= RUN:
                    yield sent(held)
                    held, size = [], 0
    if held:
        yield sent(held)


def _counted(batches: Iterator[pa.RecordBatch], bits: int, wide: int, least: int, first: int | None) -> Iterator[pa.RecordBatch]:
    """The pairs of the parts in a task, summed over the runs."""
    numbers, counts = [], []
    for batch in batches:
        for run, many in zip(batch.column("run"), batch.column("counts")):
            numbers.append(np.cumsum(_values(run.as_py()), dtype=np.uint64))
            counts.append(_values(many.as_py()).astype(np.int64) if many.is_valid else None)
    if not numbers:
        return
    ones = all(c is None for c in counts)
    weights = None if ones else np.concatenate([np.ones(len(x), np.int64) if c is None else c for x, c in zip(numbers, counts)])
    found, n = _summed(np.concatenate(numbers), weights)
    found, n = found[n >= least], n[n >= least]
    found = (found * np.uint64(pow(_ODD, -1, 1 << wide))) & np.uint64((1 << wide) - 1)
    if first is not None:
        best = np.lexsort((found, -n))[:first]
        found, n = found[best], n[best]
    for at in range(0, len(n), 1 << 16):
        some = found[at:at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array((some >> np.uint64(bits)).astype(np.int64)),
                                          pa.array((some & np.uint64((1 << bits) - 1)).astype(np.int64)), pa.array(n[at:at + (1 << 16)])],
                                         ["p1", "p2", "n"])


def _pair_counts(held: DataFrame, bits: int, least: int = 1, first: int | None = None,
                 expanded: tuple[int, int] | None = None) -> DataFrame:
    """(p1, p2, n) of the pairs that ``least`` or more baskets (__cust, __prod) hold, without
    repeats. Products are numbers of ``bits`` bits. Where only the ``first`` pairs are wanted,
    each task gives no more than so many."""
    pairs, largest = expanded or _expanded(held)
    if largest <= BLOCK:
        lists = held.groupBy("__cust").agg(F.collect_list("__prod").alias("a")).where(F.size("a") > 1)
        lists = lists.select("a", F.lit(None).cast("array<bigint>").alias("b"))
    else:
        sizes = held.groupBy("__cust").agg(F.count("*").alias("__size")).where("__size > 1")
        rows = held.join(sizes, "__cust").withColumn("__blocks", F.ceil(F.col("__size") / BLOCK).cast("int"))
        rows = rows.withColumn("__block", F.pmod(F.xxhash64("__prod"), F.col("__blocks")).cast("int"))
        blocks = rows.groupBy("__cust", "__blocks", "__block").agg(F.collect_list("__prod").alias("a"))
        left = blocks.select("__cust", "a", F.col("__block").alias("__i"),
                             F.explode(F.sequence("__block", F.col("__blocks") - 1)).alias("__j"))
        right = blocks.where("__block > 0").select(
            "__cust", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("__block") - 1)).alias("__i"), F.col("__block").alias("__j"))
        lists = left.join(right, ["__cust", "__i", "__j"], "left").where("__i = __j OR b IS NOT NULL").select("a", "b")
    parts = 1 << min(MOST_TASKS.bit_length() - 1, max(0, (pairs // PER_TASK).bit_length()))
    wide = max(2 * bits, MOST_TASKS.bit_length())
    runs = lists.mapInArrow(lambda b: _runs(b, bits, wide, parts), "part int, run binary, counts binary")
    return runs.repartitionById(parts, F.col("part")).mapInArrow(
        lambda b: _counted(b, bits, wide, least, first), "p1 bigint, p2 bigint, n bigint")


def _expanded(held: DataFrame) -> tuple[int, int]:
    """How many pairs of products the baskets hold, repeats included, and the largest basket."""
    sizes = held.groupBy("__cust").agg(F.count("*").cast("double").alias("k"))
    found = sizes.agg(F.sum(F.col("k") * (F.col("k") - 1) / 2), F.max("k")).first()
    return int(found[0] or 0), int(found[1] or 0)


def _floor(best: DataFrame, n: int) -> int:
    counts = [r["n"] for r in best.select("n").collect()]
    return min(counts) if len(counts) == n else 1


def cross_sell_pairs(df: DataFrame, customer: str = "customer", product: str = "product",
                     n: int = TOP_PAIRS, widely_bought: int = WIDELY_BOUGHT) -> DataFrame:
    """(product_1, product_2, frequency): the n pairs most customers bought both of.

    Needs 10 rows and 3 customers with two or more products, else the result is empty.
    Runs some small jobs when called, to learn the floor. Ties go to the first names.
    """
    spark = df.sparkSession
    lines = df.select(quoted(customer).alias("__cust"), quoted(product).cast("string").alias("__prod"))
    held = lines.where(F.col("__cust").isNotNull() & F.col("__prod").isNotNull())
    # Copies collapse before the shuffle; pinned, as several small jobs read the baskets.
    baskets = pin(held.groupBy("__cust", "__prod").agg(F.count("*").alias("__lines")))

    sizes = baskets.groupBy("__cust").agg(F.count("*").alias("__size"), F.sum("__lines").alias("__lines"))
    found = sizes.agg(F.count_if(F.col("__size") >= 2).alias("c"), F.sum("__lines").alias("r"), F.sum("__size").alias("rows")).first()
    if found["c"] < MIN_CUSTOMERS or (found["r"] or 0) < MIN_ROWS:
        return spark.createDataFrame([], "product_1 string, product_2 string, frequency bigint")

    # From here on a product is its place in the order of names.
    names = with_position(baskets.groupBy("__prod").agg(F.count("*").alias("__support")), ["__prod"], name="__no")
    bits = max(1, (names.count() - 1).bit_length())
    baskets = pin(baskets.join(names, "__prod").select("__cust", F.col("__no").alias("__prod"), "__support"))
    support = names.select(F.col("__no").alias("__prod"), "__support")
    named = lambda pairs: _named(pairs, names)
    bought = lambda least: baskets.where(F.col("__support") >= least).select("__cust", "__prod")
    easy = max(EASY_PAIRS, EASY_PER_ROW * found["rows"])
    order = [F.desc("n"), F.col("p1"), F.col("p2")]
    width, floor, best = widely_bought, 1, None
    while True:
        wide = support.orderBy(F.desc("__support"), "__prod").limit(width).select("__prod")
        among = baskets.select("__cust", "__prod").join(wide, "__prod", "left_semi")
        if best is not None and _expanded(among)[0] > min(easy, work // 4):
            break  # a wider list would cost about as much as the answer
        best = pin(_pair_counts(among, bits, first=n).orderBy(*order).limit(n))
        floor = max(floor, _floor(best, n))
        if not support.where(F.col("__support") >= floor).join(wide, "__prod", "left_anti").take(1):
            return named(best)
        work, largest = _expanded(bought(floor))
        if work <= easy:
            break
        width *= 8
    if work <= easy or floor > 8:  # few pairs, or few that equal the floor
        return named(pin(_best_from(bought(floor), bits, floor, n, (work, largest)).orderBy(*order).limit(n)))
    above = pin(_best_from(bought(floor + 1), bits, floor + 1, n).orderBy(*order).limit(n))
    missing = n - above.count()
    if missing <= 0:
        return named(above)
    ties = _first_by_name(bought(floor), support.where(F.col("__support") >= floor), floor, missing)
    return named(above.unionByName(ties))


def _first_by_name(held: DataFrame, support: DataFrame, count: int, n: int) -> DataFrame:
    """The first ``n`` pairs by name that were bought together exactly ``count`` times.

    Some first products at a time, and more each time, so pairs are counted only as far as
    the order of names needs it.
    """
    out, some, after = None, 8, None
    names = support.select("__prod")
    while True:
        rest = names if after is None else names.where(F.col("__prod") > after)
        last = rest.orderBy("__prod").limit(some).agg(F.max("__prod")).first()[0]
        if last is None:
            return out
        first = held.where(F.col("__prod") <= last)
        first = first if after is None else first.where(F.col("__prod") > after)
        pairs = first.select("__cust", F.col("__prod").alias("p1")).join(
            held.select("__cust", F.col("__prod").alias("p2")), "__cust").where("p1 < p2")
        pairs = pairs.groupBy("p1", "p2").agg(F.count("*").alias("n")).where(F.col("n") == count)
        found = pin(pairs.orderBy("p1", "p2").limit(n))
        n -= found.count()
        out = found if out is None else out.unionByName(found)
        if n <= 0:
            return out
        some, after = some * 4, last


def _best_from(kept: DataFrame, bits: int, floor: int, first: int, expanded: tuple[int, int] | None = None) -> DataFrame:
    """(p1, p2, n) of at least the ``first`` pairs that ``floor`` or more baskets hold, each in full."""
    pairs, largest = expanded or _expanded(kept)
    if (floor // 2) * largest * largest < pairs:  # the largest baskets hold less than half of the pairs
        return _pair_counts(kept, bits, floor, first, (pairs, largest))
    sizes = kept.groupBy("__cust").agg(F.count("*").alias("__size"))
    # Sizes above the bound belong to at most half the floor of customers.
    aside = floor // 2
    histogram = sizes.groupBy("__size").agg(F.count("*").alias("__n"))
    bound = _size_bound(histogram, aside)
    big = sizes.where(F.col("__size") > bound).select("__cust")
    small_baskets = kept.join(sizes.where((F.col("__size") <= bound) & (F.col("__size") > 1)), "__cust", "left_semi")
    big_baskets = kept.join(big, "__cust", "left_semi")

    light = _pair_counts(small_baskets, bits, max(1, floor - aside))
    heavy = (
        light.select("p1", "p2")
        .join(big_baskets.select("__cust", F.col("__prod").alias("p1")), "p1")
        .join(big_baskets.select("__cust", F.col("__prod").alias("p2")), ["__cust", "p2"], "left_semi")
        .groupBy("p1", "p2").agg(F.count("*").alias("n"))
    )
    full = light.unionByName(heavy).groupBy("p1", "p2").agg(F.sum("n").alias("n"))
    return full.where(F.col("n") >= floor)


def _size_bound(histogram: DataFrame, aside: int) -> int:
    """Smallest basket size such that at most ``aside`` baskets are larger.

    The largest ``aside + 1`` distinct sizes always contain it, and distinct sizes among
    baskets are few (their sum of squares is bounded by the data), so the histogram is
    summed by a window over distinct sizes, not over baskets.
    """
    from pyspark.sql import Window

    larger = F.coalesce(
        F.sum("__n").over(Window.orderBy(F.desc("__size")).rowsBetween(
            Window.unboundedPreceding, -1)),
        F.lit(0),
    )
    row = histogram.withColumn("__larger", larger).where(F.col("__larger") <= aside).agg(
        F.min("__size").alias("s")
    ).first()
    return int(row["s"] or 0)


def _named(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """The few pairs of the answer with the names of their products, the best first."""
    one, two = (F.broadcast(pairs).join(names.select(F.col("__no").alias(p), F.col("__prod").alias(name)), p)
                for p, name in (("p1", "product_1"), ("p2", "product_2")))
    both = one.join(F.broadcast(two.select("p1", "p2", "product_2")), ["p1", "p2"])
    return both.orderBy(F.desc("n"), "p1", "p2").select("product_1", "product_2", F.col("n").alias("frequency"))
