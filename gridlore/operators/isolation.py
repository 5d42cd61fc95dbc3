"""Isolation forest (Liu, Ting and Zhou, 2008): trees grown in parallel, rows scored in place.

Trees see at most 256 rows each, so only a sample of fixed size is shuffled; the finished
forest (at most 100 x 511 nodes) is broadcast, and every row of the table is scored in
Arrow batches where it lies.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridlore.functions.numeric import as_double, mean_of, rounded
from gridlore.functions.schema import columns_of
from gridlore.operators.fraud import MIN_VALUES, anomalies_small
from gridlore.plans.quantiles import column_quantiles
from gridlore.plans.shape import quoted
from gridlore.session import pin

# The functions run in tasks travel with them: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the method.
TREES = 100
SAMPLE = 256
#: Places drawn for each one that is needed, and most that a block of copies can get.
SPARE, MOST_PLACES = 1.5, 16
THRESHOLD = 0.5
HIGH = 0.7
TOP_ROWS = 20

NODES = "tree int, node int, feature int, cut double, left int, right int, depth double"


def average_path(n) -> np.ndarray:
    """Mean path length of an unsuccessful search in a tree over n rows."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    full = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, full, np.where(n == 2, 1.0, 0.0))


def grow_tree(values: np.ndarray, tree: int, seed: int) -> pd.DataFrame:
    """Random splits until rows are alone, equal or at the depth limit. A leaf has feature
    -1 and carries its expected path length in ``depth``."""
    rng = np.random.default_rng([seed, tree])
    limit = math.ceil(math.log2(max(len(values), 2)))
    nodes: list[list] = []
    todo = [(np.arange(len(values)), 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        at = len(nodes)
        if parent >= 0:
            nodes[parent][side] = at
        part = values[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(open_features):
            nodes.append([tree, at, -1, 0.0, -1, -1, depth + float(average_path(len(rows)))])
            continue
        feature = int(rng.choice(open_features))
        cut = rng.uniform(low[feature], high[feature])
        goes_left = part[:, feature] <= cut
        nodes.append([tree, at, feature, float(cut), -1, -1, 0.0])
        todo.append((rows[~goes_left], depth + 1, at, 5))
        todo.append((rows[goes_left], depth + 1, at, 4))
    return pd.DataFrame(nodes, columns=[c.split()[0] for c in NODES.split(", ")])


def _uniform(*of) -> Column:
    """A number from 0 to 1 that follows from the values."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / F.lit(float(1 << 53))


def _sample(rows: DataFrame, cols: Sequence[str], n: int, trees: int, seed: int,
            key: Sequence[str] | None) -> DataFrame:
    """(tree, __id, features): up to 256 rows for each tree, a draw of its own.

    A draw follows from the row's content and the number of the copy, or from a unique ``key``,
    never from partitions. Tables up to four times the size of all samples are drawn from tree
    by tree. Of larger ones a row is in at most one sample: contents are counted by their hash
    (with a key there is nothing to count), a content of c copies gets a Poisson number of
    places with the mean that c rows should have, each place belongs to a tree, and every tree
    keeps the 256 with the smallest draw. A content with very many copies stands for as many
    blocks of copies as it should have places, so none is more than the samples hold together.
    """
    features = [F.col(f"__f{i}") for i in range(len(cols))]
    content = list(map(quoted, key)) if key else features
    if n <= 4 * trees * SAMPLE:
        pool = rows.select(_uniform(F.lit(seed), *content).alias("__draw"), *features)
        # at most 4 * trees * SAMPLE rows; copies are equal, so it does not matter which comes first
        pool = pool.withColumn("__id", F.row_number().over(Window.orderBy("__draw", *features)))
        chance = min(1.0, 3.0 * SAMPLE / n)
        tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
        drawn = pool.select("__id", *features, tree).withColumn("__turn", _uniform("__id", "tree", F.lit(seed)))
        if chance < 1.0:
            drawn = drawn.where(F.col("__turn") < chance)
        return _smallest(drawn, "__id").select("tree", "__id", *features)

    rate = SPARE * trees * SAMPLE / n  # places per row, below 1
    most = math.floor(1 / rate)
    marks = [F.xxhash64(F.lit(seed), *content).alias("__h"), F.xxhash64(*content, F.lit(seed)).alias("__h2")]
    if key:
        blocks = rows.select(*marks, *features).withColumn("__b", F.lit(0)).withColumn("__mean", F.lit(rate))
    else:
        counted = rows.select(*marks).groupBy("__h", "__h2").agg(F.count("*").alias("__c"))
        blocks = counted.withColumn("__b", F.explode(F.sequence(F.lit(0), F.floor((F.col("__c") - 1) / most).cast("int"))))
        copies = F.least(F.col("__c") - F.col("__b") * most, F.lit(most))
        blocks = blocks.withColumn("__mean", copies * F.lit(rate))
    mean, luck = F.col("__mean"), _uniform("__h", "__h2", "__b")
    term, total, below = F.exp(-mean), F.exp(-mean), []
    for k in range(1, MOST_PLACES + 1):  # the mean is at most 1
        below.append((luck >= total).cast("int"))
        term = term * mean / k
        total = total + term
    blocks = blocks.where(luck >= F.exp(-mean)).withColumn("__n", sum(below[1:], below[0]))
    place = blocks.withColumn("__k", F.explode(F.sequence(F.lit(1), "__n"))).withColumn("__u", _uniform("__h", "__h2", "__b", "__k") * trees)
    place = place.withColumn("tree", F.floor("__u").cast("int")).withColumn("__turn", F.col("__u") - F.floor("__u"))
    drawn = _smallest(place, "__h", "__h2", "__b", "__k")
    number = F.xxhash64("__h", "__h2", "__b", "__k").alias("__id")
    if key:
        return drawn.select("tree", number, *features)
    drawn = pin(drawn.select("tree", number, F.col("__h").alias("__dh"), F.col("__h2").alias("__dh2")))
    # at most trees * SAMPLE rows are sent; one row of each content comes back
    found = rows.select(*marks, *features).join(F.broadcast(drawn.select("__dh", "__dh2").distinct()), (F.col("__h") == F.col("__dh")) & (
        F.col("__h2") == F.col("__dh2")), "left_semi").dropDuplicates(["__h", "__h2"])
    return drawn.join(found, (F.col("__h") == F.col("__dh")) & (F.col("__h2") == F.col("__dh2"))).select("tree", "__id", *features)


def _smallest(drawn: DataFrame, *ties: str) -> DataFrame:
    w = Window.partitionBy("tree").orderBy("__turn", *ties)
    return drawn.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= SAMPLE)


def forest_nodes(sample: DataFrame, width: int, seed: int) -> DataFrame:
    """Grows one tree per group of at most 256 rows."""
    names = [f"__f{i}" for i in range(width)]

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__id")
        return grow_tree(pdf[names].to_numpy(float), int(pdf["tree"].iloc[0]), seed)

    # a fixed number of partitions: AQE would merge samples this small into one task
    tasks = int(sample.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sample.repartition(tasks, "tree").groupBy("tree").applyInPandas(grow, NODES)


def pack_tree(nodes: pd.DataFrame) -> tuple:
    """Arrays of one tree: a leaf leads to itself, so every row may take the same number
    of steps. ``child`` holds the left and right child of node i at 2i and 2i + 1."""
    feature, at = nodes["feature"].to_numpy(), nodes["node"].to_numpy()
    leaf = feature < 0
    child = np.empty(2 * len(nodes), dtype=np.int64)
    child[0::2] = np.where(leaf, at, nodes["left"])
    child[1::2] = np.where(leaf, at, nodes["right"])
    cut = np.where(leaf, np.inf, nodes["cut"])
    return np.where(leaf, 0, feature).astype(np.int64), cut, child, nodes["depth"].to_numpy(float)


def path_score(values: np.ndarray, forest: list[tuple], rows_per_tree: int) -> np.ndarray:
    """2 ** (-mean path / expected path): near 1 for rows that are easy to isolate."""
    rows, width = values.shape
    flat, start = np.ascontiguousarray(values).ravel(), np.arange(rows) * width
    steps = math.ceil(math.log2(max(rows_per_tree, 2)))
    total = np.zeros(rows)
    for feature, cut, child, depth in forest:
        at = np.zeros(rows, dtype=np.int64)
        for _ in range(steps):
            right = flat.take(start + feature.take(at)) > cut.take(at)
            at = child.take(2 * at + right)
        total += depth.take(at)
    return np.exp2(-total / len(forest) / max(float(average_path(rows_per_tree)), 1e-12))


def score_rows(df: DataFrame, cols: Sequence[str] | None = None, seed: int = 42,
               trees: int = TREES, key: Sequence[str] | None = None) -> DataFrame | None:
    """The table plus ``score``, ``column`` and ``value`` (the cell furthest from its mean in
    standard deviations); None below 5 rows. Learns the forest when called."""
    cols = list(cols or columns_of(df, "numeric"))
    rows = df.withColumns({f"__f{i}": as_double(quoted(c)) for i, c in enumerate(cols)})
    names = [f"__f{i}" for i in range(len(cols))]
    rows = rows.where(F.coalesce(*names).isNotNull())
    stats = rows.agg(F.count("*"), *[F.count(f) for f in names], *[mean_of(F.col(f)) for f in names],
                     *[F.stddev_samp(f) for f in names]).first()
    n, k = stats[0], len(cols)
    if n < MIN_VALUES:
        return None
    filled, means, sds = stats[1:k + 1], stats[k + 1:2 * k + 1], stats[2 * k + 1:]
    short = [f for f, m in zip(names, filled) if 0 < m < n]
    medians = {}
    if short:
        medians = {r["column"]: r["q0"] for r in column_quantiles(rows, short, [0.5]).collect()}
    rows = rows.withColumns({f: F.coalesce(f, F.lit(medians.get(f, 0.0))) for f in names})
    sample = _sample(rows, cols, n, trees, seed, key)
    nodes = forest_nodes(sample, k, seed).toPandas().sort_values(["tree", "node"])
    forest = [pack_tree(tree) for _, tree in nodes.groupby("tree")]
    shared = df.sparkSession.sparkContext.broadcast(forest)
    per_tree = min(SAMPLE, n)

    @F.pandas_udf("double")
    def isolation(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        grown = shared.value
        for batch in batches:
            yield pd.Series(path_score(batch.to_numpy(float), grown, per_tree))

    isolation_score = isolation(F.struct(*names))
    away = [
        F.struct(F.abs((F.col(f) - F.lit(m)) / F.lit(s)).alias("z"), F.lit(c).alias("column"),
                 F.col(f).alias("value"))
        for f, c, m, s in zip(names, cols, means, sds) if s
    ] or [F.struct(F.lit(0.0).alias("z"), F.lit(cols[0]).alias("column"), F.col(names[0]).alias("value"))]
    worst = F.array_max(F.array(*away))
    return rows.withColumn("score", isolation_score).withColumn("__worst", worst).withColumns(
        {"column": F.col("__worst.column"), "value": F.col("__worst.value")}).drop("__worst", *names)


def isolation_results(df: DataFrame, cols: Sequence[str] | None = None, ids: Sequence[str] = (),
                      seed: int = 42, trees: int = TREES, key: Sequence[str] | None = None,
                      n: int | None = TOP_ROWS) -> tuple[DataFrame, DataFrame]:
    """The n rows with the highest score above 0.5, and all rows above it, of one forest."""
    cols = list(cols or [c for c in columns_of(df, "numeric") if c not in ids])
    scored = score_rows(df, cols, seed, trees, key)
    if scored is None:
        small = anomalies_small(df, cols, ids)
        return small, small
    found = scored.where(F.col("score") > THRESHOLD)
    best = found
    if n is not None:
        best = found.orderBy(F.desc("score"), *map(quoted, ids), "column", "value").limit(n)
    return tuple(part.select(
        *map(quoted, ids), "column", "value", rounded(F.col("score"), 4).alias("score"),
        F.when(F.col("score") > HIGH, "high").otherwise("medium").alias("severity")) for part in (best, found))


def isolation_forest(df: DataFrame, cols: Sequence[str] | None = None, ids: Sequence[str] = (),
                     seed: int = 42, trees: int = TREES, key: Sequence[str] | None = None,
                     n: int | None = TOP_ROWS) -> DataFrame:
    """(ids, column, value, score, severity): the n rows with the highest score above 0.5,
    or all of them if n is None.

    The raw score is reported; above 0.7 is high. Below 5 rows z-scores are used instead.
    """
    return isolation_results(df, cols, ids, seed, trees, key, n)[0]
