"""Approximate nearest neighbours by a forest of sorted hash-string arrays.

Each tree hashes a vector to a long bit string (signs along random directions) and keeps
all strings sorted. A query descends to its longest common prefix in every tree, and then
ascends all trees together, one bit at a time, until the rows that share the prefixes are
enough; all of them are compared on the original vectors.

A sorted array is cut into chunks. Equal vectors would share every prefix, so they are one
entry with its smallest ids, which is all a top k can name. A chunk that holds too many rows
all the same, because near copies share a string or the sample is too coarse, is dealt into
salts by a hash of the rows, and one that too many queries reach into parts of the queries;
each salt meets each part, so a task's memory is bounded and no pair is left out.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridlore.llm.store import keep

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREES = 16
#: Length of a hash string.
BITS = 48
#: Rows sampled for the centre and for the chunk limits.
FIT_ROWS = 8192
#: Entries of a chunk or of one of its salts, and queries of one of its parts, about.
CHUNK = 65_536
#: Rows of a batch that is handed on.
BATCH = 8192
#: A query ascends until its prefixes hold, per tree, this share of all rows and at least so many.
SHARE, LEAST = 0.05, 512


def usable(vector: str) -> Column:
    """Not null, not empty, all components present and finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


class Forest:
    """Directions and centre of the hash, and the chunk limits of every tree."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int, bits: int, chunk: int, seed: int):
        rng = np.random.default_rng(seed)
        dims = sample.shape[1]
        self.bits, self.centre = bits, (sample / len(sample)).sum(axis=0)
        self.directions = []
        for _ in range(trees):
            parts = [np.linalg.qr(rng.normal(size=(dims, dims)))[0] for _ in range(-(-bits // dims))]
            self.directions.append(np.concatenate(parts, axis=1)[:, :bits])
        pieces = max(1, math.ceil(rows / chunk))
        codes = [np.sort(self.code(sample, t)) for t in range(trees)]
        at = (np.arange(1, pieces) * len(sample) // pieces).astype(int)
        self.limits = [np.unique(c[at]) for c in codes]

    def code(self, vectors: np.ndarray, tree: int) -> np.ndarray:
        on = (vectors - self.centre) @ self.directions[tree] > 0
        return on.astype(np.int64) @ (np.int64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.int64))

    def span(self, code: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last string that share the first ``level`` bits."""
        open_ = np.int64(self.bits) - level
        low = code >> open_ << open_
        return low, low + (np.int64(1) << open_) - 1

    def chunks(self, codes: np.ndarray, level: np.ndarray | np.int64, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """First chunk and number of chunks that hold the strings with the first ``level`` bits."""
        low, high = self.span(codes, level)
        first = np.searchsorted(self.limits[tree], low, side="right")
        return first, np.searchsorted(self.limits[tree], high, side="right") - first + 1


def _each(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every index as often as ``n`` says, and the numbers from 0 beside it."""
    at = np.repeat(np.arange(len(n)), n)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)


def _cuts(df: DataFrame, shared, trees: int, size: int) -> list[np.ndarray]:
    """Into how many pieces of about ``size`` rows each chunk of each tree is dealt, from
    counts; a row is in all chunks of its prefix if it has a level, else in its own one."""
    forest = shared.value
    cuts = [np.ones(len(limits) + 1, dtype=np.int64) for limits in forest.limits]
    if df.count() <= size:
        return cuts
    routed = "level" in df.columns

    def run(batches):
        forest = shared.value
        held = [np.zeros(len(limits) + 1, dtype=np.int64) for limits in forest.limits]
        for batch in batches:
            vectors = _matrix(batch.column("v"))
            level = batch.column("level").to_numpy() if routed else np.int64(forest.bits)
            for tree in range(trees if batch.num_rows else 0):
                first, n = forest.chunks(forest.code(vectors, tree), level, tree)
                steps = np.zeros(len(held[tree]) + 1, dtype=np.int64)
                np.add.at(steps, first, 1)
                np.add.at(steps, first + n, -1)
                held[tree] += np.cumsum(steps)[:-1]
        for tree, n in enumerate(held):
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), tree)), pa.array(at), pa.array(n[at])], ["tree", "chunk", "n"])

    counts = df.select("v", *["level"] * routed).mapInArrow(run, "tree bigint, chunk bigint, n bigint")
    for r in counts.groupBy("tree", "chunk").agg(F.sum("n").alias("n")).where(F.col("n") > size).collect():
        cuts[r["tree"]][r["chunk"]] = -(-r["n"] // size)
    return cuts


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(flat.flatten(), dtype=np.float64).reshape(len(flat), -1) if len(flat) else np.empty((0, 1))


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances; where squares leave the range of a double, by scaled differences."""
    with np.errstate(over="ignore", under="ignore"):
        apart = rows - query
        near = np.sqrt((apart * apart).sum(axis=1))
        odd = np.flatnonzero(~((near > 1e-140) & (near < 1e140)))
        if len(odd):
            most = np.abs(apart[odd]).max(axis=1)
            scale = np.where((most > 0) & np.isfinite(most), most, 1.0)[:, None]
            near[odd] = scale[:, 0] * np.sqrt(((apart[odd] / scale) ** 2).sum(axis=1))
    return near


def search(table: DataFrame, queries: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding",
           trees: int = TREES, share: float = SHARE, least: int = LEAST, seed: int = 17) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance in double precision): the
    ``k`` nearest found of every row that ``queries`` selects, among all other rows.

    Ties go to the smaller id. Rows with a null id, a null, empty or zero vector, one with
    a null or non-finite component, or with another length than most of the sample take no
    part. Rows with the same id count as one per distinct vector, as candidates and as queries
    (each has a list of its own), and never find each other. Finite vectors of any size take
    part; a distance beyond the largest double is infinite and comes last. Fewer candidates than ``k`` give fewer rows; an empty table none. Other columns are not
    read. The centre and the chunk limits are fitted on FIT_ROWS rows (those of smallest
    hash); every row is in the index.
    """
    spark = table.sparkSession
    rows = table.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"),
                        F.coalesce(queries, F.lit(False)).alias("asks")).where(F.col("vec_id").isNotNull() & usable("v"))
    sample = [np.array(r["v"]) for r in rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").select("v").limit(FIT_ROWS).collect()]
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if not sample:
        return spark.createDataFrame([], result)
    dims = int(np.bincount([len(v) for v in sample]).argmax())
    rows = rows.where(F.size("v") == dims)
    same = Window.partitionBy("v").orderBy("vec_id")
    mix = F.xxhash64("vec_id", "v", F.lit(seed)).bitwiseAND(F.lit(2 ** 62 - 1)).alias("mix")
    entries = keep(rows.select("vec_id", "v").distinct().withColumn("at", F.row_number().over(same)).where(
        F.col("at") <= k + 1).select("vec_id", "v", mix), "entries")
    asked = keep(rows.where("asks").select(F.col("vec_id").alias("query_id"), "v", mix).distinct(), "queries")
    n = entries.count()
    forest = Forest(np.array([v for v in sample if len(v) == dims]), n, trees, BITS, CHUNK, seed)
    shared = spark.sparkContext.broadcast(forest)
    enough = max(least, math.ceil(share * n)) * trees

    salts = _cuts(entries, shared, trees, CHUNK)
    levels = _levels(entries, asked, shared, trees, enough, salts)
    found = _found(entries, keep(asked.join(levels, ["query_id", "mix"]), "levels"), shared, trees, k, salts)
    best = Window.partitionBy("query_id", "query_mix").orderBy("score", "vec_id", "mix")
    merged = found.groupBy("query_id", "query_mix", "vec_id", "mix").agg(F.min("score").alias("score"))
    ranked = merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _levels(entries: DataFrame, asked: DataFrame, shared, trees: int, enough: int, salts: list) -> DataFrame:
    """(query_id, mix, level): the longest prefix at which all trees together hold enough rows.

    A query counts in the chunk where it stands, in all its salts; a chunk holds many times
    the rows needed, so rows beyond its ends can only make a level richer than counted, never
    poorer.
    """
    cuts = entries.sparkSession.sparkContext.broadcast((salts, _cuts(asked, shared, trees, CHUNK)))

    def code(key):
        def run(batches):
            forest, mine = shared.value, cuts.value[bool(key)]
            others = cuts.value[not key]
            for batch in batches:
                vectors, mix = _matrix(batch.column("v")), batch.column("mix").to_numpy()
                ids = batch.column("query_id") if key else pa.nulls(batch.num_rows, pa.int64())
                for tree in range(trees if batch.num_rows else 0):
                    codes = forest.code(vectors, tree)
                    chunk = np.searchsorted(forest.limits[tree], codes, side="right")
                    at, other = _each(others[tree][chunk])
                    own = mix[at] % mine[tree][chunk[at]]
                    for i in range(0, len(at), BATCH):
                        now = slice(i, i + BATCH)
                        salt, part = (other[now], own[now]) if key else (own[now], other[now])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(salt), tree)), pa.array(chunk[at[now]]), pa.array(salt), pa.array(part),
                             pa.array(codes[at[now]]), ids.take(pa.array(at[now])), pa.array(mix[at[now]])],
                            ["tree", "chunk", "salt", "part", "code", "query_id", "mix"])
        return run

    kind = "tree bigint, chunk bigint, salt bigint, part bigint, code bigint, query_id bigint, mix bigint"
    both = entries.mapInArrow(code(False), kind).union(asked.mapInArrow(code(True), kind))

    def count(key, table):
        forest = shared.value
        codes, ids = table.column("code").to_numpy(), table.column("query_id")
        asks = ids.is_valid().to_numpy()
        held, mine = np.sort(codes[~asks]), codes[asks]
        counts = []
        for level in range(forest.bits + 1):
            low, high = forest.span(mine, np.int64(level))
            counts.append(np.searchsorted(held, high, side="right") - np.searchsorted(held, low, side="left"))
        flat = np.array(counts).T.reshape(-1)
        width = forest.bits + 1
        return pa.table({"query_id": np.repeat(ids.filter(ids.is_valid()).to_numpy(), width),
                         "mix": np.repeat(table.column("mix").to_numpy()[asks], width),
                         "level": np.tile(np.arange(width), len(mine)), "n": flat.astype(np.int64)})

    parts = both.groupBy("tree", "chunk", "salt", "part").applyInArrow(count, "query_id bigint, mix bigint, level bigint, n bigint")
    held = parts.groupBy("query_id", "mix", "level").agg(F.sum("n").alias("n"))
    good = F.max(F.when(F.col("n") >= enough, F.col("level")))
    return held.groupBy("query_id", "mix").agg(F.coalesce(good, F.lit(0)).alias("level"))


def _found(entries: DataFrame, asked: DataFrame, shared, trees: int, k: int, salts: list) -> DataFrame:
    """(query_id, query_mix, vec_id, mix, score): the nearest rows under a query's prefix, per tree, chunk and salt."""
    cuts = entries.sparkSession.sparkContext.broadcast((salts, _cuts(asked, shared, trees, CHUNK)))
    columns = ["tree", "chunk", "salt", "part", "code", "id", "mix", "level", "v"]

    def place(batches):
        forest, (salts, parts) = shared.value, cuts.value
        for batch in batches:
            vectors, mix = _matrix(batch.column("v")), batch.column("mix").to_numpy()
            for tree in range(trees if batch.num_rows else 0):
                codes = forest.code(vectors, tree)
                chunk = np.searchsorted(forest.limits[tree], codes, side="right")
                salt = mix % salts[tree][chunk]
                rows, parted = _each(parts[tree][chunk])
                for i in range(0, len(rows), BATCH):
                    at, part = rows[i:i + BATCH], parted[i:i + BATCH]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), tree)), pa.array(chunk[at]), pa.array(salt[at]), pa.array(part),
                         pa.array(codes[at]), batch.column("vec_id").take(pa.array(at)), pa.array(mix[at]),
                         pa.array(np.full(len(at), -1)), batch.column("v").take(pa.array(at))], columns)

    def route(batches):
        forest, (salts, parts) = shared.value, cuts.value
        for batch in batches:
            vectors, level, mix = _matrix(batch.column("v")), batch.column("level").to_numpy(), batch.column("mix").to_numpy()
            for tree in range(trees if batch.num_rows else 0):
                codes = forest.code(vectors, tree)
                first, n = forest.chunks(codes, level, tree)
                rows, nth = _each(n)
                chunks = first[rows] + nth
                stands, salted = _each(salts[tree][chunks])
                for i in range(0, len(stands), BATCH):
                    to = stands[i:i + BATCH]
                    at, chunk = rows[to], chunks[to]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), tree)), pa.array(chunk), pa.array(salted[i:i + BATCH]),
                         pa.array(mix[at] % parts[tree][chunk]), pa.array(codes[at]),
                         batch.column("query_id").take(pa.array(at)), pa.array(mix[at]), pa.array(level[at]), batch.column("v").take(pa.array(at))],
                        columns)

    def compare(key, table):
        forest = shared.value
        level = table.column("level").to_numpy()
        held, asks = np.flatnonzero(level < 0), np.flatnonzero(level >= 0)
        vectors, codes, ids = _matrix(table.column("v")), table.column("code").to_numpy(), table.column("id").to_numpy()
        mixes = table.column("mix").to_numpy()
        held = held[np.argsort(codes[held], kind="stable")]
        low, high = forest.span(codes[asks], level[asks])
        first = np.searchsorted(codes[held], low, side="left")
        last = np.searchsorted(codes[held], high, side="right")
        base, names, marks = vectors[held], ids[held], mixes[held]
        out = []
        for q, a, b in zip(asks.tolist(), first.tolist(), last.tolist()):
            near = distances(base[a:b], vectors[q])
            others = np.flatnonzero(names[a:b] != ids[q])
            if len(others) > 2 * k:
                bound = np.partition(near[others], k - 1)[k - 1]
                others = others[near[others] <= bound]
            at = others[np.lexsort((marks[a:b][others], names[a:b][others], near[others]))][:k]
            out.append((np.full(len(at), ids[q]), np.full(len(at), mixes[q]), names[a:b][at], marks[a:b][at], near[at]))
        cols = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 4 + [np.empty(0)]
        return pa.table(dict(zip(("query_id", "query_mix", "vec_id", "mix"), (c.astype(np.int64) for c in cols))) | {"score": cols[4]})

    kind = "tree bigint, chunk bigint, salt bigint, part bigint, code bigint, id bigint, mix bigint, level bigint, v array<double>"
    both = entries.mapInArrow(place, kind).union(asked.select("query_id", "level", "v", "mix").mapInArrow(route, kind))
    return both.groupBy("tree", "chunk", "salt", "part").applyInArrow(
        compare, "query_id bigint, query_mix bigint, vec_id bigint, mix bigint, score double")
