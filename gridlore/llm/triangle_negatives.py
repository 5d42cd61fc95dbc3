"""Hard negatives by the triangle inequality on angles.

Every row stores its norm and its angles to some reference directions. Angles obey the triangle
inequality, so the angle between an anchor and a row lies between the difference and the sum of
their angles to any reference; its cosine, times both norms and widened by more than the rounding
can be, bounds their integer score. Rows stand in strips of similar angles with the strip's
smallest and largest angle and norm. Only strips whose bounds reach an anchor's window, the
scores that can still change its answer, are scored.

Rows are dealt into groups by label bucket and nearest reference and, where a group is large, by
a hash; anchors into parts. Every part meets every group that its answers can come from: all
groups of its label's bucket for positives, all groups for negatives. So a task's rows are
bounded, and the work is anchors times rows less what the windows spare.
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

#: Reference directions, and rows of smallest hash that they are chosen from.
REFERENCES, FIT_ROWS = 16, 2048
#: Labels are dealt into so many buckets.
BUCKETS = 16
#: Rows of a group and anchors of a part, about.
GROUP, PART = 65_536, 16_384
#: Rows of a strip, and anchors that are bounded at once.
STRIP, STEP = 256, 512
#: Positives of an anchor and negatives of a positive.
POSITIVES, NEGATIVES = 5, 5
#: A negative has at least this share of the positive's score, as a fraction of whole numbers.
LEAST = (80, 100)
#: Squared norms from here on give scores beyond a long.
_MOST = float(1 << 62)
_LOW = -(1 << 62)


def whole_parts(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """vec_id, label, v: the rows that take part, each component x as floor(scale * x).

    A null id, label or vector, an empty vector, a null or non-finite component leave a row out,
    and so does a scaled vector of length 2**31 or more, whose scores need not fit a long.
    """
    rows = table.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"),
                        F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0 ** 31))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    rows = rows.where((F.size("v") > 0) & F.coalesce(finite, F.lit(False)))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")))
    return rows.where(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) < _MOST)


class References:
    """Directions that rows' angles are measured to."""

    def __init__(self, sample: np.ndarray, count: int):
        units = _units(sample)
        chosen = [0]
        near = units @ units[0]
        while len(chosen) < min(count, len(units)):  # each next one is furthest from all before
            chosen.append(int(near.argmin()))
            near = np.maximum(near, units @ units[chosen[-1]])
        self.directions = units[chosen]

    def angles(self, vectors: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(_units(vectors) @ self.directions.T, -1.0, 1.0))


def _units(vectors: np.ndarray) -> np.ndarray:
    norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.where(norms > 0, vectors / np.where(norms > 0, norms, 1.0), 1.0 / math.sqrt(vectors.shape[1]))


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products of whole-numbered vectors."""
    if not len(anchors) or not len(rows):
        return np.zeros((len(anchors), len(rows)), np.int64)
    most = np.abs(anchors).sum(axis=1).max() * np.abs(rows).max()
    if most < 2.0 ** 53:  # no partial sum is rounded
        return (anchors @ rows.T).astype(np.int64)
    exact = anchors.astype(np.int64)  # sums wrap around modulo 2**64, and the result fits
    return exact @ rows.astype(np.int64).T


class Strips:
    """A group's rows in strips of similar angles, with the bounds of each strip."""

    def __init__(self, vectors: np.ndarray, angles: np.ndarray):
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        nearest = angles.argmin(axis=1)
        self.order = np.lexsort((norms, angles.min(axis=1), nearest))
        self.starts = np.arange(0, len(vectors), STRIP)
        angles, norms = angles[self.order], norms[self.order]
        self.vectors = vectors[self.order]
        self.low, self.high = np.minimum.reduceat(angles, self.starts), np.maximum.reduceat(angles, self.starts)
        self.short, self.long = np.minimum.reduceat(norms, self.starts), np.maximum.reduceat(norms, self.starts)

    def bounds(self, vectors: np.ndarray, angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of each anchor (rows) in each strip (columns)."""
        norms = np.sqrt((vectors * vectors).sum(axis=1))[:, None]
        near = np.zeros((len(vectors), len(self.starts)))
        far = np.full_like(near, math.pi)
        for r in range(angles.shape[1]):
            a = angles[:, r][:, None]
            np.maximum(near, np.maximum(a - self.high[:, r], self.low[:, r] - a), out=near)
            np.minimum(far, np.minimum(a + self.high[:, r], 2 * math.pi - a - self.low[:, r]), out=far)
        # arc cosines near 0 and pi lose half the digits; a zero vector has score 0 at any angle
        near, far = np.cos(np.maximum(near - 1e-7, 0.0)), np.cos(np.minimum(far + 1e-7, math.pi))
        top = np.where(near > 0, self.long, self.short) * near * norms
        least = np.where(far > 0, self.short, self.long) * far * norms
        slack = norms * self.long * 1e-9 + 1.0
        return least - slack, top + slack

    def rows(self, strip: int) -> slice:
        return slice(self.starts[strip], self.starts[strip] + STRIP)


def _kept(score: np.ndarray, ids: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id."""
    if len(score) > 4 * k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= floor)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((keys[at], ids[at], -score[at]))][:k]


class _Best:
    """The ``k`` best rows so far of one anchor or positive, and the score that can still enter."""

    __slots__ = ("score", "place", "floor")

    def __init__(self, floor: int):
        self.score = self.place = np.empty(0, np.int64)
        self.floor = floor

    def take(self, score: np.ndarray, place: np.ndarray, ids: np.ndarray, keys: np.ndarray, k: int) -> None:
        score, place = np.concatenate([self.score, score]), np.concatenate([self.place, place])
        at = _kept(score, ids[place], keys[place], k)
        self.score, self.place = score[at], place[at]
        if len(at) == k:
            self.floor = int(self.score[-1])


def nearest_of_label(strips: Strips, held: dict, asks: dict, k: int) -> list[_Best]:
    """For each anchor the ``k`` best other rows of its label."""
    ids, keys, labels = (held[c][strips.order] for c in ("id", "key", "label"))
    best = [_Best(_LOW) for _ in asks["id"]]
    for i in range(0, len(best), STEP):
        now = slice(i, i + STEP)
        mine, label = best[now], asks["label"][now]
        _, top = strips.bounds(asks["v"][now], asks["angles"][now])
        for strip in np.argsort(-top.max(axis=0), kind="stable"):
            floor = np.array([b.floor for b in mine])
            open_ = np.flatnonzero(top[:, strip] >= floor)
            rows = strips.rows(strip)
            found = scores(asks["v"][now][open_], strips.vectors[rows])
            fits = (found >= floor[open_][:, None]) & (label[open_][:, None] == labels[rows])
            for n in np.flatnonzero(fits.any(axis=1)):
                a, at = open_[n], np.flatnonzero(fits[n])
                own = (ids[rows][at] == asks["id"][i + a]) & (keys[rows][at] == asks["key"][i + a])
                at = at[~own]
                mine[a].take(found[n][at], at + rows.start, ids, keys, k)
    return best


def window_of_others(strips: Strips, held: dict, asks: dict, k: int) -> list[_Best]:
    """For each score of each anchor the ``k`` best rows of other labels within its window."""
    ids, keys, labels = (held[c][strips.order] for c in ("id", "key", "label"))
    tops, ends = asks["tops"], asks["ends"]
    whole, part = np.divmod(tops, LEAST[1])
    low = LEAST[0] * whole - (-LEAST[0] * part // LEAST[1])  # the least whole score in the window
    best = [_Best(int(x)) for x in low]
    starts = ends - np.diff(ends, prepend=0)
    for i in range(0, len(ends), STEP):
        now = slice(i, i + STEP)
        own = [[j for j in range(a, b) if low[j] <= tops[j]] for a, b in zip(starts[now], ends[now])]
        least, top = strips.bounds(asks["v"][now], asks["angles"][now])
        high = np.array([max([tops[j] for j in js], default=_LOW) for js in own], np.int64)
        floor = np.array([min([best[j].floor for j in js], default=-_LOW) for js in own], np.int64)
        label = asks["label"][now]
        for strip in np.argsort(-top.max(axis=0), kind="stable"):
            open_ = np.flatnonzero((top[:, strip] >= floor) & (least[:, strip] <= high))
            rows = strips.rows(strip)
            found = scores(asks["v"][now][open_], strips.vectors[rows])
            fits = (found >= floor[open_][:, None]) & (found <= high[open_][:, None]) & (label[open_][:, None] != labels[rows])
            for n in np.flatnonzero(fits.any(axis=1)):
                a, at = open_[n], np.flatnonzero(fits[n])
                score = found[n][at]
                for j in own[a]:
                    here = (score >= best[j].floor) & (score <= tops[j])
                    if here.any():
                        best[j].take(score[here], at[here] + rows.start, ids, keys, k)
                floor[a] = min(best[j].floor for j in own[a])
    return best


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(flat.flatten(), dtype=np.float64).reshape(len(flat), -1) if len(flat) else np.empty((0, 1))


def mine(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         group: int = GROUP, part: int = PART, seed: int = 23) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``rows``: vec_id, label, v as ``whole_parts`` gives them; ``anchors`` says which rows ask. An
    anchor's positives are the ``positives`` highest-scoring other rows of its label; each gives
    the ``negatives`` highest-scoring rows of another label whose score lies in its window. Scores
    are integer inner products, ties go to the smaller id. Rows equal in id, label and vector
    count once; unequal rows under one id are rows of their own, also as anchors, and give rows
    each. Vectors of another length than most of the sample take no part. Fewer rows than asked
    for give fewer; an empty table none; other columns are not read. Zero vectors take part with
    score 0. The references are chosen from FIT_ROWS rows and decide the speed only.
    """
    spark = rows.sparkSession
    kind = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    rows = rows.select("vec_id", "label", "v", F.coalesce(anchors, F.lit(False)).alias("asks"),
                       F.xxhash64("label", "v", F.lit(seed)).alias("key"))
    sample = [np.array(r["v"]) for r in rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id", "key").select("v").limit(FIT_ROWS).collect()]
    if not sample:
        return spark.createDataFrame([], kind)
    dims = int(np.bincount([len(v) for v in sample]).argmax())
    shared = spark.sparkContext.broadcast(References(np.array([v for v in sample if len(v) == dims]), REFERENCES))

    def place(batches):
        references = shared.value
        for batch in batches:
            if batch.num_rows:
                angles = references.angles(_matrix(batch.column("v")))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(angles) + 1) * angles.shape[1], pa.int32()), pa.array(angles.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, flat, pa.array(angles.argmin(axis=1), pa.int32())],
                                                 [*batch.schema.names, "angles", "cell"])

    distinct = rows.where(F.size("v") == dims).dropDuplicates(["vec_id", "label", "v"])
    entries = keep(distinct.mapInArrow(
        place, "vec_id bigint, label bigint, v array<double>, asks boolean, key bigint, angles array<double>, cell int").withColumn(
        "bucket", F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int")), "entries")

    counts = entries.groupBy("bucket", "cell").agg(F.count("*").alias("n"), F.count(F.when(F.col("asks"), 1)).alias("m")).collect()
    salts = {(r["bucket"], r["cell"]): -(-r["n"] // group) for r in counts}  # at most BUCKETS * REFERENCES entries
    here = {b: sum(r["m"] for r in counts if r["bucket"] == b) for b in range(BUCKETS)}
    spread = F.pmod(F.xxhash64("vec_id", "key", F.lit(seed)), F.lit(1 << 30)).cast("int")

    def table_of(pairs: dict) -> Column:
        return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])

    salt_of = table_of({b * REFERENCES + c: n for (b, c), n in salts.items()})

    def salted(bucket: int, cell: int, n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: F.struct(
            F.lit(bucket).alias("bucket"), F.lit(cell).alias("cell"), s.alias("salt")))

    groups = F.flatten(F.array(*[salted(b, c, n) for (b, c), n in sorted(salts.items())]))
    none = F.array().cast("array<bigint>").alias("scores")

    def laid(parts: dict, asks: DataFrame, near: bool) -> DataFrame:
        """Rows in all parts of their group, anchors in their part of all groups that they ask."""
        many = table_of(parts)
        held = entries.select(
            "bucket", "cell", (spread % salt_of[F.col("bucket") * REFERENCES + F.col("cell")]).alias("salt"),
            F.explode(F.sequence(F.lit(0), many[F.col("bucket")] - 1)).alias("part"), F.col("vec_id").alias("id"), "key",
            "label", "v", "angles", none, F.lit(False).alias("asks"))
        to = F.filter(groups, lambda g: g["bucket"] == F.col("bucket")) if near else groups
        asks = asks.withColumn("to", F.explode(to))
        asks = asks.select("to.bucket", "to.cell", "to.salt", (spread % many[F.col("to.bucket")]).alias("part"), F.col("vec_id").alias("id"),
                           "key", "label", "v", "angles", "scores", F.lit(True).alias("asks"))
        return held.unionByName(asks)

    def solve(near: bool, k: int):
        def run(key, table):
            is_ask = table.column("asks").to_numpy()
            held, asks = ({"v": _matrix(part.column("v")), "angles": _matrix(part.column("angles")),
                           **{c: part.column(c).to_numpy() for c in ("id", "key", "label")}} for part in (
                               table.filter(pa.array(~is_ask)), table.filter(pa.array(is_ask))))
            n, tops = len(asks["id"]), asks["id"]
            who = np.arange(n)
            if not near:
                lists = table.filter(pa.array(is_ask)).column("scores").combine_chunks()
                size = lists.value_lengths().to_numpy()
                tops, who = lists.flatten().to_numpy(), np.repeat(who, size)
                asks |= {"tops": tops, "ends": np.cumsum(size)}
            best, order = [], np.empty(0, np.int64)
            if n and len(held["id"]):
                strips = Strips(held["v"], held["angles"])
                best, order = (nearest_of_label if near else window_of_others)(strips, held, asks, k), strips.order
            nth = np.repeat(np.arange(len(best)), [len(b.place) for b in best])
            at = order[np.concatenate([b.place for b in best] or [np.empty(0, np.int64)])]
            return pa.table({
                "id": asks["id"][who[nth]], "key": asks["key"][who[nth]], "top": tops[nth], "other": held["id"][at],
                "other_key": held["key"][at], "score": np.concatenate([b.score for b in best] or [np.empty(0, np.int64)])})
        return run

    found_kind = "id bigint, key bigint, top bigint, other bigint, other_key bigint, score bigint"
    asking = entries.where("asks").drop("asks")
    parts = {b: max(1, -(-n // part)) for b, n in here.items()}
    near = laid(parts, asking.select("*", none), True).groupBy("bucket", "cell", "salt", "part").applyInArrow(solve(True, positives), found_kind)
    order = Window.partitionBy("id", "key").orderBy(F.desc("score"), "other", "other_key")
    near = keep(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives).select(
        "id", "key", "other", "score"), "positives")
    scored = near.groupBy(F.col("id").alias("i"), F.col("key").alias("k")).agg(F.collect_set("score").alias("scores"))  # at most ``positives``
    asked = asking.join(scored, (F.col("vec_id") == F.col("i")) & (F.col("key") == F.col("k")))
    parts = dict.fromkeys(range(BUCKETS), max(1, -(-sum(here.values()) // part)))
    far = laid(parts, asked, False).groupBy("bucket", "cell", "salt", "part").applyInArrow(solve(False, negatives), found_kind)
    order = Window.partitionBy("id", "key", "top").orderBy(F.desc("score"), "other", "other_key")
    far = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        F.col("id").alias("anchor_id"), F.col("key").alias("k"), "top", "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    out = near.join(far, (F.col("id") == F.col("anchor_id")) & (F.col("key") == F.col("k")) & (F.col("score") == F.col("top")))
    return out.select("anchor_id", F.col("other").alias("positive_id"), "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")
