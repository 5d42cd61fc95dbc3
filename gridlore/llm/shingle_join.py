"""Exact n-gram Jaccard join by count vectors, summed coordinate minima and an R-tree.

A document is its set of distinct word shingles (58-bit hashes). Shingles are hashed into
groups; the counts per group are the document's point. The overlap of two sets is at most
the sum of the coordinate minima of their points, and an R-tree node bounds it for all
points below by its upper corner. Steps, each exact:

1. Equal sets become one class. How many documents hold a shingle of each of 65,536 coarse
   groups is counted over the whole corpus; a set is ordered by that count, rarest first.
2. Two sets that meet the threshold share one of their first n - ceil(t n) + 1 shingles in
   this order (they lose more than they may otherwise). So the index is split by shingle:
   under each of them stands the part of the index that holds it early. A shingle held by
   very many is salted first.
3. Under each shingle all members are tested against one of them (star), which joins large
   groups of near copies with one test per member, not one per pair.
4. Under shingles whose members are then still in different components, an R-tree over the
   members' points finds the pairs of different components whose bound reaches the needed
   overlap. Pairs of one component need no test: the result is components.
5. Surviving pairs are verified on their whole sets. Components of all links are labelled
   by the smallest doc_id.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from gridlore.llm import tokens as _tokens
from gridlore.llm.components import components
from gridlore.llm.store import keep

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = 5
#: Threshold as a ratio of whole numbers: 100 * intersection >= 75 * union.
NUM, DEN = 75, 100
#: Coarse groups whose document counts order the shingles.
COARSE = 1 << 16
#: Fewest and most coordinates of a point; between them about as many as the set has shingles.
DIMS, MOST_DIMS = 256, 1 << 20
#: Bytes of sets (or points) of one side of a block of pairs that are verified together, about.
SIDE_BYTES = 16 << 20
#: Pairs of such a block, about.
BLOCK_PAIRS = 500_000
#: Members under one shingle that one task step looks at; more are dealt into blocks.
BLOCK = 4096
#: Documents per salt of a shingle that very many documents hold.
SALT_ROWS = 1_000_000
#: Bits of the filter that tells which sets have to be read again (bounded, 2 MB).
FILTER_BITS = 1 << 24

_SEED = np.random.default_rng(20240501)
_LETTER = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER[65:91] = _LETTER[97:123]  # A-Z as a-z
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, *range(0x09, 0x0E)]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(58-bit shingle hashes, ascending and distinct within a text; ends per text)."""
    texts = pa.array(texts).fill_null("").cast(pa.large_string())
    if not len(texts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    spots = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[spots[0]:spots[-1]]
    spots = spots - spots[0]
    gap = _BREAK[data]
    first = np.zeros(len(data) + 1, bool)
    first[spots] = True
    edge = np.empty(len(data) + 1, bool)  # nothing of the word before reaches this place
    edge[0], edge[1:] = True, gap
    starts = np.flatnonzero(~gap & (edge[:-1] | first[:-1]))
    stop = np.empty(len(data), bool)
    if len(data):
        stop[:-1], stop[-1] = gap[1:], True
    ends = np.flatnonzero(~gap & (stop | first[1:])) + 1
    with np.errstate(over="ignore"):
        power = np.full(len(data) + 1, _STEP)
        power[:1] = 1
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[data] * np.cumprod(power)[:-1], dtype=np.uint64)])
        power[1:] = _BACK
        word = _mixed((total[ends] - total[starts]) * np.cumprod(power)[starts] + (ends - starts).astype(np.uint64))
        of = np.searchsorted(spots, starts, side="right") - 1
        n_words = np.bincount(of, minlength=len(texts))[:len(texts)]
        last = np.cumsum(n_words)
        whole = np.zeros(len(word), np.uint64)
        for k in range(words):
            step = np.uint64(pow(0xD1342543DE82EF95, k + 1, 1 << 64))
            whole[:max(0, len(word) - k)] += word[k:] * step
        full = _mixed(whole)
        out, sizes = [], np.zeros(len(texts), np.int64)
        for i, (end, n) in enumerate(zip(last.tolist(), n_words.tolist())):
            if n >= words:
                found = np.unique(full[end - n:end - words + 1] >> np.uint64(6))
            elif n:
                steps = np.array([pow(0xD1342543DE82EF95, k + 1, 1 << 64) for k in range(n)], np.uint64)
                found = _mixed(np.array([(word[end - n:end] * steps).sum(dtype=np.uint64) + np.uint64(n)])) >> np.uint64(6)
            else:
                continue
            out.append(found)
            sizes[i] = len(found)
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.cumsum(sizes)


def _digests(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit class of each set, the same for equal sets (its size is mixed in)."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(flat + np.uint64(1)), dtype=np.uint64)])
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        return _mixed(total[ends] - total[begins] + (ends - begins).astype(np.uint64)).view(np.int64)


def _levels(counts: np.ndarray) -> np.ndarray:
    """Coarse group -> level of its count against the mean, 0 to 31."""
    counts = counts.astype(np.float64) + 1
    return np.clip(np.round(2 * np.log2(counts / counts.mean())) + 8, 0, 31).astype(np.uint64)


def _ordered(found: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The set rarest first; the level stands above the 58 bits of the hash."""
    return np.sort(levels[(found & np.uint64(COARSE - 1)).astype(np.int64)] << np.uint64(58) | found)


def early(n: int) -> int:
    """Shingles of a set of n among which a partner must have one: n - ceil(t n) + 1."""
    return n - -(-NUM * n // DEN) + 1


def point_dims(n: int) -> int:
    """Coordinates of the point of a set of n: a power of two."""
    return min(MOST_DIMS, max(DIMS, 1 << max(0, n - 1).bit_length()))


def _packed(point: np.ndarray) -> bytes:
    """The counts in the fewest bytes that hold the largest, whose number stands before."""
    most = int(point.max(initial=0))
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes([width]) + point.astype(f"<u{width}").tobytes()


def _unpacked(raw) -> np.ndarray:
    raw = memoryview(raw)
    return np.frombuffer(raw[1:], f"<u{raw[0]}").astype(np.int32)


def points(flat: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Count vector of every set; a fine one folds to a coarse one of the same groups."""
    group = (flat >> np.uint64(20) & np.uint64(MOST_DIMS - 1)).astype(np.int64)
    out = []
    for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
        dims = point_dims(b - a)
        out.append(_packed(np.bincount(group[a:b] & (dims - 1), minlength=dims)))
    return out


def folded(point: np.ndarray, dims: int = DIMS) -> np.ndarray:
    return point.reshape(-1, dims).sum(axis=0)


def bound(a: np.ndarray, b: np.ndarray) -> int:
    """Most shingles that two sets can share: the sum of the coordinate minima."""
    dims = min(len(a), len(b))
    return int(np.minimum(folded(a, dims), folded(b, dims)).sum())


# --- 1: classes and coarse counts -------------------------------------------------------

_SLICES = 256


def _profiles(docs: DataFrame) -> DataFrame:
    """Rows of documents (doc_id, n, cls) and, per task, of coarse counts (slice, counts)."""
    def profile(batches):
        names = ["doc_id", "n", "cls", "point", "slice", "counts"]
        kind = pa.binary()
        total = np.zeros(COARSE, np.int64)
        for whole in batches:
            for batch in _tokens.text_slices(whole, "text", 400_000):
                flat, ends = shingle_sets(batch.column("text"))
                total += np.bincount((flat & np.uint64(COARSE - 1)).astype(np.int64), minlength=COARSE)
                n = np.diff(ends, prepend=0)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array(n), pa.array(_digests(flat, ends)), pa.array(points(flat, ends), kind),
                    pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
        if total.any():
            parts = [x.tobytes() for x in total.reshape(_SLICES, -1)]
            yield pa.RecordBatch.from_arrays([
                *[pa.nulls(_SLICES, pa.int64())] * 3, pa.nulls(_SLICES, kind),
                pa.array(range(_SLICES), pa.int32()), pa.array(parts, pa.binary())], names)

    return docs.mapInArrow(profile, "doc_id bigint, n bigint, cls bigint, point binary, slice int, counts binary")


def _coarse(profiles: DataFrame) -> np.ndarray:
    def add(key, table):
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column("counts"))
        return pa.table({"slice": table.column("slice").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = profiles.where("slice is not null").select("slice", "counts")
    rows = parts.groupBy("slice").applyInArrow(add, "slice int, counts binary").collect()  # 256 rows
    out = np.zeros((_SLICES, COARSE // _SLICES), np.int64)
    for r in rows:
        out[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    return out.reshape(-1)


# --- 2 and 3: early shingles and stars ----------------------------------------------------

def _early_rows(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """(key, salt, cls, n) for the early shingles of every document.

    A key is the last bits of a shingle's hash, so many more than the corpus asks for that few
    shingles share one. Where they do their documents are only compared once more for it.
    """
    bits = min(58, max(40, int(counts.sum()).bit_length() + 10))
    shared = docs.sparkSession.sparkContext.broadcast((_levels(counts), 1 + counts // SALT_ROWS))

    def emit(batches):
        levels, salts = shared.value
        for whole in batches:
            for batch in _tokens.text_slices(whole, "text", 400_000):
                flat, ends = shingle_sets(batch.column("text"))
                classes, begin, keys, at = _digests(flat, ends), 0, [], []
                _, once = np.unique(classes, return_index=True)
                sizes, once = np.diff(ends, prepend=0), set(once.tolist())
                for i, end in enumerate(ends.tolist()):
                    if end > begin and i in once:
                        keys.append(_ordered(flat[begin:end], levels)[:early(end - begin)])
                        at.append(np.full(len(keys[-1]), i))
                    begin = end
                if keys:
                    key, at = np.concatenate(keys), np.concatenate(at)
                    owner = classes[at]
                    n = salts[(key & np.uint64(COARSE - 1)).astype(np.int64)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((key & np.uint64((1 << bits) - 1)).astype(np.int64)), pa.array(np.where(n > 1, 1 + owner % n, 0).astype(np.int32)), pa.array(owner),
                         pa.array(sizes[at].astype(np.int32))], ["key", "salt", "cls", "n"])

    return docs.select("text").mapInArrow(emit, "key bigint, salt int, cls bigint, n int")


def _stars(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(key, hub, n_b, cls, n_a): the members of every key beside its first one; a first one
    that stands for a salt beside itself. One pass over sorted rows that holds one batch."""
    def run(batches):
        old, old_hub = None, (0, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy() for k in keys]
            cls, n = batch.column("cls").to_numpy(), batch.column("n").to_numpy()
            new = np.ones(len(cls), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            new[0] = old != tuple(c[0] for c in cols)
            at = np.flatnonzero(new)
            owner = np.searchsorted(at, np.arange(len(cls)), side="right")
            hub = np.concatenate([[old_hub[0]], cls[at]])[owner]
            size = np.concatenate([[old_hub[1]], n[at]])[owner]
            told = hub != cls
            told[1:] &= (cls[1:] != cls[:-1]) | new[1:]
            if len(cols) > 1:
                told |= new & (cols[1] > 0)
            old, old_hub = tuple(c[-1] for c in cols), (hub[-1], size[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[told]) for x in (cols[0], hub, size.astype(np.int32), cls, n)], ["key", "hub", "n_b", "cls", "n_a"])

    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "cls")
    return ordered.mapInArrow(run, "key bigint, hub bigint, n_b int, cls bigint, n_a int")


def _bits(classes: DataFrame) -> np.ndarray:
    """A filter of fixed size that knows all classes (and a few more)."""
    spots = classes.select(F.expr(f"cls & {FILTER_BITS - 1}").alias("spot"))
    words = spots.groupBy(F.expr("spot >> 5").alias("w")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(spot & 31 AS INT)))").alias("b"))
    table = words.toArrow()  # at most FILTER_BITS / 32 rows
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[table.column("w").to_numpy()] = table.column("b").to_numpy().astype(np.uint32)
    return out


def _in_filter(known: np.ndarray, classes: np.ndarray) -> np.ndarray:
    spot = classes & (FILTER_BITS - 1)
    return (known[spot >> 5] >> (spot & 31).astype(np.uint32) & 1).astype(bool)


def _sets(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, found): whole sets of the pairs' classes, read again from one document each.

    A class whose document has a copy with the same doc_id may come twice, which only
    repeats links.
    """
    sc = docs.sparkSession.sparkContext
    wanted = sc.broadcast(_bits(_ends(pairs)))

    def choose(batches):
        for batch in batches:
            cls = batch.column("cls").to_numpy()
            at = np.flatnonzero(_in_filter(wanted.value, cls))
            marks = _marks(cls[at], batch.column("doc_id").fill_null(-1).to_numpy()[at])
            yield pa.RecordBatch.from_arrays([pa.array(marks)], ["cls"])

    chosen = sc.broadcast(_bits(classes.select("cls", "doc_id").mapInArrow(choose, "cls bigint")))

    def emit(batches):
        for whole in batches:
            for batch in _tokens.text_slices(whole, "text", 400_000):
                flat, ends = shingle_sets(batch.column("text"))
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                cls = _digests(flat, ends)
                at = np.flatnonzero((ends > begins) & _in_filter(chosen.value, _marks(cls, batch.column("doc_id").fill_null(-1).to_numpy())))
                yield pa.RecordBatch.from_arrays([
                    pa.array(cls[at]), pa.array([flat[begins[i]:ends[i]].view(np.int64) for i in at.tolist()], pa.list_(pa.int64()))], ["cls", "found"])

    return docs.mapInArrow(emit, "cls bigint, found array<bigint>")


def _marks(cls: np.ndarray, doc_ids: np.ndarray) -> np.ndarray:
    """A hash of a class and one of its documents."""
    with np.errstate(over="ignore"):
        return _mixed(cls.view(np.uint64) ^ _mixed(doc_ids.astype(np.int64).view(np.uint64) + np.uint64(1))).view(np.int64)


# --- 4: R-tree ------------------------------------------------------------------------------

def needed(a, b):
    """Smallest overlap of sets of sizes a and b that meets the threshold."""
    return -(-NUM * (a + b) // (NUM + DEN))


class PointTree:
    """Packed R-tree over points: leaves of points near each other, upper corners above."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray, leaf: int = 32):
        order = np.lexsort((points[:, 0], points.argmax(axis=1), sizes, labels))
        self.rows, self.leaf = order, leaf
        cuts = np.arange(0, len(order), leaf)
        self.top = np.maximum.reduceat(points[order], cuts, axis=0)
        self.least = np.minimum.reduceat(sizes[order], cuts)
        self.most = np.maximum.reduceat(sizes[order], cuts)
        first, last = labels[order][cuts], labels[order][np.minimum(cuts + leaf, len(order)) - 1]
        self.label = np.where(first == last, first, -1)
        self.points, self.sizes, self.labels = points, sizes, labels

    def search(self, row: int) -> np.ndarray:
        """Rows of another label whose summed minima with a row's reach the needed overlap."""
        q, size, label = self.points[row], int(self.sizes[row]), self.labels[row]
        need = needed(size, np.maximum(self.least, -(-NUM * size // DEN)))
        open_ = (self.label != label) & (self.most * DEN >= NUM * size) & (self.least * NUM <= DEN * size)
        nodes = np.flatnonzero(open_)
        nodes = nodes[np.minimum(self.top[nodes], q).sum(axis=1) >= need[nodes]]
        if not len(nodes):
            return nodes
        at = (nodes[:, None] * self.leaf + np.arange(self.leaf)).reshape(-1)
        rows = self.rows[at[at < len(self.rows)]]
        rows = rows[self.labels[rows] != label]
        return rows[np.minimum(self.points[rows], q).sum(axis=1) >= needed(size, self.sizes[rows])]


def _tree_pairs(members: DataFrame) -> DataFrame:
    """(cls, hub): pairs under one key in different components whose bound is high enough."""
    def search(key, table):
        cls, comp = table.column("cls").to_numpy(), table.column("comp").to_numpy()
        sizes, block = table.column("n").to_numpy(), table.column("block").to_numpy()
        points = np.array([_unpacked(p.as_buffer()) for p in table.column("point")]).reshape(len(cls), DIMS)
        _, labels = np.unique(comp, return_inverse=True)
        tree, left, right = PointTree(points, sizes, labels), [], []
        two = key[1].as_py() != key[2].as_py()  # of two blocks only pairs across them are due here
        busy = np.bincount(labels).argmax()  # of a pair at least one is outside the largest component
        for i in range(len(cls)):
            if labels[i] == busy:
                continue
            found = tree.search(i)
            found = found[(labels[found] == busy) | (found > i)]
            if two:
                found = found[block[found] != block[i]]
            left.append(np.full(len(found), i))
            right.append(found)
        a = np.concatenate(left) if left else np.empty(0, np.int64)
        b = np.concatenate(right) if right else np.empty(0, np.int64)
        a, b = np.where(cls[a] < cls[b], a, b), np.where(cls[a] < cls[b], b, a)
        return pa.table({"cls": cls[a], "hub": cls[b], "n_a": sizes[a].astype(np.int32), "n_b": sizes[b].astype(np.int32)})

    return members.groupBy("key", "low", "high").applyInArrow(search, "cls bigint, hub bigint, n_a int, n_b int").distinct()


# --- 5: verification -------------------------------------------------------------------------

def _checked(pairs: DataFrame, table: DataFrame, column: str, per_row: F.Column, test) -> DataFrame:
    """The pairs (cls, hub, n_a, n_b) for which ``test`` holds on the column's values of both.

    Pairs are dealt into square blocks by both ends, as many as the values' bytes and the number of
    pairs ask for, and a value goes once to every block that has a pair of it, not once with every pair.
    """
    size = table.agg(F.count("*").alias("n"), F.sum(per_row).alias("bytes")).first()
    side = max(1, -(-(size["bytes"] or 0) // SIDE_BYTES), math.isqrt(pairs.count() // BLOCK_PAIRS))
    at = lambda c: F.pmod(F.xxhash64(F.lit(3), c), F.lit(side)).cast("int")
    placed = pairs.select("cls", "hub", "n_a", "n_b", at("cls").alias("i"), at("hub").alias("j"))
    wanted = placed.select("i", "j", "cls").union(placed.select("i", "j", "hub")).distinct().withColumnRenamed("cls", "c")
    sent = wanted.join(table.select(F.col("cls").alias("known"), F.col(column).alias("value")), F.col("c") == F.col("known")).select(
        "i", "j", F.col("c").alias("cls"), "value")
    both = placed.unionByName(sent, allowMissingColumns=True).select("i", "j", "cls", "hub", "n_a", "n_b", "value")

    def run(key, table):
        is_pair = pc.is_valid(table.column("hub"))
        held, asked = table.filter(pc.invert(is_pair)), table.filter(is_pair)
        place = {c: k for k, c in enumerate(held.column("cls").to_pylist())}
        values = held.column("value").combine_chunks() if held.num_rows else pa.array([], held.column("value").type)
        ok = [a in place and b in place and test(values[place[a]], values[place[b]], n, m) for a, b, n, m in zip(
            *(asked.column(c).to_pylist() for c in ("cls", "hub", "n_a", "n_b")))]
        return asked.select(["cls", "hub", "n_a", "n_b"]).filter(pa.array(ok, pa.bool_()))

    return both.groupBy("i", "j").applyInArrow(run, "cls bigint, hub bigint, n_a int, n_b int")


def _sized(pairs: DataFrame) -> DataFrame:
    n, m = F.col("n_a").cast("bigint"), F.col("n_b").cast("bigint")
    return pairs.where((n * DEN >= m * NUM) & (m * DEN >= n * NUM) & (F.col("cls") != F.col("hub")))


def _likely(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """The pairs (of fitting sizes) whose summed coordinate minima allow a link."""
    def near(a, b, n, m):
        return bound(_unpacked(a.as_buffer()), _unpacked(b.as_buffer())) >= needed(n, m)

    return _checked(pairs, keep(_points(profiles, _ends(pairs)), "points"), "point", F.octet_length("point"), near)


def _points(profiles: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, n, point) of the classes (and a few more), from one of their documents each."""
    rows = profiles.where("n > 0").select("cls", "n", "point")
    return _filtered(rows, _bits(classes)).dropDuplicates(["cls"])


def _filtered(rows: DataFrame, bits: np.ndarray, by: str = "cls") -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def choose(batches):
        for batch in batches:
            yield batch.filter(pa.array(_in_filter(shared.value, batch.column(by).to_numpy())))

    return rows.mapInArrow(choose, rows.schema)


def _links(docs: DataFrame, likely: DataFrame, classes: DataFrame) -> DataFrame:
    """The likely pairs that meet the threshold on their whole sets, which only their
    classes' documents are read again for."""
    def linked(a, b, n, m):
        shared = len(np.intersect1d(a.values.to_numpy(), b.values.to_numpy(), assume_unique=True))
        return shared * DEN >= (n + m - shared) * NUM

    # a class that is read from several documents with one id is the same set each time
    sets = keep(_sets(docs, likely, classes), "sets")
    return keep(_checked(likely, sets, "found", 8 * F.size("found"), linked).select("cls", "hub"), "links")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("cls").union(pairs.select("hub"))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    component_id is the smallest doc_id that links of Jaccard similarity 0.75 or more on
    five-word shingles lead to. A text with fewer words is one shingle; a null text or one
    without words has none, links with nothing and is its own component. Rows with equal
    ids or texts are kept; a null doc_id never names a component that has another one. The
    table may be empty; other columns are not read. No cap is set on anything.
    """
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    profiles = keep(_profiles(docs), "profiles")
    rows = profiles.where("slice is null").select("doc_id", "n", "cls")
    counts = _coarse(profiles)

    classes = keep(profiles.where("n > 0").select("cls", "n", "doc_id").dropDuplicates(["cls"]), "classes")

    stars = _all_stars(docs, counts)
    pairs = keep(_sized(stars).select("cls", "hub", "n_a", "n_b").distinct(), "pairs")
    links = _links(docs, keep(_likely(pairs, profiles), "likely"), classes)
    comps = components(links, "cls", "hub").withColumnRenamed("node", "cls")

    # a key's hub has met all its members, so only pairs of other members are open
    under = keep(stars.select("key", "cls").join(comps, "cls", "left").select(
        "key", "cls", F.coalesce("component", "cls").alias("comp")), "under")
    tree = _tree_pairs(_blocks(under, profiles, keep(_mixed_keys(under), "mixed")))
    more = _links(docs, keep(_likely(keep(tree, "tree"), profiles), "likely"), classes)
    comps = keep(components(links.union(more), "cls", "hub"), "components")

    ids = rows.groupBy("cls", (F.col("n") > 0).alias("linked")).agg(F.min("doc_id").alias("first"))
    named = ids.where("linked").join(comps.withColumnRenamed("node", "cls"), "cls", "left").select(
        "cls", "first", F.coalesce("component", "cls").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_class = named.join(least, "component").select(F.col("cls").alias("of"), "component_id")
    out = rows.join(by_class, (F.col("cls") == F.col("of")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _all_stars(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """Stars of all keys, and of the first ones of salted keys among each other."""
    stars = keep(_stars(_early_rows(docs, counts), ["key", "salt"]), "stars")
    if not (counts >= SALT_ROWS).any():
        return stars
    firsts = stars.select("key", F.col("hub").alias("cls"), F.col("n_b").alias("n")).distinct()
    return stars.union(keep(_stars(firsts, ["key"]), "stars"))


def _mixed_keys(under: DataFrame) -> DataFrame:
    """(key, k) of keys with members of several components; of keys with the same members
    (told by two XORs of hashes, the sums of a hash's halves and their number) one stands for
    all. A member may be listed twice: it cancels in an XOR, but not in a sum."""
    told = F.xxhash64("cls")
    held = under.groupBy("key").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("k"),
        F.bit_xor(told).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "cls")).alias("y"),
        F.sum(told.bitwiseAND(F.lit(2 ** 32 - 1))).alias("low"), F.sum(F.shiftrightunsigned(told, 32)).alias("high"))
    return held.where("lo <> hi").groupBy("k", "x", "y", "low", "high").agg(F.min("key").alias("key")).select("key", "k")


def _coarse_points(points: DataFrame) -> DataFrame:
    def fold(batches):
        for batch in batches:
            small = [_packed(folded(_unpacked(p.as_buffer()))) for p in batch.column("point")]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("n"), pa.array(small, pa.binary())], ["cls", "n", "point"])

    return points.select("cls", "n", "point").mapInArrow(fold, "cls bigint, n bigint, point binary")


def _blocks(under: DataFrame, profiles: DataFrame, mixed: DataFrame) -> DataFrame:
    """Members of mixed keys; more than BLOCK are dealt into blocks, each pair of which is a group."""
    n = F.ceil(F.col("k") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("cls"), n).cast("int")
    held = under.join(mixed, "key").withColumn("block", block)
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda o: F.struct(
        F.least(o, F.col("block")).alias("low"), F.greatest(o, F.col("block")).alias("high")))
    spread = keep(held.select("cls", "comp", "key", "block", F.inline(pairs)), "members")
    return spread.join(_coarse_points(_points(profiles, spread.select("cls"))), "cls")
