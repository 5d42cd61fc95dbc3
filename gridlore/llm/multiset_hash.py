"""Homomorphic multiset fingerprints of documents; DataFrame functions only.

A document is the multiset of its paragraphs (lines). Each paragraph is hashed to a wide
vector of 72 lanes and a document's fingerprint is the sum of its paragraphs' vectors, lane
by lane, modulo 2**32. So order does not matter, and inserting or deleting a paragraph is
adding or subtracting its vector (``merged``).

Lanes: 8 hold four independent 64-bit hashes of the whole paragraph in halves, and decide
equality. 64 hold, for each bit, how many of the paragraph's word pairs have it set in
their hash, and one more counts the pairs; centred, they are a random projection of the
pair counts, whose cosine is the likeness of two fingerprints.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

EXACT, WIDE = 4, 64
#: Code points that one range of documents may hold on average.
RANGE_CHARS = 8_000_000
#: Ranges at most: bounds the list of range limits on the driver.
MOST_RANGES = 50_000
_LOW = (1 << 32) - 1


def paragraph_rows(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, h0..h3, pos, pair): hashes of every paragraph and of its word pairs in turn.

    A paragraph's last word is hashed alone, so each has at least one pair; a text without
    a line break, the empty text included, is one paragraph.
    """
    lines = rows.select(*keys, F.explode(F.split(F.col(text), "\n")).alias("line"))
    words = F.split("line", " ")
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.xxhash64(a, b))
    return lines.select(
        *keys, *[F.xxhash64(F.lit(j), "line").alias(f"h{j}") for j in range(EXACT)], F.posexplode(pairs).alias("pos", "pair"))


def lane_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, exact array<bigint>, pairs, wide array<bigint>) of the rows above."""
    half = lambda c: [c.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(c, 32)]
    first = F.col("pos") == 0  # a paragraph's own hashes count once
    exact = [F.sum(F.when(first, part).otherwise(0)).alias(f"e{j}_{k}")
             for j in range(EXACT) for k, part in enumerate(half(F.col(f"h{j}")))]
    both = F.lit((1 << 32) | 1)  # two lanes to a number, far from running into each other
    wide = [F.sum(F.shiftrightunsigned("pair", j).bitwiseAND(both)).alias(f"w{j}") for j in range(WIDE // 2)]
    sums = rows.groupBy(*keys).agg(*exact, *wide, F.count("*").alias("pairs"))
    modulo = lambda c: F.col(c).bitwiseAND(F.lit(_LOW))
    return sums.select(
        *keys, F.array(*[modulo(f"e{j}_{k}") for j in range(EXACT) for k in range(2)]).alias("exact"),
        modulo("pairs").alias("pairs"),
        F.array(*[p for j in range(WIDE // 2) for p in half(F.col(f"w{j}"))]).alias("wide"))


def printed(exact: Column, pairs: Column, wide: Column) -> Column:
    """The fingerprint as text: eight hex digits a lane."""
    digits = lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")
    return F.concat(F.array_join(F.transform(exact, digits), ""), F.lit("-"), digits(pairs), F.lit("-"),
                    F.array_join(F.transform(wide, digits), ""))


def merged(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of ``a`` with those of ``b`` inserted (``sign`` 1) or deleted (-1)."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + F.lit(sign) * y, F.lit(1 << 32)))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of two (exact, pairs, wide) structs, cut at 0; 1 if they are equal."""
    centred = lambda s: F.transform(s["wide"], lambda c: (c * 2 - s["pairs"]).cast("double"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    ca, cb = centred(a), centred(b)
    dot = total(F.zip_with(ca, cb, lambda x, y: x * y))
    size = F.sqrt(total(F.transform(ca, lambda x: x * x)) * total(F.transform(cb, lambda x: x * x)))
    cosine = F.when(size > 0, F.least(F.greatest(dot / size, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(cosine)


def _in_ranges(docs: DataFrame) -> DataFrame:
    """Rows with their range along doc_id, and each range's first row again at the end of
    the range before (of the last range, for the first); one shuffle of the texts."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    wanted = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / RANGE_CHARS))
    wanted = min(wanted, MOST_RANGES)
    limits = docs.select(F.col("doc_id").cast("double").alias("at")).approxQuantile(
        "at", [k / wanted for k in range(1, wanted)], max(1 / (4 * wanted), 1e-5))
    splits = [-math.inf, *sorted(set(limits)), math.inf]
    at = docs.withColumn("at", F.coalesce(F.col("doc_id").cast("double"), F.lit(-math.inf)))  # nulls come first
    if len(splits) > 2:
        at = Bucketizer(splits=splits, inputCol="at", outputCol="range").transform(at)
    else:
        at = at.withColumn("range", F.lit(0.0))
    rows = at.select(F.col("range").cast("int").alias("range"), "doc_id", F.xxhash64("text").alias("tie"), "text")
    firsts = rows.groupBy("range").agg(F.min(F.struct("doc_id", "tie")).alias("first"))
    around = Window.orderBy("range")  # one row per range
    before = F.coalesce(F.lag("range").over(around), F.max("range").over(Window.orderBy(F.lit(0))))
    firsts = firsts.select(F.col("range").alias("r"), F.col("first.doc_id").alias("d"), F.col("first.tie").alias("t"),
                           before.alias("before"))
    is_first = (F.col("range") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t"))
    marked = rows.join(F.broadcast(firsts), is_first, "left")
    own = F.struct("range", F.lit(True).alias("own"))
    again = F.struct(F.col("before").alias("range"), F.lit(False).alias("own"))
    places = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, again))
    return marked.select("doc_id", "tie", "text", F.inline(places))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of every row's whole text and of its edited text, in which the last
    floor(n_chars / 2) code points are replaced by as many from the start of the next
    document (all, if it is shorter) in the order of doc_id; the first follows the last.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, exact and wide (the lanes). doc_id is a whole number; null comes first, and
    rows with equal ids follow each other by a hash of their text. A null text counts as
    empty; a single row is its own next. Other columns are not read; no rows give none.
    """
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = Window.partitionBy("range").orderBy(F.desc("own"), F.asc_nulls_first("doc_id"), "tie")
    placed = _in_ranges(docs).withColumn("place", F.row_number().over(order)).withColumn("after", F.lead("text").over(order))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("after", F.lit(1), half))
    edited = F.when(F.col("own"), edited)
    keys = ["range", "place", "own", "doc_id", "n_chars", "sha", "edited"]
    both = placed.select("range", "place", "own", "doc_id", "text", n.cast("bigint").alias("n_chars"), edited.alias("changed"))
    both = both.withColumn("sha", F.sha2(F.col("changed").cast("binary"), 256))
    versions = F.array(F.struct(F.lit(False).alias("edited"), F.col("text").alias("body")),
                       F.struct(F.lit(True).alias("edited"), F.col("changed").alias("body")))
    versions = F.when(F.col("own"), versions).otherwise(F.slice(versions, 1, 1))
    bodies = both.select("range", "place", "own", "doc_id", "n_chars", "sha", F.inline(versions))
    sums = lane_sums(paragraph_rows(bodies, "body", keys), keys)
    lanes = F.struct("exact", "pairs", "wide")
    pair = sums.groupBy(*keys[:-1]).agg(F.max(F.when(~F.col("edited"), lanes)).alias("plain"),
                                        F.max(F.when(F.col("edited"), lanes)).alias("changed"))
    following = F.lead("plain").over(Window.partitionBy("range").orderBy("place"))
    done = pair.withColumn("next", following).where("own")
    show = lambda c: printed(F.col(f"{c}.exact"), F.col(f"{c}.pairs"), F.col(f"{c}.wide"))
    return done.select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), show("plain").alias("fingerprint"),
        show("changed").alias("edited_fingerprint"), likeness(F.col("plain"), F.col("changed")).alias("near_edited"),
        likeness(F.col("plain"), F.col("next")).alias("near_next"), F.col("plain.exact").alias("exact"),
        F.col("plain.wide").alias("wide"))
