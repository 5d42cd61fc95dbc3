"""Language identification by bit-sliced Bloom filters over character n-grams.

Learning puts the common n-grams of each language into one table: every slot holds a mask
with a bit per language, an n-gram sets its language's bit in a few slots. Looking an
n-gram up is the AND of its slots: all languages that contain it, at once. A document's
hits per language are popcounts of these masks; the share expected from filter collisions
is taken off, and the language with the most hits left is predicted.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gridlore.llm import tokens as _tokens
from gridlore.llm.store import worker_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Lengths of n-grams, word edges counted as a blank.
LENGTHS = (3, 4)
#: Documents per language that the filters are learned from (those of smallest hash).
FIT_DOCS = 2000
#: Buckets of hashes per halving of the hash range, by which the sample's end is found.
FIT_BUCKETS = 32
#: An n-gram belongs to a language if at least this share of its documents hold it.
FIT_SHARE = 0.02
#: N-grams kept per language and length, the most common first.
FIT_GRAMS = 20_000
#: Slots of the table and probes per n-gram.
SLOTS, PROBES = 1 << 18, 3


def _letters() -> np.ndarray:
    """Which code points are letters."""
    cache = worker_cache()
    if "letters" not in cache:
        cache["letters"] = np.array([chr(c).isalpha() for c in range(0x110000)])
    return cache["letters"]


def gram_hashes(texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of the n-grams of lower-cased words, a blank at either edge."""
    lows = [f" {t.lower()} " for t in texts]
    chars = np.frombuffer("".join(lows).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(lows), dtype=np.int32), np.fromiter(map(len, lows), np.int64, len(lows)))
    chars = np.where(_letters()[chars], chars, 32).astype(np.uint64)
    blank = chars == 32
    used = np.ones(len(chars), bool)
    used[1:] = ~(blank[1:] & blank[:-1])
    chars, owner, blank = chars[used], owner[used], blank[used]
    n = len(chars) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    with np.errstate(over="ignore"):
        h = np.full(n, length, np.uint64)
        inner = np.ones(n, bool)
        for k in range(length):
            h = (h + chars[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if 0 < k < length - 1:
                inner &= ~blank[k:k + n]
    return h[inner], owner[1:1 + n][inner]


def _slots(h: np.ndarray):
    for k in range(PROBES):
        yield (h >> np.uint64(20 * k) & np.uint64(SLOTS - 1)).astype(np.int64)


@dataclass
class LanguageFilters:
    """languages in alphabetical order, the slot masks, each language's chance of a false
    hit, and the language to name when no n-gram is known."""

    languages: list[str]
    masks: np.ndarray
    false_hits: np.ndarray
    usual: int

    def score(self, texts: list[str]) -> np.ndarray:
        """Corrected share of known n-grams per text and language."""
        hits = np.zeros((len(texts), len(self.languages)))
        total = np.zeros(len(texts))
        for length in LENGTHS:
            h, owner = gram_hashes(texts, length)
            if not len(h):
                continue
            found = None
            for at in _slots(h):
                found = self.masks[at] if found is None else found & self.masks[at]
            total += np.bincount(owner, minlength=len(texts))
            for k in range(len(self.languages)):
                word, bit = divmod(k, 64)
                on = found[:, word] >> np.uint64(bit) & np.uint64(1)
                hits[:, k] += np.bincount(owner, weights=on, minlength=len(texts))
        share = hits / np.maximum(total, 1)[:, None]
        return np.clip((share - self.false_hits) / np.maximum(1 - self.false_hits, 1e-9), 0, 1)


def fit(docs: DataFrame, use: Column | None = None, doc_id: str = "doc_id", text: str = "text",
        lang: str = "lang", fit_docs: int = FIT_DOCS) -> LanguageFilters:
    """Learns from at most ``fit_docs`` documents per language with a non-null label and text.

    The sample is those with the smallest hash of doc_id (then text), the same at every
    run. Where it ends follows from counts per language and bucket of hashes, so only about
    ``fit_docs`` rows per language meet, however many one language has. Counting its n-grams is a Spark job, and what comes to the driver is bounded by
    FIT_GRAMS per language and length. No usable row gives filters without languages.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows if use is None else rows.where(use)
    ids = rows.select(F.col(lang).alias("lang"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    place = F.xxhash64("doc_id", F.lit(5))
    # buckets of hashes grow with the hash, so the one that ends the sample is small at any number of rows
    part = F.floor(FIT_BUCKETS * F.coalesce(F.log2(place.cast("double") / 2.0 ** 64 + 0.5), F.lit(-64.0))).cast("int")
    running = Window.partitionBy("lang").orderBy("part")
    sizes = ids.groupBy("lang", part.alias("part")).agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(running))
    ends = sizes.where(F.col("upto") - F.col("n") < fit_docs).groupBy("lang").agg(F.max("part").alias("last"))
    near = ids.join(F.broadcast(ends), "lang").where(part <= F.col("last"))  # one row per language is broadcast
    order = Window.partitionBy("lang").orderBy(place, "doc_id", F.xxhash64("text"))
    sample = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= fit_docs)

    def grams(batches):
        for whole in batches:
            for batch in _tokens.text_slices(whole, "text", 600_000):
                texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist(), object)
                for length in (0, *LENGTHS):
                    if length:
                        h, owner = gram_hashes(texts, length)
                        order = np.lexsort((h, owner))
                        h, owner = h[order], owner[order]
                        new = np.ones(len(h), bool)  # once per document
                        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                        of, h = langs[owner[new]], h[new]
                    else:  # the documents themselves
                        of, h = langs, np.zeros(len(langs), np.uint64)
                    for one in np.unique(of.astype(str)) if len(of) else []:
                        value, n = np.unique(h[of == one], return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([one] * len(value)), pa.array([length] * len(value), pa.int32()),
                             pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "length", "gram", "n"])

    counts = sample.select("lang", "text").mapInArrow(grams, "lang string, length int, gram bigint, n bigint")
    counts = counts.groupBy("lang", "length", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang", "length").orderBy(F.desc("n"), "gram")
    kept = counts.withColumn("place", F.row_number().over(best)).where(F.col("place") <= FIT_GRAMS).toArrow().to_pandas()
    sizes = kept[kept["length"] == 0].set_index("lang")["n"].sort_index()
    languages = list(sizes.index)
    masks = np.zeros((SLOTS, max(1, -(-len(languages) // 64))), np.uint64)
    for k, one in enumerate(languages):
        mine = kept[(kept["lang"] == one) & (kept["length"] > 0) & (kept["n"] >= max(1, FIT_SHARE * sizes[one]))]
        for at in _slots(mine["gram"].to_numpy(np.int64).view(np.uint64)):
            masks[at, k // 64] |= np.uint64(1 << (k % 64))
    filled = np.array([float((masks[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).mean()) for k in range(len(languages))])
    return LanguageFilters(languages, masks, filled ** PROBES, int(np.argmax(sizes.to_numpy())) if languages else -1)


def predict(docs: DataFrame, model: LanguageFilters, text: str = "text", prefix: str = "lang_") -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred, lang_score and lang_known.

    lang_score (0 to 1) is the winner's share of all languages' corrected hits, lang_known
    its corrected share of the document's n-grams. Ties go to the first language by name.
    A null text, or one without a letter, is ``und`` with 0; so is every text if nothing
    was learned. A text with letters of which no n-gram is known gets the language with
    most documents learned from, score 0. Whole texts of any length are read. Columns with
    the names of the results are replaced.
    """
    added = [f"{prefix}pred", f"{prefix}score", f"{prefix}known"]
    kept = [c for c in docs.columns if c not in added]
    docs = docs.select(*[F.col("`" + c.replace("`", "``") + "`") for c in kept])
    schema = T.StructType([*docs.schema.fields, T.StructField(added[0], T.StringType()),
                           T.StructField(added[1], T.DoubleType()), T.StructField(added[2], T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decide(batches):
        model, letters = shared.value, _letters()
        for whole in batches:
            for batch in _tokens.text_slices(whole, text, 600_000):
                texts = [t or "" for t in batch.column(text).to_pylist()]
                any_letter = np.array([
                    bool(letters[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")].any()) for t in texts], bool)
                best = np.full(len(texts), -1)
                score = known = np.zeros(len(texts))
                if model.languages:
                    share = model.score(texts)
                    best, total = share.argmax(axis=1), share.sum(axis=1)
                    known = np.where(any_letter, share.max(axis=1), 0.0)
                    score = np.where(any_letter & (total > 0), share.max(axis=1) / np.maximum(total, 1e-300), 0.0)
                    best = np.where(any_letter, np.where(total > 0, best, model.usual), -1)
                names = [model.languages[k] if k >= 0 else "und" for k in best.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(names), pa.array(score), pa.array(known)], schema.names)

    return docs.mapInArrow(decide, schema)
