"""Token counts of whole texts; huge documents are counted in overlapping chunks.

A boundary between two characters that stand side by side in no piece of the vocabulary
is stable: merges only ever build pieces of the vocabulary, so no merge can cross it and
what lies right of it does not depend on what lies left. Chunks of a huge document overlap,
each overlap is widened until it holds a stable boundary, chunks are encoded apart (with
the offsets of their pieces), and neighbours are spliced at the first stable boundary at
which both have a piece edge. Counts are exactly those of the whole text.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F, types as T

from gridlore.llm import tokens as _tokens
from gridlore.llm.store import worker_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters of a chunk before its overlap; longer texts are counted in chunks.
CHUNK_CHARS = 16_384
#: First width of an overlap.
OVERLAP_CHARS = 128
_SPACE = "▁"


class PieceModel:
    """A sentencepiece model with identity normalisation and byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(size)]
        special = [self.model.is_control(i) or self.model.is_unknown(i) for i in range(size)]
        as_bytes = [self.model.is_byte(i) for i in range(size)]
        # bytes of the text (spaces as their three-byte stand-in) that a piece covers
        self.width = np.array([1 if b else len(n.encode()) for n, b in zip(names, as_bytes)], np.int64)
        inside = {n[k:k + 2] for n, s, b in zip(names, special, as_bytes) if not (s or b) for k in range(len(n) - 1)}
        self.joined = np.unique(np.array([(ord(p[0]) << 32) | ord(p[1]) for p in inside], dtype=np.int64))

    def stable(self, text: str) -> np.ndarray:
        """Positions p > 0 such that no piece can reach across text[p-1:p+1]."""
        shown = np.frombuffer(text.replace(" ", _SPACE).encode("utf-32-le"), "<u4").astype(np.int64)
        pairs = shown[:-1] << 32 | shown[1:]
        at = np.minimum(np.searchsorted(self.joined, pairs), len(self.joined) - 1)
        return np.flatnonzero(self.joined[at] != pairs) + 1

    def edges(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """(positions in ``text`` where a piece starts, pieces before each, all pieces)."""
        ids = np.array(self.model.encode(text), dtype=np.int64)
        begins = np.cumsum(self.width[ids]) - self.width[ids] - len(_SPACE.encode())  # the leading space is added
        chars = text.replace(" ", _SPACE)
        width = np.frombuffer(chars.encode("utf-32-le"), "<u4")
        width = 1 + (width > 0x7F).astype(np.int64) + (width > 0x7FF) + (width > 0xFFFF)
        starts = np.cumsum(width) - width
        at = np.searchsorted(starts, begins)
        whole = (begins >= 0) & (at < len(starts))
        whole[whole] = starts[at[whole]] == begins[whole]
        return at[whole], np.flatnonzero(whole), len(ids)


def piece_model(path: str) -> PieceModel:
    cache = worker_cache().setdefault("piece_models", {})
    if path not in cache:
        cache[path] = PieceModel(path)
    return cache[path]


def chunk_bounds(text: str, model: PieceModel, chunk: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, end of the overlap with the chunk before) of the chunks of a text.

    Every overlap but the first chunk's (empty) one holds a stable boundary strictly
    inside; an overlap without one is doubled, at most to the end of the text, which then
    belongs to the chunk on the left and ends the list.
    """
    out, start, shared = [], 0, 0
    while True:
        end = start + chunk
        if end >= len(text):
            out.append((start, len(text), shared))
            return out
        wide = overlap
        while end + wide < len(text) and not len(model.stable(text[end:end + wide])):
            wide *= 2
        if end + wide >= len(text):
            out.append((start, len(text), shared))
            return out
        out.append((start, end + wide, shared))
        start, shared = end, end + wide


_CHUNKS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("row", T.LongType()), T.StructField("n_bytes", T.LongType()),
    T.StructField("chunk", T.LongType()), T.StructField("start", T.LongType()), T.StructField("shared", T.LongType()),
    T.StructField("next_start", T.LongType()), T.StructField("part", T.StringType())])


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text",
                 chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for every row; null text counts as empty.

    Texts up to ``chunk_chars`` are encoded where they are read. Longer ones are cut into
    chunks that are spread over the cluster, so one huge text does not hold up one task;
    only per-chunk numbers come together again. Repeated rows and null doc_ids are kept,
    each row by itself; other columns are not read; an empty table gives no rows.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType),
                           T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    chunks = T.StructType([schema[0], *_CHUNKS.fields[1:]])
    read = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    long = F.length("text") > chunk_chars

    def count(batches):
        model = piece_model(vocabulary).model
        for whole in batches:
            for batch in _tokens.text_slices(whole, "text", 1_000_000):
                found = model.encode(batch.column("text").to_pylist(), num_threads=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("n_bytes"),
                     pa.array([len(x) for x in found], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    def cut(batches):
        model = piece_model(vocabulary)
        for batch in batches:
            for i in range(batch.num_rows):
                body, kept = batch.column("text")[i].as_py(), batch.slice(i, 1)
                for k, (start, end, shared) in enumerate(chunk_bounds(body, model, chunk_chars, overlap_chars)):
                    yield pa.RecordBatch.from_arrays(
                        [kept.column("doc_id"), kept.column("row"), kept.column("n_bytes"),
                         *(pa.array([v], pa.int64()) for v in (k, start, shared, start + chunk_chars)),
                         pa.array([body[start:end]])], chunks.names)

    def encode(batches):
        model = piece_model(vocabulary)
        for batch in batches:
            out = []
            for start, shared, following, body in zip(*(batch.column(c).to_pylist() for c in (
                    "start", "shared", "next_start", "part"))):
                at, before, n = model.edges(body)
                fixed = np.isin(at, model.stable(body))
                at, before = at[fixed] + start, before[fixed]
                pairs = lambda where: [{"at": int(a), "before": int(b)} for a, b in zip(at[where], before[where])]
                out.append((n, pairs((at > start) & (at < shared)), pairs(at > following)))
            kind = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "row", "n_bytes", "chunk")),
                 pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], kind),
                 pa.array([x[2] for x in out], kind)], ["doc_id", "row", "n_bytes", "chunk", "n", "head", "tail"])

    sized = read.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "text")
    short = sized.where(~long).mapInArrow(count, schema)
    parts = sized.where(long).select("doc_id", F.monotonically_increasing_id().alias("row"), "n_bytes", "text")
    spread = parts.mapInArrow(cut, chunks).repartition("row", "chunk")
    edges = T.ArrayType(T.StructType([T.StructField("at", T.LongType()), T.StructField("before", T.LongType())]))
    coded = spread.mapInArrow(encode, T.StructType([
        *chunks.fields[:4], T.StructField("n", T.LongType()), T.StructField("head", edges), T.StructField("tail", edges)]))
    return short.unionByName(_spliced(coded)).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _spliced(coded: DataFrame) -> DataFrame:
    """Sum of the pieces of neighbouring chunks between their splices."""
    order = Window.partitionBy("row").orderBy("chunk")
    following = F.lead("head").over(order)
    common = F.array_min(F.array_intersect(F.col("tail.at"), F.col("next.at")))
    edge = lambda pairs: F.filter(F.col(pairs), lambda e: e["at"] == F.col("splice"))[0]["before"]
    joined = coded.withColumn("next", following).withColumn("splice", F.when(F.col("next").isNotNull(), common))
    # by construction every overlap has a stable boundary, so a missing splice is a fault
    lost = F.col("next").isNotNull() & F.col("splice").isNull()
    pieces = F.when(lost, F.raise_error(F.lit("no common boundary")).cast("bigint")).when(
        F.col("next").isNull(), F.col("n")).otherwise(edge("tail") - edge("next"))
    return joined.select("row", "doc_id", "n_bytes", pieces.alias("n")).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens")).drop("row")
