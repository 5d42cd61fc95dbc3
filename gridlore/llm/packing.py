"""Vector bin packing of tokenised examples by the dot-product heuristic.

Every piece of an example demands tokens, one segment and some loss-bearing tokens; every
sequence has a limit on each. A bin is filled by taking, among the pieces that still fit,
the one whose demand has the largest weighted dot product with what is left in the bin.
Pieces are dealt at random into groups of bounded size that are packed on their own; a
group wastes at most about one sequence, so the padding stays near that of one large pack.
"""

from __future__ import annotations

import math
import sys
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from gridlore.llm import tokens as _tokens
from gridlore.llm.store import free, keep

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 4096
    segments: int = 256
    loss_tokens: int = 4096


#: Pieces per packing group: bounds the memory and time of one task step.
GROUP_PIECES = 8192


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int, max_tokens: int = 4096, doc_id: str = "doc_id",
               text: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenises each row's whole text, appends ``end_id`` and cuts it into pieces.

    One row per piece: doc_id, start, length, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers), doc_tokens, loss_tokens (plain text: all tokens), and the
    ids themselves if ``with_ids``. A null text counts as empty (one piece, the end id);
    null and repeated doc_ids are kept, each row by itself; other columns are not read.
    A text of any length is cut, never shortened; an empty table gives no pieces.
    """
    kind = docs.schema[doc_id].dataType
    fields = [T.StructField("doc_id", kind)] + [
        T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "loss_tokens")]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def cut(batches):
        encoder, last = _tokens.word_encoder(vocabulary), np.array([end_id], "<u4")
        for whole in batches:
            for batch in _tokens.text_slices(whole, "text"):
                flat, ends = encoder.encode(batch.column("text"))
                begin, rows, cuts = 0, [], []
                for i, end in enumerate(ends.tolist()):
                    ids = np.concatenate([flat[begin:end], last])
                    begin = end
                    for s in range(0, len(ids), max_tokens):
                        piece = ids[s:s + max_tokens]
                        rows.append((i, s, len(piece), zlib.crc32(piece.tobytes()), len(ids), len(piece)))
                        if with_ids:
                            cuts.append(piece.astype(np.int32))
                at = np.array(rows, dtype=np.int64).reshape(-1, 6)
                out = [batch.column("doc_id").take(pa.array(at[:, 0]))] + [pa.array(at[:, k]) for k in range(1, 6)]
                if with_ids:
                    out.append(pa.array(cuts, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, [f.name for f in fields])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, T.StructType(fields))


def dot_product_bins(demand: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, int]:
    """(bin of each row of ``demand``, bins used); every row must fit an empty bin.

    Rows of equal demand are one class, so a step looks at classes, not at rows. Ties go
    to the class with more tokens, then to the earlier row.
    """
    classes, member = np.unique(demand, axis=0, return_inverse=True)
    member = member.reshape(-1)
    order = np.argsort(member, kind="stable")
    left = np.bincount(member, minlength=len(classes))
    taken = np.concatenate([[0], np.cumsum(left)[:-1]])
    share = classes / limits
    weight = (demand / limits).sum(axis=0)
    weight = weight / max(weight.max(), 1e-12)
    bins, used, remaining = np.empty(len(demand), np.int64), 0, len(demand)
    alive = np.arange(len(classes))
    while remaining:
        alive = alive[left[alive] > 0]
        cost, part = classes[alive], share[alive]
        rest = limits.copy()
        top = len(alive)
        while True:
            # classes are sorted by their first measure, so what is too long is cut off at once
            top = min(top, int(np.searchsorted(cost[:top, 0], rest[0], side="right")))
            fits = (cost[:top] <= rest).all(axis=1) & (left[alive[:top]] > 0)
            if not fits.any():
                break
            score = np.where(fits, part[:top] @ (weight * rest / limits), -1.0)
            k = top - 1 - int(np.argmax(score[::-1]))
            c = alive[k]
            bins[order[taken[c]]] = used
            taken[c] += 1
            left[c] -= 1
            remaining -= 1
            rest = rest - classes[c]
        used += 1
    return bins, used


def pack(pieces: DataFrame, limits: Limits = Limits(), tokens: str = "length", loss: str = "loss_tokens",
         group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset (tokens before the piece in its sequence, from 0 without gaps).

    ``pieces`` is any table with a token count and a loss-bearing count per row; all its
    columns are passed on (columns called sequence_id or offset are replaced). Null counts
    count as 0. A piece that alone exceeds a limit raises. The pieces are written to the
    shared folder once, so that the packing can be repeated without tokenising again.
    Equal pieces are separate items: their group follows from their place in that table,
    so a document repeated a billion times spreads over all groups.
    """
    pieces = keep(pieces.drop("sequence_id", "offset"), "pieces")
    groups = max(1, math.ceil(pieces.count() / group_pieces))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    bound = np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=np.int64)
    names = pieces.columns
    group, = free(pieces, "__group")

    def place(key, table):
        demand = np.column_stack([
            table.column(tokens).fill_null(0).to_numpy(), np.ones(table.num_rows, np.int64),
            table.column(loss).fill_null(0).to_numpy()]).astype(np.int64)
        if (demand > bound).any():
            raise ValueError("a piece exceeds the limits of a sequence")
        bins, _ = dot_product_bins(demand, bound)
        order = np.lexsort((-demand[:, 0], bins))
        length = pd.Series(demand[order, 0])
        inside = (length.groupby(bins[order]).cumsum() - length).to_numpy()
        offset = np.empty(len(bins), np.int64)
        offset[order] = inside
        ids = bins + (int(key[0].as_py()) << 32)
        return table.select(names).append_column("sequence_id", pa.array(ids)).append_column(
            "offset", pa.array(offset))

    dealt = pieces.withColumn(group, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy(group).applyInArrow(place, schema)
