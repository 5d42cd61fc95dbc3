"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

An id is replaced by its rank (0 for the most frequent id of the whole corpus). A rank
takes one to four bytes, little endian; its byte count less one is two bits of a control
byte, four ranks to a control byte, first rank in the lowest bits. Control bytes and data
bytes are stored apart, so a reader finds all lengths by one table lookup per control byte.

A file is a folder: ``ranks`` (rank, id, n) and ``blocks``, rows of (file_no, block_no,
block_start, n_ids, block) written and committed by Spark, so it works on any file system Spark writes to and
a lost task leaves no half file. Blocks of a file, and files, follow ascending doc_id.

Block: magic ``RVB1``, documents, ids, control bytes, data bytes (four unsigned 64-bit
integers), then per document a null mark (1 byte), doc_id (signed 64-bit) and token count
(unsigned 64-bit), then the control bytes, then the data bytes.
"""

from __future__ import annotations

import struct
import sys
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from gridlore.llm import tokens as _tokens
from gridlore.llm.store import keep

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAGIC = b"RVB1"
#: Ids after which a block is closed.
BLOCK_IDS = 1_000_000
#: Ids whose counts of one task stand in one row.
_SLICE = 8192
_HEAD = "<4sQQQQ"
#: Control byte -> the four byte counts.
_LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], dtype=np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned ranks below 2**32."""
    ranks = ranks.astype("<u4")
    n = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[:len(ranks)] = n - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    used = np.arange(4) < n[:, None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """Inverse of ``encode_ranks``: all byte counts come from one table lookup."""
    lengths = _LENGTHS[control].reshape(-1)[:n].astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    data = np.concatenate([data, np.zeros(4, np.uint8)])
    out = data[starts].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        if len(longer):
            out[longer] |= data[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _block(docs: list, ranks: np.ndarray) -> bytes:
    control, data = encode_ranks(ranks)
    table = np.array([(d is None, d or 0, n) for d, n in docs], dtype=[("null", "u1"), ("id", "<i8"), ("n", "<u8")])
    return b"".join([struct.pack(_HEAD, MAGIC, len(docs), len(ranks), len(control), len(data)), table.tobytes(), control, data])


def _read_block(block: memoryview) -> tuple[np.ndarray, np.ndarray]:
    """(document table, ranks)"""
    magic, docs, ids, control, data = struct.unpack_from(_HEAD, block)
    if magic != MAGIC:
        raise ValueError("not a block of ranked ids")
    at = struct.calcsize(_HEAD)
    table = np.frombuffer(block, dtype=[("null", "u1"), ("id", "<i8"), ("n", "<u8")], count=docs, offset=at)
    at += table.nbytes
    return table, decode_ranks(np.frombuffer(block, np.uint8, control, at),
                               np.frombuffer(block, np.uint8, data, at + control), ids)


def write_ids(docs: DataFrame, path: str, vocabulary: str, vocabulary_size: int, end_id: int,
              doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes every whole text, appends ``end_id`` and writes the id file at ``path``.

    Texts are tokenised once; their ids are kept in the shared folder, counted (all of
    them: at most ``vocabulary_size`` counts, which bounds the table sent to the tasks),
    sorted by doc_id and written as ranks. Null text: empty, so only the end id. A null
    doc_id comes first; rows with equal doc_ids stand side by side in the order of their
    text's bytes' hash. An empty table gives an empty file. Other columns are not read.
    """
    wide = "<u2" if vocabulary_size <= 65536 else "<u4"
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("ids", T.BinaryType()),
                           T.StructField("slice", T.IntegerType()), T.StructField("counts", T.BinaryType())])

    def encode(batches):
        encoder, total = _tokens.word_encoder(vocabulary), np.zeros(vocabulary_size, np.int64)
        for whole in batches:
            for batch in _tokens.text_slices(whole, "text"):
                flat, ends = encoder.encode(batch.column("text"))
                flat = np.insert(flat, ends, end_id).astype(wide)
                total += np.bincount(flat, minlength=vocabulary_size)
                stops = (ends + np.arange(1, len(ends) + 1)) * flat.itemsize
                raw = pa.Array.from_buffers(pa.large_binary(), len(ends), [
                    None, pa.py_buffer(np.concatenate([[0], stops]).astype(np.int64)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("tie"), raw.cast(pa.binary()), pa.nulls(len(ends), pa.int32()),
                     pa.nulls(len(ends), pa.binary())], names)
        if total.any():  # this task's counts of all ids, in slices
            parts = [total[k:k + _SLICE].tobytes() for k in range(0, vocabulary_size, _SLICE)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.binary()),
                 pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names)

    names = schema.names
    read = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tie"),
                       F.col(text).alias("text"))
    kept = keep(read.mapInArrow(encode, schema), "ids")
    ids = kept.where("slice is null").select("doc_id", "tie", "ids")
    ranks = _ranks(kept.where("slice is not null").select("slice", "counts"))
    ranks.write.parquet(f"{path}/ranks")
    place = np.zeros(vocabulary_size, np.uint32)
    for row in ids.sparkSession.read.parquet(f"{path}/ranks").toLocalIterator():
        place[row["id"]] = row["rank"]
    _sorted_blocks(ids, place, wide).write.option("compression", "zstd").parquet(f"{path}/blocks")


def _ranks(parts: DataFrame) -> DataFrame:
    """(rank, id, n) over all documents, from every task's counts in slices of ids."""
    def add(key, table):
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column("counts"))
        seen = np.flatnonzero(total)
        return pa.table({"id": seen + key[0].as_py() * _SLICE, "n": total[seen]})

    counts = parts.groupBy("slice").applyInArrow(add, "id bigint, n bigint")
    # at most one row per vocabulary entry
    place = F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1
    return counts.select(place.cast("bigint").alias("rank"), "id", "n")


def _sorted_blocks(ids: DataFrame, place: np.ndarray, wide: str) -> DataFrame:
    shared = ids.sparkSession.sparkContext.broadcast(place)

    def write(batches):
        from pyspark import TaskContext

        file_no, block_no, docs, parts, held, before = TaskContext.get().partitionId(), 0, [], [], 0, 0
        table = shared.value

        def close():
            return pa.RecordBatch.from_arrays(
                [pa.array([file_no], pa.int64()), pa.array([block_no], pa.int64()),
                 pa.array([before], pa.int64()), pa.array([held], pa.int64()),
                 pa.array([_block(docs, np.concatenate(parts))], pa.binary())],
                ["file_no", "block_no", "block_start", "n_ids", "block"])

        for batch in batches:
            sizes = pc.binary_length(batch.column("ids")).to_numpy() // np.dtype(wide).itemsize
            flat = table[np.frombuffer(b"".join(batch.column("ids").to_pylist()), wide)]
            for d, n, end in zip(batch.column("doc_id").to_pylist(), sizes.tolist(), np.cumsum(sizes).tolist()):
                docs.append((d, n))
                parts.append(flat[end - n:end])
                held += n
                if held >= BLOCK_IDS:
                    yield close()
                    block_no, docs, parts, held, before = block_no + 1, [], [], 0, before + held
        if docs:
            yield close()

    ordered = ids.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return ordered.select("doc_id", "ids").mapInArrow(
        write, "file_no bigint, block_no bigint, block_start bigint, n_ids bigint, block binary")


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Reads an id file back: doc_id, start (ids of all documents before), n_tokens,
    ids_crc32 (unsigned, of the ids as little-endian unsigned 32-bit integers), and the
    ids themselves if ``with_ids``.

    Starts come from two levels of sums: the writer's within a file, then one row per file.
    """
    back = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], dtype="<u4")
    shared = spark.sparkContext.broadcast(back)
    blocks = spark.read.parquet(f"{path}/blocks")
    files = blocks.groupBy("file_no").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids

    def decode(batches):
        table = shared.value
        for batch in batches:
            for first, raw in zip(batch.column("first").to_pylist(), batch.column("block")):
                docs, ranks = _read_block(memoryview(raw.as_buffer()))
                ids, sizes_ = table[ranks], docs["n"].astype(np.int64)
                ends = np.cumsum(sizes_)
                parts = [ids[e - n:e] for e, n in zip(ends.tolist(), sizes_.tolist())]
                cols = [pa.array(docs["id"].astype(np.int64), mask=docs["null"].astype(bool)),
                        pa.array(first + ends - sizes_), pa.array(sizes_),
                        pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())]
                if with_ids:
                    cols.append(pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64())))
                names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(cols)]
                yield pa.RecordBatch.from_arrays(cols, names)

    # one small row per file, as many as the writing job had tasks
    placed = blocks.join(F.broadcast(files), "file_no")
    return placed.select((F.col("file_start") + F.col("block_start")).alias("first"), "block").mapInArrow(decode, schema)
