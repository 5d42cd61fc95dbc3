"""Records of delimited text files as they are, whatever the number of their cells.

Files are read in splits, line by line. Whether a line break ends a record depends on the quotes
before it, so a first scan reduces every split to one small row: how many quotes it holds, odd or
even, and how many records start in it if it begins outside or inside a quoted cell. Lined up by
file and place, these rows say where each split begins and which number its first record has. The
second scan cuts lines into records and records into cells; only the pieces of a record that runs
over the end of a split are put together afterwards. The lines are never shuffled.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlore.plans.shape import BROADCAST_ROWS, same_keys

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_CELLS = pa.list_(pa.string())
_OUT = pa.schema([("row_no", pa.int64()), ("file_no", pa.int32()), ("file_row", pa.int64()), ("cells", _CELLS),
                  ("part", pa.int32()), ("piece", pa.string())])
_KIND = "row_no bigint, file_no int, file_row bigint, cells array<string>, part int, piece string"


def cells_of(record: str, sep: str = ",", quote: str = '"', trim: bool = False) -> list[str | None]:
    """The cells of one record; an empty cell is null unless it is quoted.

    Quotes within a quoted cell are doubled. Text around a quoted part of a cell is kept, or
    trimmed with ``trim``, which leaves the quoted part alone.
    """
    pieces = record.split(quote)
    cells, cell, quoted = [], [], False

    def end() -> None:
        nonlocal cell, quoted
        text = "".join(cell)
        cells.append(text if text or quoted else None)
        cell, quoted = [], False

    for i, piece in enumerate(pieces):
        if i % 2:  # between quotes
            cell.append(piece)
            quoted = True
        elif not piece and 0 < i < len(pieces) - 1:  # two quotes in a row
            cell.append(quote)
        else:
            for k, text in enumerate(piece.split(sep)):
                if k:
                    end()
                cell.append(text.strip() if trim else text)
    end()
    return cells


def _plain_cells(records: pa.Array, sep: str, trim: bool) -> pa.Array:
    """The cells of records without quotes."""
    split = pc.split_pattern(records, sep)
    flat = split.flatten()
    if trim:
        flat = pc.utf8_trim_whitespace(flat)
    flat = pc.if_else(pc.equal(flat, ""), pa.scalar(None, pa.string()), flat)
    offsets = pc.subtract(split.offsets, split.offsets[0])
    return pa.ListArray.from_arrays(offsets, flat)


class _Starts:
    """Where every split begins: some 25 bytes each."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: (r["file"], r["block"]))
        self.files, self.broken = [], False
        keys, parity, first, file_no, file_first = [], [], [], [], []
        state = total = 0
        for r in rows:
            if not self.files or self.files[-1] != r["file"]:
                self.files.append(r["file"])
                state, begin = 0, total
            keys.append(r["key"])
            parity.append(state)
            first.append(total)
            file_no.append(len(self.files) - 1)
            file_first.append(begin)
            total += r["inside"] if state else r["outside"]
            state = (state + r["odd"]) % 2
            self.broken |= state == 1
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        if len(np.unique(self.keys)) < len(keys):
            raise ValueError("two file splits with one hash")
        self.parity, self.file_no = np.array(parity, np.int8)[order], np.array(file_no, np.int32)[order]
        self.first, self.file_first = np.array(first, np.int64)[order], np.array(file_first, np.int64)[order]
        self.part = np.arange(len(keys), dtype=np.int32)[order]

    def of(self, key: int) -> tuple[int, int, int, int, int]:
        at = int(np.searchsorted(self.keys, key))
        if at == len(self.keys) or self.keys[at] != key:
            raise ValueError("the files were split otherwise, or changed, between two scans")
        return tuple(int(x[at]) for x in (self.parity, self.first, self.part, self.file_no, self.file_first))


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1 if len(values) else []
    return list(zip([0, *cuts], [*cuts, len(values)])) if len(values) else []


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: quotes odd or even, records starting outside and inside quotes."""
    seen: dict[int, list] = {}
    for batch in batches:
        keys = batch.column("key").to_numpy()
        odd = batch.column("quotes").to_numpy() % 2
        full = ~batch.column("blank").to_numpy(zero_copy_only=False)
        for a, b in _runs(keys):
            row = seen.setdefault(int(keys[a]), [batch.column("file")[a].as_py(), batch.column("block")[a].as_py(), 0, 0, 0])
            before = (np.cumsum(odd[a:b]) - odd[a:b] + row[2]) % 2
            row[3] += int((full[a:b] & (before == 0)).sum())
            row[4] += int((full[a:b] & (before == 1)).sum())
            row[2] = int((row[2] + odd[a:b].sum()) % 2)
    yield pa.RecordBatch.from_pylist(
        [dict(key=k, file=r[0], block=r[1], odd=r[2], outside=r[3], inside=r[4]) for k, r in seen.items()],
        pa.schema([("key", pa.int64()), ("file", pa.string()), ("block", pa.int64()), ("odd", pa.int64()), ("outside", pa.int64()), ("inside", pa.int64())]))


def _records(batches: Iterator[pa.RecordBatch], starts: _Starts, sep: str, quote: str, trim: bool) -> Iterator[pa.RecordBatch]:
    key, open_, number = None, None, 0  # lines and number of the record that is not at its end
    part = file_no = file_first = parity = upcoming = 0
    continued = False

    def batch_of(numbers: np.ndarray, cells: pa.Array) -> pa.RecordBatch:
        n = len(numbers)
        return pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int64()), pa.array(np.full(n, file_no, np.int32)), pa.array(numbers - file_first, pa.int64()), cells,
             pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], schema=_OUT)

    def piece(lines: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"row_no": number, "file_no": file_no, "file_row": number - file_first, "cells": None,
                                            "part": part, "piece": "\n".join(lines)}], _OUT)

    for batch in batches:
        keys, values = batch.column("key").to_numpy(), batch.column("value")
        for a, b in _runs(keys):
            if keys[a] != key:
                if open_:
                    yield piece(open_)
                key = int(keys[a])
                parity, upcoming, part, file_no, file_first = starts.of(key)
                open_, continued, number = ([] if parity else None), bool(parity), upcoming - 1
            lines = values.slice(a, b - a)
            odd = pc.count_substring(lines, quote).to_numpy(zero_copy_only=False) % 2
            after = (parity + np.cumsum(odd)) % 2
            begins = (after ^ odd) == 0
            blank = begins & (pc.binary_length(pc.ascii_trim_whitespace(lines)).to_numpy(zero_copy_only=False) == 0)
            begins &= ~blank
            numbers = upcoming + np.cumsum(begins) - 1
            upcoming, parity = int(numbers[-1]) + 1, int(after[-1])
            single = begins & (after == 0)
            whole = pc.utf8_rtrim(lines.filter(pa.array(single)), characters="\r")
            marked = pc.match_substring(whole, quote).to_numpy(zero_copy_only=False)
            if not marked.all():
                yield batch_of(numbers[single][~marked], _plain_cells(whole.filter(pa.array(~marked)), sep, trim))
            done = [(n, r) for n, r in zip(numbers[single][marked].tolist(), whole.filter(pa.array(marked)).to_pylist())]
            for i in np.flatnonzero(~single & ~blank).tolist():
                line = lines[i].as_py()
                if begins[i]:
                    open_, number, continued = [line], int(numbers[i]), False
                else:
                    open_.append(line)
                    if after[i] == 0:
                        if continued:
                            yield piece(open_)
                        else:
                            done.append((number, "\n".join(open_).rstrip("\r")))
                        open_, continued = None, False
            if done:
                cells = pa.array([cells_of(r, sep, quote, trim) for _, r in done], _CELLS)
                yield batch_of(np.array([n for n, _ in done], np.int64), cells)
    if open_:
        yield piece(open_)


def _lines(spark: SparkSession, path) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    bom = F.regexp_replace("value", "^﻿", "")
    start = F.col("_metadata.file_block_start")
    return lines.select(F.when(start == 0, bom).otherwise(F.col("value")).alias("value"),
                        F.col("_metadata.file_path").alias("file"), start.alias("block")).withColumn("key", F.xxhash64("file", "block"))


def read_raw(spark: SparkSession, path: str | list[str], sep: str = ",", quote: str = '"', trim: bool = False) -> DataFrame:
    """(row_no, file, file_row, cells, file_no): every record of the files with all its cells.

    ``row_no`` counts the records from 0 by file path, then by place; ``file_row`` within the file,
    so a header has 0. Quoted cells may hold separators, line breaks and doubled quotes. Blank
    lines are no records; an empty cell is null unless quoted; a quote that is never closed takes
    the rest of its file. Files without records give none.

    The files are scanned once here, and again when the result is read. What the driver collects
    and sends is one row of some 25 bytes, and a path, per file split.
    """
    if len(sep) != 1 or len(quote) != 1 or sep == quote or "\n" in (sep, quote):
        raise ValueError("sep and quote are two different characters")
    lines = _lines(spark, path)
    facts = lines.select("key", "file", "block", (F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))).alias("quotes"),
                         F.col("value").rlike(r"^[\s\x0b]*$").alias("blank"))
    starts = _Starts(facts.mapInArrow(_counted, "key bigint, file string, block bigint, odd bigint, outside bigint, inside bigint").collect())
    files = spark.createDataFrame(list(enumerate(starts.files)), "file_no int, file string")
    sent = spark.sparkContext.broadcast(starts)
    cut = lines.select("key", "value").mapInArrow(lambda b: _records(b, sent.value, sep, quote, trim), _KIND)
    out = cut.where("piece is null").select("row_no", "file_no", "file_row", "cells")
    if starts.broken:
        # pieces of records over the end of a split: one or two per split
        pieces = cut.where("piece is not null").groupBy("row_no", "file_no", "file_row").agg(
            F.array_sort(F.collect_list(F.struct("part", "piece"))).alias("pieces"))
        texts = pieces.select("row_no", "file_no", "file_row", F.array_join(F.col("pieces.piece"), "\n").alias("text"))

        def cells(batches):
            for batch in batches:
                found = [cells_of(t.rstrip("\r"), sep, quote, trim) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, _CELLS)], ["row_no", "file_no", "file_row", "cells"])

        out = out.unionByName(texts.mapInArrow(cells, "row_no bigint, file_no int, file_row bigint, cells array<string>"))
    return same_keys(out, files, ["file_no"], small_right=len(starts.files) <= BROADCAST_ROWS).select("row_no", "file", "file_row", "cells", "file_no")
