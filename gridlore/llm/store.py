"""Intermediate tables in the folder all executors share, and row keys."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, functions as F

from gridlore.session import shared_dir


def new_folder(spark, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


#: Bytes of a batch that goes to a Python worker while a table is written: long texts would
#: otherwise come by ten thousand, held on both sides at once.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def keep(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes the rows as a table in the shared folder and reads them back.

    Cuts lineage: what follows survives lost executors without computing ``df`` again.
    """
    spark = df.sparkSession
    path = path or new_folder(spark, name)
    before = spark.conf.get(_BATCH, None)
    if before is None or not before.isdigit() or int(before) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def row_hash(*cols: str | Column, seed: int = 0) -> Column:
    """64-bit hash of the values; a null and an empty text hash differently."""
    marked = []
    for c in cols:
        c = F.col(c) if isinstance(c, str) else c
        marked += [c.isNull(), c]
    return F.xxhash64(F.lit(seed), *marked)


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, for models loaded once per process."""
    return sys.modules.setdefault("_gridlore_worker", types.ModuleType("_gridlore_worker")).__dict__


def free(df: DataFrame, *names: str) -> list[str]:
    """Names for work columns that no column of the table has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
