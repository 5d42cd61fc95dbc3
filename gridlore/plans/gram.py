"""Correlations of many columns in one pass: masked Gram matrices that merge like sums.

A batch of rows is one matrix; a few matrix products give, for every two columns, count, means,
squares and products over the rows that have both. A task adds its batches up by the pairwise
update of such moments (which keeps the digits), and tasks are added up by row of the matrix, some
tasks at a time. The plan is the same for two columns and for two thousand.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from gridlore.functions.numeric import as_double
from gridlore.plans.shape import quoted

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Partial states that are added up in one step.
FAN_IN = 256
#: Groups whose states a task holds before it hands them on.
HELD_GROUPS = 64
#: Relative size below which a spread is taken for rounding.
_NOISE = 1e-13


def moments(x: np.ndarray) -> np.ndarray:
    """(6, k, k): n, mean of the row's and of the column's variable, their squared deviations and
    the product of deviations, over the rows of ``x`` that have both (NaN: missing)."""
    here = ~np.isnan(x)
    endless = np.isinf(x)
    some = np.where(here & ~endless, x, 0.0)
    n_each = np.maximum(here.sum(axis=0), 1)
    low = np.where(here, x, np.inf).min(axis=0, initial=np.inf)
    high = np.where(here, x, -np.inf).max(axis=0, initial=-np.inf)
    # a constant column is moved to exactly 0, any other one near it
    centre = np.where(low == high, np.where(np.isfinite(low), low, 0.0), some.sum(axis=0) / n_each)
    y = np.where(here & ~endless, some - centre, 0.0)
    mask = here.astype(np.float64)
    n = mask.T @ mask
    total = y.T @ mask
    part = np.maximum(n, 1)
    mean = total / part
    raw = (y * y).T @ mask
    square = raw - total * mean
    square[square <= _NOISE * raw] = 0.0
    product = y.T @ y - total * mean.T
    if endless.any():
        wild = endless.astype(np.float64).T @ mask
        product[(wild > 0) | (wild.T > 0)] = np.nan
    return np.stack([n, mean + centre[:, None], mean.T + centre[None, :], np.maximum(square, 0.0), np.maximum(square.T, 0.0), product])


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The moments of two sets of rows together."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    dx, dy = b[1] - a[1], b[2] - a[2]
    dx, dy = np.where((a[0] > 0) & (b[0] > 0), dx, 0.0), np.where((a[0] > 0) & (b[0] > 0), dy, 0.0)
    weight = a[0] * share
    first = a[0] > 0
    return np.stack([n, np.where(first, a[1] + dx * share, b[1]), np.where(first, a[2] + dy * share, b[2]),
                     a[3] + b[3] + dx * dx * weight, a[4] + b[4] + dy * dy * weight, a[5] + b[5] + dx * dy * weight])


def pair_correlations(df: DataFrame, cols: Sequence[str], group_by: Sequence[str] = ()) -> DataFrame:
    """(group_by, i, j, r): Pearson of the columns numbered i < j over the rows that have both;
    no row where it does not exist."""
    k, groups = len(cols), len(group_by)
    keys = [df.schema[g] for g in group_by]
    state = StructType()
    for g, field in enumerate(keys):
        state = state.add(f"g{g}", field.dataType)
    state = state.add("part", "integer").add("i", "integer").add("state", "binary")
    names = [f"g{g}" for g in range(groups)]

    def sums(batches):
        part, held = TaskContext.get().partitionId() // FAN_IN, {}

        def rows():
            found = [(*key, part, i, np.ascontiguousarray(m[:, i, i + 1:]).tobytes()) for key, m in held.items() for i in range(k - 1)]
            columns = list(zip(*found)) or [[]] * (groups + 3)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*kinds, pa.int32(), pa.int32(), pa.binary()])],
                                              [*names, "part", "i", "state"])

        kinds = []
        for batch in batches:
            kinds = [c.type for c in batch.columns[:groups]]
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns[groups:]])
            if not groups:
                here = {(): slice(None)}
            else:
                where: dict = {}
                for at, key in enumerate(zip(*(c.to_pylist() for c in batch.columns[:groups]))):
                    where.setdefault(key, []).append(at)
                here = where
            for key, at in here.items():
                m = moments(x[at])
                held[key] = added(held[key], m) if key in held else m
            if len(held) > HELD_GROUPS:
                yield rows()
                held = {}
        if held:
            yield rows()

    values = [F.coalesce(as_double(quoted(c)), F.lit(float("nan"))).alias(f"v{i}") for i, c in enumerate(cols)]
    wide = df.select(*[quoted(g).alias(n) for g, n in zip(group_by, names)], *values)
    parts = wide.mapInArrow(sums, state)

    def whole(table: pa.Table) -> np.ndarray:
        total = None
        for raw in table.column("state"):
            m = np.frombuffer(raw.as_buffer(), np.float64).reshape(6, -1)
            total = m.copy() if total is None else added(total, m)
        return total

    def add(table: pa.Table) -> pa.Table:
        one = table.slice(0, 1).drop_columns(["state"])
        return one.append_column("state", pa.array([whole(table).tobytes()], pa.binary()))

    def finish(table: pa.Table) -> pa.Table:
        m, i = whole(table), table.column("i")[0].as_py()
        for square, mean in ((m[3], m[1]), (m[4], m[2])):  # values that differ by rounding only are one
            square[square <= m[0] * (_NOISE * mean) ** 2] = 0.0
        with np.errstate(invalid="ignore", divide="ignore"):
            r = m[5] / (np.sqrt(m[3]) * np.sqrt(m[4]))
        j = np.flatnonzero(np.isfinite(r))
        first = [pa.array([table.column(n)[0].as_py()] * len(j), table.schema.field(n).type) for n in names]
        return pa.table([*first, pa.array(np.full(len(j), i, np.int32)), pa.array((j + i + 1).astype(np.int32)),
                         pa.array(np.clip(r[j], -1.0, 1.0))], names=[*names, "i", "j", "r"])

    out = StructType()
    for n, field in zip(names, keys):
        out = out.add(n, field.dataType)
    out = out.add("i", "integer").add("j", "integer").add("r", "double")
    merged = parts.groupBy(*names, "part", "i").applyInArrow(add, state)
    found = merged.groupBy(*names, "i").applyInArrow(finish, out)
    return found.select(*[F.col(n).alias(g) for n, g in zip(names, group_by)], "i", "j", "r")
