"""The seasonal model for one series of any length.

The model is the same as that of many short series: a bent line times (1 + waves), fitted in turn
by ridge least squares. Here a task adds its rows up to the normal equations of a step, a few dozen
numbers squared; the sums of all tasks are added and solved, and the next step reads the rows again.
No step sorts or moves the rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F

from gridlore.operators import forecast as short
from gridlore.session import pin

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Points from which a single series is fitted in ranges.
LONG = 100_000
#: Sums of so many tasks are added in one step.
FAN_IN = 256
STEPS = 4


def added_up(rows: DataFrame, work: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``work(days, y)``, an array of a fixed size, over all batches of (day, y)."""
    def one(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                found = work(batch.column("day").to_numpy(), batch.column("y").to_numpy())
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() // FAN_IN]), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer()) for x in table.column("sums"))
        return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})

    parts = rows.mapInArrow(one, "part bigint, sums binary").groupBy("part").applyInArrow(add, "sums binary")
    return sum(np.frombuffer(r["sums"]) for r in parts.collect())  # one row per FAN_IN tasks


class LongFit:
    """Scale, knots and coefficients; ``parts`` gives the components at any days."""

    def __init__(self, first: float, span: float, n: int, scale: float, frequency: str):
        self.first, self.span, self.scale = first, max(span, 1e-9), scale or 1.0
        self.waves = [p for p, wanted in (("yearly", self.span >= 730), ("weekly", self.span >= 14 and frequency == "D")) if wanted]
        self.knots = np.linspace(0, 0.8, min(25, max(0, n // 3)) + 2)[1:-1] if n >= 6 else np.array([])
        self.bend = np.array([1e-8, 1e-8, *[0.5] * len(self.knots)])
        self.line, self.beta = np.zeros(len(self.bend)), np.zeros(sum(2 * short._FOURIER[p][1] for p in self.waves))
        self.spread = 0.0

    def base(self, days: np.ndarray) -> np.ndarray:
        return short._hinges((days - self.first) / self.span, self.knots)

    def season(self, days: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict]:
        waves, where = short._waves(days, self.waves)
        return waves, waves @ self.beta, where

    def yhat(self, days: np.ndarray) -> np.ndarray:
        return self.base(days) @ self.line * (1.0 + self.season(days)[1]) * self.scale

    def parts(self, days: np.ndarray) -> dict[str, np.ndarray]:
        waves, season, where = self.season(days)
        trend = self.base(days) @ self.line * self.scale
        yhat = trend * (1.0 + season)
        out = {"yhat": yhat, "yhat_lower": yhat - self.spread, "yhat_upper": yhat + self.spread, "trend": trend}
        for part in short._FOURIER:
            out[part] = waves[:, where[part]] @ self.beta[where[part]] if part in where else np.full(len(days), np.nan)
        return out


def _solved(rows: DataFrame, penalty: np.ndarray, design: Callable) -> np.ndarray:
    """Ridge coefficients of ``design(days, y)`` = (matrix, target), from its normal equations."""
    k = len(penalty)

    def equations(days, y):
        x, target = design(days, y)
        return np.concatenate([(x.T @ x).reshape(-1), x.T @ target])

    sums = added_up(rows, equations)
    return np.linalg.lstsq(sums[:k * k].reshape(k, k) + np.diag(penalty), sums[k * k:], rcond=None)[0]


def fit_long(rows: DataFrame, frequency: str) -> LongFit:
    """Fits (day, y); the rows are read once per step."""
    seen = rows.agg(F.count("*"), F.min("day"), F.max("day"), F.max(F.abs("y"))).first()
    fit = LongFit(seen[1], seen[2] - seen[1], seen[0], seen[3], frequency)
    for _ in range(STEPS if fit.waves else 1):
        def trend(days, y):
            return fit.base(days) * (1.0 + fit.season(days)[1])[:, None], y / fit.scale

        def waves(days, y):
            level = fit.base(days) @ fit.line
            return fit.season(days)[0] * level[:, None], y / fit.scale - level

        fit.line = _solved(rows, fit.bend, trend)
        if fit.waves:
            fit.beta = _solved(rows, np.full(len(fit.beta), 1e-3), waves)

    def rest(days, y):
        off = y - fit.yhat(days)
        return np.array([len(y), off.sum(), (off * off).sum()])

    n, total, square = added_up(rows, rest)
    fit.spread = short.INTERVAL_Z * float(np.sqrt(max(0.0, square / n - (total / n) ** 2))) if n > 2 else 0.0
    return fit


def long_seasonal_model(series: DataFrame, periods: int, frequency: str) -> DataFrame:
    """As ``seasonal_model`` for one series (ds, y)."""
    rows = pin(series.select("ds", (F.unix_micros("ds") / F.lit(short.DAY * 1e6)).alias("day"), F.col("y").cast("double").alias("y")))
    fit = fit_long(rows.select("day", "y"), frequency)
    shared = series.sparkSession.sparkContext.broadcast(fit)
    names = ["yhat", "yhat_lower", "yhat_upper", "trend", "yearly", "weekly"]

    def show(batches):
        for batch in batches:
            found = shared.value.parts(batch.column("day").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("ds"), batch.column("y"), *[pa.array(found[n]) for n in names]], ["ds", "y", *names])

    seen = rows.mapInArrow(show, "ds timestamp, y double, " + ", ".join(f"{n} double" for n in names)).withColumn("is_forecast", F.lit(False))
    last = rows.agg(F.max("ds")).first()[0]
    future = short._future(pd.Timestamp(last), periods, frequency)
    days = (future - pd.Timestamp(0)).dt.total_seconds().to_numpy() / short.DAY
    ahead = pd.DataFrame({"ds": future, "y": np.nan, **fit.parts(days), "is_forecast": True})
    return seen.unionByName(series.sparkSession.createDataFrame(ahead, seen.schema))
