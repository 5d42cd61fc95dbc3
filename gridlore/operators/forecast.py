"""Forecasts for one series or many.

A series is first reduced to one value per calendar unit, so its length is bounded by
the calendar and not by the table. What follows works per series: windows and aggregates
for the straight line, and for the seasonal model stacks of series that have equally many points
and the same waves, fitted side by side from Arrow batches with one row per series. A series without
keys can be long (a unit may be a second): it is lined up in ranges, and from LONG points on
its seasonal model is fitted from sums over ranges (``long_series``).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from gridlore.functions.numeric import as_double, mean_of, number_from_text, rounded
from gridlore.functions.schema import columns_of
from gridlore.plans.position import with_previous
from gridlore.plans.shape import quoted, same_keys

# The functions run in tasks travel with them: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the rules.
PERIODS, PERIODS_MAX = 12, 120
DAILY_GAP, WEEKLY_GAP = 2, 10
SEASONAL_MINIMUM = {"D": 14, "W": 4, "M": 2}
LINEAR_BAND = 0.1
DEFAULT_STEP_DAYS = 30
INTERVAL_Z = 1.2816  # 80 %
DAY = 86400


def prepare_series(df: DataFrame, date: str, value: str, keys: Sequence[str] = (), grain: str = "day",
                   agg: str = "first", order_by: Sequence[str] = ()) -> DataFrame:
    """(keys, ds, y): one value per key and calendar unit, nulls dropped.

    ``first`` keeps the earliest row of the unit (ties by ``order_by``, then by value);
    ``sum`` and ``mean`` aggregate it. Either way units shrink before the shuffle.
    """
    raw = number_from_text(quoted(value)) if value in columns_of(df, "text") else as_double(quoted(value))
    when = quoted(date).try_cast("timestamp")
    rows = df.select(*map(quoted, keys), when.alias("__at"), raw.alias("__y"),
                     F.struct(when, *map(quoted, order_by), raw).alias("__order"))
    rows = rows.where("__at is not null and __y is not null")
    pick = {"first": F.min_by("__y", "__order"), "sum": F.sum("__y"), "mean": mean_of(F.col("__y"))}[agg]
    return rows.groupBy(*map(quoted, keys), F.date_trunc(grain, "__at").alias("ds")).agg(pick.alias("y"))


def _with_gaps(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the position in the series and the seconds since the point before. A series without
    keys is looked at in ranges, others in a window each."""
    if not keys:
        lined = with_previous(series, "ds")
        gap = F.unix_seconds("ds") - F.unix_seconds("__previous")
        return lined.withColumn("__pos", F.col("__pos").cast("double")).withColumn("__gap", gap).drop("__previous")
    w = Window.partitionBy(*map(quoted, keys)).orderBy("ds")
    gap = F.unix_seconds("ds") - F.unix_seconds(F.lag("ds").over(w))
    return series.withColumn("__pos", (F.row_number().over(w) - 1).cast("double")).withColumn("__gap", gap)


def detect_frequency(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, points, frequency): median gap up to 2 days D, up to 10 days W, else M."""
    gaps = _with_gaps(series, keys)
    # gaps of a calendar are few values, and median keeps each once
    out = gaps.groupBy(*map(quoted, keys)).agg(F.count("*").alias("points"), F.median("__gap").alias("__m"))
    freq = (F.when(F.col("__m").isNull() | (F.col("__m") <= DAILY_GAP * DAY), "D")
            .when(F.col("__m") <= WEEKLY_GAP * DAY, "W").otherwise("M"))
    return out.select(*map(quoted, keys), "points", freq.alias("frequency"))


def line_fit(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, points, slope, intercept, last, step): least squares on the position, the last
    date, and the most frequent gap in seconds (the smallest among ties)."""
    gaps = _with_gaps(series, keys)
    step = F.coalesce(F.mode("__gap", True), F.lit(DEFAULT_STEP_DAYS * DAY)).cast("bigint")
    return gaps.groupBy(*map(quoted, keys)).agg(
        F.count("*").alias("points"), F.coalesce(F.regr_slope("y", "__pos"), F.lit(0.0)).alias("slope"),
        F.coalesce(F.regr_intercept("y", "__pos"), F.avg("y")).alias("intercept"),
        F.max("ds").alias("last"), step.alias("step")).where("points > 0")


def _check(periods: int) -> int:
    if not 1 <= periods <= PERIODS_MAX:
        raise ValueError(f"periods must be 1 to {PERIODS_MAX}")
    return periods


def linear_forecast(series: DataFrame, periods: int = PERIODS, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, ds, yhat, yhat_lower, yhat_upper): the line continued, band 10 % of the value."""
    fit = line_fit(series, keys)
    ahead = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(_check(periods)))).alias("__i"))
    yhat = F.col("intercept") + F.col("slope") * (F.col("points") - 1 + F.col("__i"))
    at = F.timestamp_seconds(F.unix_seconds("last") + F.col("step") * F.col("__i"))
    return ahead.select(*map(quoted, keys), at.alias("ds"), yhat.alias("yhat"),
                        (yhat * (1 - LINEAR_BAND)).alias("yhat_lower"), (yhat * (1 + LINEAR_BAND)).alias("yhat_upper"))


def linear_fitted(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, ds, y, yhat): the line at the observed points."""
    rows = _with_gaps(series, keys)
    if not keys:
        fit = rows.agg(F.regr_slope("y", "__pos"), F.regr_intercept("y", "__pos"), F.avg("y")).first()
        slope, start = F.lit(fit[0] or 0.0), F.lit(fit[2] if fit[1] is None else fit[1]).cast("double")
    else:  # both sides are partitioned by series alike
        w = Window.partitionBy(*map(quoted, keys))
        slope = F.coalesce(F.regr_slope("y", "__pos").over(w), F.lit(0.0))
        start = F.coalesce(F.regr_intercept("y", "__pos").over(w), F.avg("y").over(w))
    return rows.select(*map(quoted, keys), "ds", "y", (start + slope * F.col("__pos")).alias("yhat"))


def forecast_metrics(df: DataFrame, actual: str = "y", predicted: str = "yhat", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, mae, rmse, mape): MAPE over actual values that are not 0."""
    y, p = as_double(quoted(actual)), as_double(quoted(predicted))
    e = y - p
    both = df.where(e.isNotNull())
    zero = lambda c: rounded(F.coalesce(c, F.lit(0.0)), 4)
    return both.groupBy(*map(quoted, keys)).agg(
        zero(F.avg(F.abs(e))).alias("mae"), zero(F.sqrt(F.avg(e * e))).alias("rmse"),
        zero(F.avg(F.when(F.abs(y) > 1e-9, F.abs(e / y))) * 100).alias("mape"))


def forecast_history(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, ds, y): the observed points in date order."""
    return series.select(*map(quoted, keys), "ds", "y").orderBy(*map(quoted, keys), "ds")


# Seasonal model: piecewise-linear trend times (1 + yearly and weekly waves), by ridge
# least squares. Series of equal shape are fitted as one stack of small matrices.

_FOURIER = {"yearly": (365.25, 10), "weekly": (7.0, 3)}
#: Numbers in the largest array of a stack.
STACK = 1 << 21


def _ridge(x: np.ndarray, y: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Ridge weights of every series of a stack: x (series, points, columns), y (series, points)."""
    rows = np.broadcast_to(np.diag(np.sqrt(penalty)), (len(x), len(penalty), len(penalty)))
    q, r = np.linalg.qr(np.concatenate([x, rows], axis=1))
    goal = np.swapaxes(q[:, :x.shape[1]], 1, 2) @ y[:, :, None]
    return np.linalg.solve(r, goal)[:, :, 0]


def _even_ridge(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    """``_ridge`` with one penalty for all columns; with fewer points than columns, the same
    weights come from the smaller system of the points."""
    n, width = x.shape[1:]
    if n >= width:
        return _ridge(x, y, np.full(width, penalty))
    across = np.swapaxes(x, 1, 2)
    return (across @ np.linalg.solve(x @ across + penalty * np.eye(n), y[:, :, None]))[:, :, 0]


def _waves(days: np.ndarray, parts: Sequence[str]) -> tuple[np.ndarray, dict[str, slice]]:
    """Sines and cosines as a last axis, and where each part's are."""
    cols, where = [], {}
    for part in parts:
        period, order = _FOURIER[part]
        start = len(cols)
        for k in range(1, order + 1):
            angle = 2 * np.pi * k * days / period
            cols += [np.sin(angle), np.cos(angle)]
        where[part] = slice(start, len(cols))
    return (np.stack(cols, axis=-1) if cols else np.zeros((*days.shape, 0))), where


def _hinges(t: np.ndarray, knots: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(t), t, *[np.maximum(t - k, 0.0) for k in knots]], axis=-1)


def _knots(n: int) -> np.ndarray:
    return np.linspace(0, 0.8, min(25, max(0, n // 3)) + 2)[1:-1] if n >= 6 else np.array([])


def fit_stack(days: np.ndarray, y: np.ndarray, parts: Sequence[str]) -> dict[str, np.ndarray]:
    """Fitted and future values of series of one shape with their components: days (series,
    points and periods) ascending, y (series, points)."""
    n = y.shape[1]
    span = np.maximum(days[:, n - 1] - days[:, 0], 1e-9)
    t = (days - days[:, :1]) / span[:, None]
    knots = _knots(n)
    base, (waves, where) = _hinges(t, knots), _waves(days, parts)
    scale = np.abs(y).max(axis=1)
    scale = np.where(scale == 0, 1.0, scale)[:, None]
    target, season = y / scale, np.zeros_like(t)
    bend = np.array([1e-8, 1e-8, *[0.5] * len(knots)])
    beta = np.zeros((len(y), waves.shape[2]))
    for _ in range(4 if parts else 1):
        level = 1.0 + season[:, :n]
        trend = (base @ _ridge(base[:, :n] * level[:, :, None], target, bend)[:, :, None])[:, :, 0]
        if parts:
            beta = _even_ridge(waves[:, :n] * trend[:, :n, None], target - trend[:, :n], 1e-3)
            season = (waves @ beta[:, :, None])[:, :, 0]
    yhat = trend * (1.0 + season) * scale
    spread = INTERVAL_Z * np.std(y - yhat[:, :n], axis=1)[:, None] if n > 2 else 0.0
    out = {"yhat": yhat, "yhat_lower": yhat - spread, "yhat_upper": yhat + spread, "trend": trend * scale}
    for part in _FOURIER:
        out[part] = (waves[:, :, where[part]] @ beta[:, where[part], None])[:, :, 0] if part in where else np.full_like(t, np.nan)
    return out


def _future(last: pd.Timestamp, periods: int, frequency: str) -> pd.Series:
    step = {"D": lambda i: last + pd.Timedelta(days=i), "W": lambda i: last + pd.Timedelta(days=7 * i),
            "M": lambda i: last + pd.DateOffset(months=i)}[frequency]
    return pd.Series([step(i) for i in range(1, periods + 1)])


def _ahead(last: np.ndarray, periods: int, frequency: str) -> np.ndarray:
    """(series, periods): what ``_future`` gives for each of many last moments in microseconds."""
    i = np.arange(1, periods + 1)
    if frequency != "M":
        return last[:, None] + i * (1 if frequency == "D" else 7) * DAY * 1_000_000
    at = last.astype("datetime64[us]")
    month = at.astype("datetime64[M]")
    into = at - at.astype("datetime64[D]")
    day = (at.astype("datetime64[D]") - month.astype("datetime64[D]")).astype(np.int64)
    months = month[:, None] + i
    longest = ((months + 1).astype("datetime64[D]") - months.astype("datetime64[D]")).astype(np.int64)
    days = months.astype("datetime64[D]") + np.minimum(day[:, None], longest - 1)
    return (days.astype("datetime64[us]") + into[:, None]).astype(np.int64)


def _modelled(batches: Iterator[pa.RecordBatch], keys: Sequence[str], periods: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``seasonal_model`` for batches of series (keys, __frequency, __at, __y)."""
    for batch in batches:
        at, y = batch.column("__at"), batch.column("__y")
        starts, sizes = at.offsets.to_numpy()[:-1], np.diff(at.offsets.to_numpy())
        at, y, y_starts = at.values.cast(pa.int64()).to_numpy(), y.values.to_numpy(), y.offsets.to_numpy()[:-1]
        frequency = np.array(batch.column("__frequency").to_pylist())
        span = (at[starts + sizes - 1] - at[starts]) / 1e6 / DAY
        shapes: dict[tuple, list[int]] = {}
        for i, shape in enumerate(zip(sizes.tolist(), frequency.tolist(), (span >= 730).tolist(), (span >= 14).tolist())):
            shapes.setdefault(shape, []).append(i)
        for (n, freq, yearly, weekly), members in shapes.items():
            parts = [p for p, wanted in (("yearly", yearly), ("weekly", weekly and freq == "D")) if wanted]
            step = max(1, STACK // ((n + periods) * 32))
            for k in range(0, len(members), step):
                some = np.array(members[k:k + step])
                moments = at[starts[some][:, None] + np.arange(n)]
                moments = np.concatenate([moments, _ahead(moments[:, -1], periods, freq)], axis=1)
                values = y[y_starts[some][:, None] + np.arange(n)]
                found = fit_stack(moments / 1e6 / DAY, values, parts)
                known = np.concatenate([values, np.full((len(some), periods), np.nan)], axis=1)
                of = pa.array(np.repeat(some, n + periods))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(key).take(of) for key in keys], pa.array(moments.ravel()).cast(pa.timestamp("us")), pa.array(known.ravel()),
                     *[pa.array(found[c].ravel()) for c in ("yhat", "yhat_lower", "yhat_upper", "trend", "yearly", "weekly")],
                     pa.array(np.tile(np.arange(n + periods) >= n, len(some)))],
                    [*keys, "ds", "y", "yhat", "yhat_lower", "yhat_upper", "trend", "yearly", "weekly", "is_forecast"])


def seasonal_model(series: DataFrame, periods: int = PERIODS, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, ds, y, yhat, yhat_lower, yhat_upper, trend, yearly, weekly, is_forecast) of the
    observed and the future points, 80 % band. A wave the data cannot show is null."""
    _check(periods)
    freq = detect_frequency(series, keys)
    if not keys:
        from gridlore.operators import long_series

        found = freq.first()
        if found["points"] >= long_series.LONG:
            model = long_series.long_seasonal_model(series, periods, found["frequency"])
            return model.withColumns({c: as_double(F.col(c)) for c in ("y", "yearly", "weekly")})
    names = list(keys)
    tagged = _with_frequency(series, freq, keys)
    # Fits cost time, not bytes: a fixed number of partitions keeps AQE from merging
    # small series into a few slow tasks. The grouping below adds no further shuffle.
    if keys:
        tasks = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        tagged = tagged.repartition(tasks, *map(quoted, names))
    point = F.struct(F.col("ds").cast("timestamp_ntz").alias("at"), F.col("y").cast("double").alias("y"))
    whole = tagged.groupBy(*map(quoted, names)).agg(F.first("frequency").alias("__frequency"), F.array_sort(F.collect_list(point)).alias("__points"))
    whole = whole.where(F.size("__points") > 0).select(
        *map(quoted, names), "__frequency", F.col("__points.at").alias("__at"), F.col("__points.y").alias("__y"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in whole.schema.fields[:len(names)])
    schema = (kept + "ds timestamp_ntz, y double, yhat double, yhat_lower double, yhat_upper double, "
              "trend double, yearly double, weekly double, is_forecast boolean")
    out = whole.mapInArrow(lambda b: _modelled(b, names, periods), schema)
    # a missing number comes as NaN; give nulls back
    return out.withColumn("ds", F.col("ds").cast("timestamp")).withColumns({c: as_double(F.col(c)) for c in ("y", "yearly", "weekly")})


def _with_frequency(series, freq, keys):
    if keys:
        return same_keys(series, freq.drop("points"), keys)
    return series.withColumn("frequency", freq.select("frequency").scalar())


def seasonal_forecast(series: DataFrame, periods: int = PERIODS, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, ds, yhat, yhat_lower, yhat_upper) of the future points."""
    return seasonal_model(series, periods, keys).where("is_forecast").select(
        *map(quoted, keys), "ds", "yhat", "yhat_lower", "yhat_upper")


def forecast_components(series: DataFrame, periods: int = PERIODS, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, ds, trend, yearly, weekly, is_forecast)."""
    return seasonal_model(series, periods, keys).select(*map(quoted, keys), "ds", "trend", "yearly", "weekly", "is_forecast")


def method_choice(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, points, frequency, method): seasonal from 14 daily, 4 weekly or 2 monthly points."""
    freq = detect_frequency(series, keys)
    need = F.create_map(*[F.lit(x) for pair in SEASONAL_MINIMUM.items() for x in pair])
    enough = F.col("points") >= need[F.col("frequency")]
    return freq.withColumn("method", F.when(enough, "seasonal").otherwise("linear"))


def forecast(df: DataFrame, date: str, value: str, periods: int = PERIODS, keys: Sequence[str] = (),
             grain: str = "day", agg: str = "first", order_by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Results ``forecast`` (with the method used), ``history``, ``metrics`` (in-sample) and
    ``components``. Series too short for the seasonal model get the straight line."""
    series = prepare_series(df, date, value, keys, grain, agg, order_by)
    chosen = method_choice(series, keys).drop("points", "frequency")
    if keys:
        tagged = same_keys(series, chosen, keys)
    else:
        tagged = series.withColumn("method", chosen.select("method").scalar())
    long, short = (tagged.where(F.col("method") == m).drop("method") for m in ("seasonal", "linear"))
    model = seasonal_model(long, periods, keys)
    shown = [*map(quoted, keys), "ds", "yhat", "yhat_lower", "yhat_upper"]
    ahead = model.where("is_forecast").select(*shown, F.lit("seasonal").alias("method")).unionByName(
        linear_forecast(short, periods, keys).select(*shown, F.lit("linear").alias("method")))
    fitted = model.where("not is_forecast").select(*map(quoted, keys), "ds", "y", "yhat").unionByName(
        linear_fitted(short, keys))
    return {
        "forecast": ahead, "history": forecast_history(series, keys),
        "metrics": forecast_metrics(fitted, keys=keys),
        "components": model.select(*map(quoted, keys), "ds", "trend", "yearly", "weekly", "is_forecast"),
    }
