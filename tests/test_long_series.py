"""One long series, lined up and fitted in ranges, against the grouped model and planted truth."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlore.operators import forecast, long_series
from gridlore.plans.position import with_previous

START = datetime(2020, 1, 1)


def series(spark, days, value):
    rows = [(START + timedelta(days=d), float(value(d))) for d in days]
    return spark.createDataFrame(rows, "ds timestamp, y double").repartition(5)


def weekly(d):
    return (100 + 0.1 * d) * (1 + 0.2 * math.sin(2 * math.pi * (d + 18262) / 7.0))


@pytest.mark.parametrize("shape", ["weekly", "two years", "gaps", "flat", "short"])
def test_long_fit_equals_the_grouped_one(spark, monkeypatch, shape):
    rnd = np.random.default_rng(2)
    days, value = {
        "weekly": (range(200), weekly),
        "two years": (range(800), lambda d: weekly(d) + 5 * math.cos(2 * math.pi * d / 365.25) + rnd.normal()),
        "gaps": ([d for d in range(300) if d % 11 and not 100 < d < 140], weekly),
        "flat": (range(40), lambda d: 0.0),
        "short": (range(5), lambda d: d * d)}[shape]
    table = spark.createDataFrame(series(spark, days, value).collect(), "ds timestamp, y double")
    grouped = forecast.seasonal_model(table, 10).orderBy("ds").collect()
    monkeypatch.setattr(long_series, "LONG", 0)
    monkeypatch.setattr(long_series, "FAN_IN", 2)
    long = forecast.seasonal_model(table.repartition(7), 10).orderBy("ds").collect()
    assert len(long) == len(grouped) == len(list(days)) + 10
    for a, b in zip(long, grouped):
        assert (a.ds, a.y, a.is_forecast) == (b.ds, b.y, b.is_forecast)
        for name in ("yhat", "yhat_lower", "yhat_upper", "trend", "yearly", "weekly"):
            assert (a[name] is None) == (b[name] is None)
            if a[name] is not None:
                assert a[name] == pytest.approx(b[name], rel=1e-5, abs=1e-5), name


def test_planted_wave_of_orders_is_found_again(spark, monkeypatch):
    """The days of a given table, with a value made of a line and a weekly wave."""
    monkeypatch.setattr(long_series, "LONG", 100)
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    day = F.unix_date(F.col("o_orderdate").cast("date"))
    wave = (F.lit(1000.0) + day * 0.5) * (1 + 0.1 * F.sin(2 * math.pi * day / 7.0))
    daily = forecast.prepare_series(orders.withColumn("v", wave), "o_orderdate", "v", agg="mean")
    model = forecast.seasonal_model(daily, 30)
    worst = model.where("not is_forecast").agg(F.max(F.abs(F.col("yhat") / F.col("y") - 1))).first()[0]
    assert worst < 1e-3
    ahead = model.where("is_forecast").withColumn("d", F.unix_date(F.col("ds").cast("date"))).withColumn(
        "true", (F.lit(1000.0) + F.col("d") * 0.5) * (1 + 0.1 * F.sin(2 * math.pi * F.col("d") / 7.0)))
    assert ahead.agg(F.max(F.abs(F.col("yhat") / F.col("true") - 1))).first()[0] < 2e-3


def test_a_million_points_use_all_tasks(spark):
    points = spark.range(1_000_000).select(F.timestamp_seconds(F.col("id") * 60).alias("ds"), (F.col("id") * 0.001 + 5).alias("y"))
    model = forecast.seasonal_model(points, 3)
    worst = model.where("not is_forecast").agg(F.count("*"), F.max(F.abs(F.col("yhat") - F.col("y")))).first()
    assert worst[0] == 1_000_000 and worst[1] < 0.01
    assert points.rdd.getNumPartitions() == 8


@pytest.mark.parametrize("n", [0, 1, 2, 500])
def test_positions_and_gaps_over_ranges(spark, n):
    days = [3 * i + (i % 5 == 0) for i in range(n)]
    table = series(spark, days, lambda d: d * 2.0) if n else spark.createDataFrame([], "ds timestamp, y double")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = with_previous(table, "ds").orderBy("ds").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert [r["__pos"] for r in got] == list(range(n))
    assert [r["__previous"] for r in got] == [None, *[r.ds for r in got]][:n]


def test_lines_without_keys_equal_lines_with_one(spark):
    table = series(spark, [d for d in range(90) if d % 7], lambda d: 3 * d + d % 4)
    keyed = table.withColumn("k", F.lit("a"))
    one = forecast.line_fit(table).first().asDict()
    two = forecast.line_fit(keyed, ["k"]).first().asDict()
    two.pop("k")
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) if isinstance(one[k], float) else one[k] == two[k] for k in one)
    a = [r.yhat for r in forecast.linear_fitted(table).orderBy("ds").collect()]
    b = [r.yhat for r in forecast.linear_fitted(keyed, ["k"]).orderBy("ds").collect()]
    assert a == pytest.approx(b)
    assert forecast.detect_frequency(table).first().frequency == "D"


def test_series_of_one_shape_are_fitted_together(monkeypatch):
    """Each series of a stack against least squares of its own; months ahead against the calendar."""
    import pandas as pd
    import pyarrow as pa

    rnd, stacks = np.random.default_rng(4), []
    plain = forecast.fit_stack
    monkeypatch.setattr(forecast, "fit_stack", lambda days, y, parts: stacks.append(len(y)) or plain(days, y, parts))
    day, points = 86_400_000_000, 12
    at = [np.sort(rnd.choice(2500, points, replace=False)).astype(np.int64) * day for _ in range(500)]
    at[0] = np.append(at[0][:-1], np.datetime64("1979-01-31T10:00", "us").astype(np.int64))
    y = [rnd.lognormal(5, 1, points) for _ in at]
    batch = pa.record_batch({"k": list(range(500)), "__frequency": ["M"] * 500, "__at": pa.array([a.astype("M8[us]") for a in at], pa.list_(pa.timestamp("us"))),
                             "__y": pa.array(y)})
    out = pa.Table.from_batches(list(forecast._modelled(iter([batch]), ["k"], 3))).to_pandas()
    assert len(out) == 500 * 15 and sum(stacks) == 500 and len(stacks) <= 2
    ahead = out[(out.k == 0) & out.is_forecast].ds.tolist()
    assert ahead == [pd.Timestamp(1979, 1, 31, 10) + pd.DateOffset(months=i) for i in (1, 2, 3)]

    def ridge(x, goal, penalty):
        return np.linalg.lstsq(np.vstack([x, np.diag(np.sqrt(penalty))]), np.concatenate([goal, np.zeros(len(penalty))]), rcond=None)[0]

    for k in range(5):
        mine = out[out.k == k].sort_values("ds")
        days = mine.ds.to_numpy().astype("M8[us]").astype(np.int64) / day
        span = days[points - 1] - days[0]
        base = forecast._hinges((days - days[0]) / span, forecast._knots(points))
        waves = forecast._waves(days, ["yearly"] if span >= 730 else [])[0]
        goal, season = y[k] / y[k].max(), 0 * days
        for _ in range(4 if waves.size else 1):
            trend = base @ ridge(base[:points] * (1 + season[:points, None]), goal, np.array([1e-8, 1e-8, 0.5, 0.5, 0.5, 0.5]))
            if waves.size:
                season = waves @ ridge(waves[:points] * trend[:points, None], goal - trend[:points], np.full(20, 1e-3))
        assert mine.yhat.to_numpy() == pytest.approx(trend * (1 + season) * y[k].max(), rel=1e-8)
