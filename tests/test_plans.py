"""Quantiles, positions and shapes: exactness and the plans behind them."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from gridlore.plans import quantiles as qmod
from gridlore.plans.position import (
    in_chunks, position_trend, running_total, with_position,
)
from gridlore.plans.quantiles import column_quantiles, quantiles
from gridlore.plans.shape import column_rows, measured_join, same_keys, top_per, value_counts
from gridlore.plans import shape

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def check(spark, values, probs=PROBS):
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)
    got = column_quantiles(df, ["v"], probs).first()
    want = np.quantile(np.array(values, float), probs)
    assert got["n"] == len(values)
    for i, w in enumerate(want):
        assert got[f"q{i}"] == pytest.approx(w, rel=1e-12, abs=1e-12)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=250))
def test_quantiles_small(spark, values):
    check(spark, values)


@pytest.mark.parametrize("n", [199, 200, 5000, 19999, 20000, 60000])
def test_quantiles_across_bracket_sizes(spark, n):
    rng = np.random.default_rng(n)
    check(spark, np.round(rng.lognormal(3, 2, n), 3).tolist())


def test_quantiles_hot_value_holds_a_third(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([np.full(20000, 7.5), rng.normal(7.5, 3, 40000)])
    check(spark, values.tolist())


def test_quantiles_extreme_spread(spark):
    check(spark, [-1e308, 1e308, 0.0, 1e-300, 5.0] * 50)


def test_quantiles_groups_with_null_key(spark):
    rows = [("a", float(i)) for i in range(10)] + [(None, 2.0), (None, 4.0), ("b", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["n"], r["q0"]) for r in quantiles(df, ["k"], "v", [0.5]).collect()}
    assert got == {"a": (10, 4.5), None: (2, 3.0)}


def test_quantiles_groups_beyond_the_broadcast_limit(spark, monkeypatch):
    monkeypatch.setattr(shape, "BROADCAST_ROWS", 3)
    rows = [(i % 40, float((i * 7919) % 1000)) for i in range(4000)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r["k"]: r["q0"] for r in quantiles(df, ["k"], "v", [0.25]).collect()}
    want = pd.DataFrame(rows, columns=["k", "v"]).groupby("k")["v"].quantile(0.25).to_dict()
    assert got == pytest.approx(want)


def test_quantiles_need_ascending_probs(spark):
    with pytest.raises(ValueError):
        quantiles(spark.range(3).withColumn("k", F.lit(1)), ["k"], "id", [0.5, 0.1])


def test_approximate_quantiles(spark):
    df = spark.range(1, 1001).select(F.col("id").cast("double").alias("v"))
    assert abs(column_quantiles(df, ["v"], [0.5], accuracy=1000).first()["q0"] - 500) <= 1


def test_with_position_matches_sort(spark):
    random.seed(3)
    rows = [(random.randint(0, 50), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "d int, id int").repartition(7)
    got = {r["id"]: r["row_no"] for r in with_position(df, ["d", "id"]).collect()}
    assert got == {i: p for p, (_, i) in enumerate(sorted(rows))}


@pytest.mark.parametrize("ties", [False, True])
def test_position_trend(spark, ties):
    rng = np.random.default_rng(5)
    y = np.round(np.linspace(0, 30, 3000) + rng.normal(0, 3, 3000), 2)
    rows = [(i % 2, i, float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "k int, at int, y double").repartition(9)
    got = {r["k"]: r for r in position_trend(df, ["k"], ["at"], "y", ties=ties).collect()}
    for k in (0, 1):
        part = y[k::2]
        slope = np.polyfit(np.arange(len(part)), part, 1)[0]
        assert got[k]["n"] == len(part)
        assert got[k]["slope"] == pytest.approx(slope, rel=1e-9)
        assert got[k]["mean"] == pytest.approx(part.mean())


def test_position_trend_with_copies_of_one_row(spark):
    rows = [(1, 5.0)] * 2000 + [(i, float(i % 11)) for i in range(2, 2000)]
    df = spark.createDataFrame(rows, "at int, y double").withColumn("k", F.lit(0))
    got = position_trend(df, ["k"], ["at", "y"], "y", ties=True).first()
    y = np.array([v for _, v in sorted(rows)])
    assert got["slope"] == pytest.approx(np.polyfit(np.arange(len(y)), y, 1)[0], rel=1e-9)
    assert got["n"] == len(rows)


def test_position_trend_uses_one_shuffle_of_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").withColumn("k", F.col("o_orderstatus"))
    plan = position_trend(df, ["k"], ["o_orderdate", "o_orderkey"], "o_totalprice")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("rangepartitioning") == 1
    assert "SinglePartition" not in text


def test_running_total(spark):
    rows = [(i, float((i * 37) % 101)) for i in range(999)]
    df = spark.createDataFrame(rows, "id int, v double").repartition(6)
    got = running_total(df, [F.desc("v"), F.col("id").asc()], "v").orderBy(F.desc("v"), "id").collect()
    want = np.cumsum([v for v, _ in sorted(((v, -i) for i, v in rows), reverse=True)])
    assert [r["running"] for r in got] == pytest.approx(want.tolist())


def test_chunks_repeat_the_tail(spark):
    out = in_chunks(spark.range(25).withColumnRenamed("id", "p"), "p", halo=3, chunk=10).collect()
    assert sum(r["__own"] for r in out) == 25
    assert sorted(r["p"] for r in out if not r["__own"]) == [7, 8, 9, 17, 18, 19]


def test_column_rows_is_one_aggregate(spark):
    df = spark.range(10).select(*[F.col("id").alias(f"c{i}") for i in range(20)])
    out = column_rows(df, df.columns, {"n": F.count, "top": F.max})
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1
    assert {(r["column"], r["n"], r["top"]) for r in out.collect()} == {(f"c{i}", 10, 9) for i in range(20)}


def test_top_per_breaks_ties_and_limits_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", i % 3) for i in range(30)], "c string, v int")
    counts = value_counts(df, ["c", "v"])
    best = top_per(counts, ["column"], [F.desc("n"), F.col("value")], 2)
    got = sorted((r["column"], r["value"], r["n"]) for r in best.collect())
    assert got == [("c", "a", 30), ("v", "0", 10), ("v", "1", 10)]
    assert "WindowGroupLimit" in best._jdf.queryExecution().executedPlan().toString()


def test_measured_join_both_ways(spark, monkeypatch):
    left = spark.range(100).select((F.col("id") % 5).alias("k"), "id")
    right = spark.createDataFrame([(i, i * 10) for i in range(5)], "k long, w int")
    few = measured_join(left, right, ["k"])
    assert "Broadcast" in few._jdf.queryExecution().optimizedPlan().toString() or "broadcast" in few._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(shape, "BROADCAST_ROWS", 2)
    many = measured_join(left, right, ["k"])
    assert "broadcast" not in many._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_bracket_constants_leave_room():
    # a bracket must reach beyond the sketch's own error by at least two ranks
    n = 2 * qmod.SKETCH_ACCURACY
    assert (2.0 / qmod.SKETCH_ACCURACY - 1.0 / qmod.SKETCH_ACCURACY) * n >= 2
    assert (0.02 - 1.0 / qmod.SKETCH_ACCURACY) * 200 >= 2


def test_same_keys_matches_null(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k string, w int")
    assert sorted(r["w"] for r in same_keys(a, b, ["k"]).collect()) == [10, 20]
