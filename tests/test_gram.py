"""Correlations by Gram matrices against pandas and against plain aggregates."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridlore.operators import profile
from gridlore.plans import gram


def frame_of(spark, x, extra=()):
    names = [f"c{i:03d}" for i in range(x.shape[1])]
    rows = [tuple(None if v != v else float(v) for v in row) for row in x]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)), names


def want(x):
    names = [f"c{i:03d}" for i in range(x.shape[1])]
    r = pd.DataFrame(x, columns=names).corr(min_periods=2)
    return {(a, b): r.loc[a, b] for i, a in enumerate(names) for b in names[i + 1:] if r.loc[a, b] == r.loc[a, b]}


def made(rng, n, k):
    x = rng.normal(size=(n, 3)) @ rng.normal(size=(3, k)) + rng.normal(size=(n, k))
    x[rng.random((n, k)) < 0.2] = np.nan
    x[:, 1] = 7.25  # constant
    x[:, 2] = np.where(rng.random(n) < 0.5, 0.1, np.nan)
    x[:, 3] += 1e9
    x[:, 4] *= 1e-200
    x[:, 5] = np.nan
    return x


def test_wide_table_equals_pandas(spark):
    x = made(np.random.default_rng(1), 3000, 60)
    df, names = frame_of(spark, x)
    got = {(r.col_1, r.col_2): r.correlation for r in profile.correlations(df.repartition(7)).collect()}
    expect = want(x)
    expect = {k: v for k, v in expect.items() if not {"c001", "c002", "c005"} & set(k)}
    assert got.keys() == expect.keys()
    # c003 stands at a billion, so a double holds its deviations to seven digits
    assert all(abs(got[k] - expect[k]) < (1e-7 if "c003" in k else 1e-9) for k in got)


def test_both_ways_agree(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = made(rng, 400, 8)
    df, names = frame_of(spark, x)
    df = df.withColumn("g", F.when(F.col("c000") > 0, "a").when(F.col("c000") < -1, "b"))
    for group in ((), ("g",)):
        few = {tuple(r)[:-1]: r.correlation for r in profile.correlations(df, names, group).collect()}
        few = {k: v for k, v in few.items() if not {"c001", "c002"} & set(k)}  # plain aggregates may find rounding in a constant
        with monkeypatch.context() as m:
            m.setattr(profile, "FEW_COLUMNS", 0)
            m.setattr(gram, "FAN_IN", 1)
            m.setattr(gram, "HELD_GROUPS", 1)
            many = {tuple(r)[:-1]: r.correlation for r in profile.correlations(df, names, group).collect()}
        assert few.keys() == many.keys() and few
        assert all(abs(few[k] - many[k]) < (1e-7 if "c003" in k else 1e-9) for k in few)


def test_moments_merge_in_any_cut():
    rng = np.random.default_rng(3)
    x = made(rng, 200, 9)
    whole = gram.moments(x)
    for cuts in ([1], [100], [3, 60, 61, 199], list(range(1, 200))):
        total = None
        for part in np.split(x, cuts):
            m = gram.moments(part)
            total = m if total is None else gram.added(total, m)
        with np.errstate(invalid="ignore", divide="ignore"):
            a, b = (m[5] / np.sqrt(m[3] * m[4]) for m in (total, whole))
        usual = [0, 3, *range(6, 9)]
        assert np.allclose(a[np.ix_(usual, usual)], b[np.ix_(usual, usual)], atol=1e-9)
        assert (total[0] == whole[0]).all()


def test_endless_values_give_no_pair(spark):
    x = np.random.default_rng(4).normal(size=(50, 20))
    x[3, 0] = np.inf
    x[3, 1] = np.nan
    df, names = frame_of(spark, x)
    got = {(r.col_1, r.col_2) for r in profile.correlations(df).collect()}
    assert ("c000", "c001") in got  # the endless value stands beside a missing one
    assert not any("c000" in k and "c001" not in k for k in got)


def test_plan_does_not_grow_with_the_pairs(spark):
    def lines(k):
        df = spark.range(10).select(*[(F.col("id") * i).cast("double").alias(f"c{i}") for i in range(k)])
        out = profile.correlations(df)
        return len(out._jdf.queryExecution().optimizedPlan().toString().split("\n")), len(out._jdf.queryExecution().optimizedPlan().toString())

    few, many = lines(20), lines(200)
    assert many[0] == few[0] and many[1] < 40 * few[1]


@pytest.mark.parametrize("rows", [0, 1, 2])
def test_hardly_any_rows(spark, rows):
    x = np.random.default_rng(5).normal(size=(rows, 15))
    if rows == 0:
        df = spark.createDataFrame([], ", ".join(f"c{i} double" for i in range(15)))
    else:
        df, _ = frame_of(spark, x)
    got = profile.correlations(df).collect()
    assert len(got) == (105 if rows == 2 else 0) and all(abs(abs(r.correlation) - 1) < 1e-9 for r in got)
