"""Samples of the isolation forest: from content and copies only, one draw per tree."""

import random

import pytest
from pyspark.sql import functions as F

from gridlore.operators import isolation


@pytest.fixture
def small_samples(monkeypatch):
    monkeypatch.setattr(isolation, "SAMPLE", 16)


def table(spark, n=3000, hot=1000):
    rnd = random.Random(1)
    rows = [(5.0, 5.0)] * hot + [(rnd.gauss(0, 1), rnd.gauss(0, 1)) for _ in range(n - hot - 3)]
    rows += [(60.0, -70.0), (-80.0, 55.0), (90.0, 90.0)]
    return spark.createDataFrame(rows, "a double, b double")


def features(df):
    return df.select(F.col("a").alias("__f0"), F.col("b").alias("__f1"))


@pytest.mark.parametrize("n", [200, 3000])
def test_draws_do_not_depend_on_partitions(spark, small_samples, n):
    df = table(spark, n, n // 3)
    draw = lambda d: sorted(map(tuple, isolation._sample(features(d), ["a", "b"], n, 6, 42, None).collect()))
    first = draw(df.repartition(1))
    assert first == draw(df.repartition(13)) == draw(df.orderBy("b"))
    per_tree = {}
    for tree, ident, a, b in first:
        per_tree.setdefault(tree, set()).add(ident)
    assert len(per_tree) == 6 and all(len(v) == 16 for v in per_tree.values())
    if n == 3000:  # no row is in two samples, and a content with a third of the rows is about a third of each
        assert len(set().union(*per_tree.values())) == 6 * 16
        hot = sum(a == 5.0 for _, _, a, _ in first)
        assert 15 <= hot <= 50


def test_a_key_draws_rows_of_its_own(spark, small_samples):
    df = table(spark).withColumn("id", F.monotonically_increasing_id())
    df = spark.createDataFrame(df.collect(), df.schema)
    rows = df.select("id", F.col("a").alias("__f0"), F.col("b").alias("__f1"))
    draw = lambda d: sorted(map(tuple, isolation._sample(d, ["a", "b"], 3000, 6, 42, ["id"]).collect()))
    first = draw(rows)
    assert first == draw(rows.repartition(9)) and 90 <= len(first) <= 96  # samples of 16 may miss some


def test_scores_are_the_same_under_repartition_and_find_planted_rows(spark, small_samples):
    df = table(spark)
    got = [isolation.isolation_forest(d, trees=20, n=None).orderBy("column", "value").collect()
           for d in (df, df.repartition(11), df.orderBy(F.desc("a")))]
    assert got[0] == got[1] == got[2]
    # no planted row is in a sample this small, so each scores like the outermost rows
    planted = [r.score for r in got[0] if abs(r.value) >= 55]
    assert len(planted) == 3 and min(planted) > 0.55


def test_planted_rows_come_first(spark):
    top = isolation.isolation_forest(table(spark, 400, 100), trees=50, n=3).collect()
    assert {abs(r.value) >= 55 for r in top} == {True}


def test_one_forest_for_list_and_score(spark, monkeypatch):
    from gridlore.operators import fraud

    grown, real = [], isolation.forest_nodes
    monkeypatch.setattr(isolation, "forest_nodes", lambda *a: grown.append(1) or real(*a))
    out = fraud.fraud(table(spark, 300, 50))
    assert out["anomalies"].count() and out["score"].first()["anomalies"] >= out["anomalies"].count()
    assert grown == [1]
