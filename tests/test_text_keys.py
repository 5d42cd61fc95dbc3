"""Counting long texts by short keys."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridlore.operators import profile, quality
from gridlore.plans.shape import KEY_BYTES, text_key


@pytest.fixture
def texts(spark):
    rnd = random.Random(3)
    same = "the very same beginning of all of these texts, whatever follows: "
    pool = [same + str(i) * 20 for i in range(40)] + ["short", "", "é" * 24, "é" * 25, "x" * KEY_BYTES, "x" * (KEY_BYTES + 1)]
    rows = [(rnd.choice(pool), rnd.choice(["a", "b", None])) for _ in range(600)] + [(None, "a")] * 5
    return rows, spark.createDataFrame(rows, "t string, u string")


def plain_top(values, k):
    return sorted(Counter(v for v in values if v is not None).items(), key=lambda p: (-p[1], p[0].encode()))[:k]


@pytest.mark.parametrize("k", [1, 3, 10, 100])
def test_top_values(texts, k):
    rows, df = texts
    got = {(r.column, r["rank"]): (r.value, r["count"]) for r in profile.top_values(df, ["t", "u"], k).collect()}
    want = {("t", i + 1): p for i, p in enumerate(plain_top([r[0] for r in rows], k))}
    want |= {("u", i + 1): p for i, p in enumerate(plain_top([r[1] for r in rows], k))}
    assert got == want


def test_many_single_texts_tie_by_name(spark):
    base = "a common start that is longer than the characters of a key "
    df = spark.createDataFrame([(base + f"{i:04d}",) for i in range(500)], "t string")
    assert [r.value for r in profile.top_values(df, ["t"], 3).orderBy("rank").collect()] == [base + f"{i:04d}" for i in range(3)]


def test_distinct_and_duplicates(texts):
    rows, df = texts
    stats = {r.column: r.distinct for r in quality.distinct_per_column(df, ["t", "u"]).collect()}
    assert stats == {"t": len({r[0] for r in rows} - {None}), "u": 2}
    issue = quality.check_duplicates(df).first()
    assert issue.value == len(rows) - len(set(rows))


def test_statistics_name_the_most_frequent_text(texts):
    rows, df = texts
    top = {r.column: (r.top, r.top_freq, r.unique) for r in profile.table_statistics(df).collect()}
    for i, c in enumerate("tu"):
        want = plain_top([r[i] for r in rows], 1)[0]
        assert top[c] == (*want, len({r[i] for r in rows} - {None}))


def test_no_long_text_in_a_shuffle(spark):
    df = spark.createDataFrame([("x" * 5000 + str(i),) for i in range(50)], "t string")
    for out in (quality.distinct_per_column(df, ["t"]), quality.check_duplicates(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "md5" in plan
        before = plan[plan.rindex("Exchange"):]
        assert "md5" in before  # keys are made before the exchange


def test_keys_of_different_texts_differ(spark):
    short = ["x" * 32 + "0" * 16, "x" * 32 + "d41d8cd98f00b204e9800998ecf8427e"]
    df = spark.createDataFrame([(t,) for t in (*short, "x" * 33 + "y" * 40, "x" * 33 + "z" * 40)], "t string")
    assert df.select(text_key(F.col("t"))).distinct().count() == 4
