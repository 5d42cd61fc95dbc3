"""Sums over halves by brackets against sorting, at sizes where every cell counts as many."""

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest

from gridlore.operators import dashboard
from gridlore.plans import halves
from gridlore.plans.halves import column_facts


def plain(rows, order, value):
    """Facts by sorting; nulls first, then by value."""
    cells = sorted(((tuple((r[o] is not None, r[o]) for o in order), float(r[value])) for r in rows if r[value] is not None),
                   key=lambda c: ([(k, v if k else 0) for k, v in c[0]], c[1]))
    v = [c[1] for c in cells]
    half = len(v) // 2
    return len(v), sum(v[:half]) if half else None, sum(v[half:]) if v else None, sum(v[half:2 * half]) if half else None


def check(spark, rows, kind, order, cols=("y", "z")):
    table = spark.createDataFrame(rows, kind)
    names = table.columns
    dicts = [dict(zip(names, r)) for r in rows]
    n, facts = column_facts(table, list(cols), order)
    assert n == len(rows)
    for f in facts:
        want = plain(dicts, order, f["column"])
        got = (f["n"], f["first_sum"], f["rest_sum"], f["second_sum"])
        assert got[0] == want[0]
        assert got[1:] == pytest.approx(want[1:]), f["column"]


@pytest.mark.parametrize("few", [1, 7, 100])
def test_every_kind_of_order(spark, monkeypatch, few):
    monkeypatch.setattr(halves, "FEW", few)
    monkeypatch.setattr(halves, "ACCURACY", 50)
    rnd = random.Random(few)
    pick = lambda *of: rnd.choice(of)
    orders = {
        "at int": lambda i: rnd.randint(-50, 50),
        "at bigint": lambda i: rnd.randint(-2 ** 62, 2 ** 62) >> pick(0, 40),
        "at date": lambda i: date(2024, 1, 1) + timedelta(days=rnd.randint(0, 30)),
        "at timestamp": lambda i: datetime(2024, 1, 1) + timedelta(microseconds=rnd.randint(0, 10 ** 12)),
        "at string": lambda i: pick("", "same", "longer than six") + pick("", "a", "b", "é", "suffix suffix")[:rnd.randint(0, 9)],
        "at decimal(38,4)": lambda i: Decimal(rnd.randint(-10 ** 22, 10 ** 22) // pick(1, 10 ** 20)).scaleb(-4),
        "at double": lambda i: rnd.uniform(-1, 1) * 10 ** rnd.randint(-300, 300),
        "at boolean": lambda i: rnd.random() < 0.5,
    }
    for kind, make in orders.items():
        rows = [(make(i) if rnd.random() < 0.9 else None, rnd.randint(0, 5), float(rnd.randint(0, 9)), pick(None, i / 8)) for i in range(301)]
        check(spark, rows, f"{kind}, k int, y double, z double", ["at", "k"])


def test_hot_places_and_copies(spark, monkeypatch):
    monkeypatch.setattr(halves, "FEW", 5)
    rows = [(1, 1, 2.0, None)] * 400 + [(1, 1, 3.0, 1.0)] * 200 + [(0, 0, 5.0, 7.0)] * 90 + [(2, 0, -1.0, 4.0)] * 101
    random.Random(1).shuffle(rows)
    for order in (["at", "k"], ["k"], ["at"]):
        check(spark, rows, "at int, k int, y double, z double", order)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_short_series(spark, n):
    check(spark, [(i, 0, i + 0.5, None) for i in range(n)], "at int, k int, y double, z double", ["at"])


def test_no_rows_are_shuffled_or_written(spark, monkeypatch):
    """A table far above FEW: the search reads it some times and sorts a few cells only."""
    from pyspark.sql import DataFrame

    seen = []
    for name in ("checkpoint", "localCheckpoint", "repartitionByRange", "repartition"):
        monkeypatch.setattr(DataFrame, name, lambda self, *a, name=name, **k: seen.append(name))
    df = spark.range(1_000_000).selectExpr("id * 7919 % 1000003 AS at", "CAST(id AS DOUBLE) AS y", "id % 10 AS z")
    rows, facts = column_facts(df, ["y", "z"], ["at"])
    assert rows == 1_000_000 and not seen
    assert facts[0]["first_sum"] + facts[0]["rest_sum"] == pytest.approx(facts[0]["total"])


def test_dashboard_shares_one_look(spark, monkeypatch):
    calls = []
    real = dashboard.column_facts
    monkeypatch.setattr(dashboard, "column_facts", lambda *a: calls.append(1) or real(*a))
    df = spark.createDataFrame([(i, float(i), float(-i), "ab"[i % 2]) for i in range(20)], "at int, y double, z double, t string")
    out = dashboard.dashboard(df, ["at"])
    assert calls == [1]
    assert out["kpis"].collect() == dashboard.kpis(df, ["at"]).collect()
    assert out["summary"].collect() == dashboard.dashboard_summary(df, ["at"]).collect()
    assert out["insights"].collect() == dashboard.dashboard_insights(df, ["at"]).collect()
    given = dashboard.dashboard_insights(df, ["at"], 20, metrics=["z", "y", "at"], texts=["t"]).collect()
    assert [r["column"] for r in given if r["code"] == "range"] == ["z", "y", "at"]
