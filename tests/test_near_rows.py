"""Near-duplicate rows against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from gridlore.operators.near_rows import near_duplicate_rows

KIND = "id long, name string, city string, amount double, n int"


def plain(rows, changes=1):
    clean = lambda v: " ".join(v.split()).lower() if isinstance(v, str) else v
    cells = {r[0]: tuple(map(clean, r[1:])) for r in rows}
    label = {i: i for i in cells}
    links = [(a, b) for a in cells for b in cells if a < b and sum(x != y for x, y in zip(cells[a], cells[b])) <= changes]
    for _ in cells:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    linked = {x for pair in links for x in pair}
    size = {}
    for i in linked:
        size[label[i]] = size.get(label[i], 0) + 1
    return sorted((i, label[i], size[label[i]]) for i in linked)


@pytest.mark.parametrize("changes", [1, 2])
def test_equal_to_all_pairs(spark, changes):
    rnd = random.Random(changes)
    make = lambda: (rnd.choice(["Ann", "ann ", "Bob", "A  b", "a b", None]), rnd.choice("pqrstu"), rnd.choice([1.0, 2.5, None]), rnd.randint(0, 30))
    rows = [(i, *make()) for i in range(70)]
    df = spark.createDataFrame(rows, KIND)
    got = sorted(map(tuple, near_duplicate_rows(df, "id", max_changes=changes).collect()))
    assert got == plain(rows, changes) and got


def test_planted_changes_are_found_and_others_left(spark):
    rows = [(i, f"name {i}", f"city {i * 7}", i * 1.5, i) for i in range(500)]
    rows += [(1000, "NAME  3", "city 21", 4.5, 99), (1001, "name 3", "elsewhere", 4.5, 3), (1002, "name 9", "city 63", 13.5, 9)]
    got = sorted(map(tuple, near_duplicate_rows(spark.createDataFrame(rows, KIND), "id").collect()))
    assert got == [(3, 3, 3), (9, 9, 2), (1000, 3, 3), (1001, 3, 3), (1002, 9, 2)]


def test_a_third_of_all_rows_under_one_key(spark):
    df = spark.range(30_000).selectExpr(
        "id", "IF(id % 3 = 0, 'same', concat('n', id)) AS name", "IF(id % 3 = 0, 'same', concat('c', id)) AS city",
        "CAST(id AS DOUBLE) AS amount", "IF(id % 3 = 0, 1, CAST(id AS INT)) AS n")
    got = near_duplicate_rows(df, "id").groupBy("class_id").agg(F.count("*").alias("k"), F.max("members").alias("m")).collect()
    assert [tuple(r) for r in got] == [(0, 10_000, 10_000)]


def test_chains_long_and_short(spark):
    """Each row changes one cell of the row before, so all are one class though the ends share nothing."""
    rows, cells = [], [0, 0, 0, 0]
    for i in range(60):
        cells[i % 4] += 1
        rows.append((i, f"a{cells[0]}", f"b{cells[1]}", float(cells[2]), cells[3]))
    got = near_duplicate_rows(spark.createDataFrame(rows, KIND), "id").collect()
    assert len(got) == 60 and {r.class_id for r in got} == {0}


def test_edges(spark):
    empty = spark.createDataFrame([], KIND)
    assert near_duplicate_rows(empty, "id").count() == 0
    nulls = spark.createDataFrame([(1, None, None, None, None), (2, None, None, float("nan"), None), (None, "a", "b", 1.0, 1)], KIND)
    assert sorted(map(tuple, near_duplicate_rows(nulls, "id").collect())) == [(1, 1, 2), (2, 1, 2)]
    with pytest.raises(ValueError):
        near_duplicate_rows(empty, "id", ["name", "city"])
