"""Hand-computed tables, one per rule and edge."""

import math
import time
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridlore.functions.schema import detect_roles, has_keyword, unique_names
from gridlore.operators import (
    audit, dashboard, finance, forecast, fraud, insights, inventory, isolation, people, profile,
    quality, regression, risk, sales, tables,
)
from gridlore.operators.product_pairs import cross_sell_pairs
from gridlore.sources import history, jdbc, tables as src

DEMO = [
    ("2024-01-05", "Laptop ThinkPad", "Elektronik", 5, 15000000, 75000000, "Jakarta"),
    ("2024-01-12", "Mouse Wireless", "Aksesoris", 20, 250000, 5000000, "Bandung"),
    ("2024-02-03", "Monitor 24inch", "Elektronik", 8, 3500000, 28000000, "Surabaya"),
    ("2024-03-22", "Monitor 24inch", "Elektronik", 6, 3500000, 21000000, "Jakarta"),
]
DEMO_HEADERS = ["Tanggal", "Produk", "Kategori", "Jumlah", "Harga", "Total", "Wilayah"]


# ---- typing and sources


def test_from_rows_types_the_demo_sheet(spark):
    df = src.from_rows(spark, DEMO_HEADERS, DEMO)
    kinds = dict(df.dtypes)
    assert kinds["Tanggal"] == "timestamp" and kinds["Total"] == "bigint" and kinds["Produk"] == "string"


@pytest.mark.parametrize("good,kind", [(5, "bigint"), (4, "string")])
def test_half_of_the_rows_must_parse(spark, good, kind):
    rows = [(str(i),) for i in range(good)] + [("x",)] * (10 - good)
    assert src.coerce_types(spark.createDataFrame(rows, "a string")).dtypes == [("a", kind)]


def test_mostly_null_column_stays_text(spark):
    rows = [("7", "1")] + [(None, "2")] * 19
    df = src.coerce_types(spark.createDataFrame(rows, "a string, b string"))
    assert df.dtypes == [("a", "string"), ("b", "bigint")]


def test_whole_numbers_keep_their_digits(spark):
    rows = [("9007199254740996", "1", "9"), ("9007199254740997", "2.5", "99999999999999999999"), (" +7 ", None, "1")]
    df = src.coerce_types(spark.createDataFrame(rows, "a string, b string, c string"))
    assert df.dtypes == [("a", "bigint"), ("b", "double"), ("c", "double")]
    assert [r["a"] for r in df.collect()] == [9007199254740996, 9007199254740997, 7]


def test_usual_dates(spark):
    rows = [("05/01/2024", "05/01/2024", "31.12.2023 7:05", "2024-01"), ("12/31/2023", "31/12/2023", "1.2.2024", "x|2")]
    df = src.from_rows(spark, ["m", "d", "p", "f"], rows, formats=("yyyy-MM",))
    assert dict(df.dtypes)["f"] == "timestamp"
    got = [[str(v) for v in r] for r in df.select("m", "d", "p").collect()]
    assert got == [["2024-05-01 00:00:00", "2024-01-05 00:00:00", "2023-12-31 07:05:00"],
                   ["2023-12-31 00:00:00", "2023-12-31 00:00:00", "2024-02-01 00:00:00"]]


@pytest.mark.parametrize("fmt", ["csv", "json", "orc", "parquet"])
def test_row_numbers_by_file_and_row(spark, tmp_path, fmt):
    at = 0
    for name, n in (("a", 3), ("b", 2000), ("c", 500)):
        spark.range(at, at + n, 1, 1).write.format(fmt).option("header", fmt == "csv").save(f"{tmp_path}/t/f={name}")
        at += n
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        df = src.read_table(spark, f"{tmp_path}/t", fmt, row_no=True)
        assert "row_no" in df.columns and all(int(r["id"]) == r["row_no"] for r in df.collect())
        assert df.count() == at and "__shift" not in df.columns
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_number_text_rules(spark):
    cells = ["7", " 7 ", "1e3", "-.5", "1,234", "1d", "NaN", "", None, "+2."]
    df = spark.createDataFrame([(c,) for c in cells], "a string")
    got = [r[0] for r in df.select(tables.number_from_text(F.col("a"))).collect()]
    assert got == [7.0, 7.0, 1000.0, -0.5, None, None, None, None, None, 2.0]


def test_header_names():
    assert unique_names(["a", "a", "a_1", None]) == ["a", "a_2", "a_1", "Column_3"]


def test_rows_of_wrong_length(spark):
    raw = src.raw_rows(spark, [[1], [1, 2], [1, 2, 3], [4, 5]])
    got = audit.inconsistent_columns("s", raw, "cells", 2, "row_no").collect()
    assert [(r["row_from"], r["n"]) for r in got] == [(1, 1), (3, 3)]
    with pytest.raises(ValueError):
        src.from_rows(spark, ["a"], [[1, 2]])
    assert src.from_rows(spark, ["a", "b"], [[1]]).count() == 1


def test_csv_with_quotes_and_row_numbers(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('name, amount\n"a, b", 1\nc, 2\nd, x\n')
    df = src.read_table(spark, str(path), "csv", row_no=True).orderBy("row_no")
    assert [tuple(r) for r in df.select("row_no", "name", "amount").collect()] == [
        (0, "a, b", 1.0), (1, "c", 2.0), (2, "d", None)]


def test_history_pages(spark, tmp_path):
    path = str(tmp_path / "h")
    ids = [history.save_result(spark.range(i + 1), path, f"s{i}", "k" if i else "other") for i in range(3)]
    newest = history.read_history(spark, path, limit=1)
    assert {r["id"] for r in newest.collect()} == {ids[2]} and newest.count() == 3
    assert {r["sheet_name"] for r in history.read_history(spark, path, "k").collect()} == {"s1", "s2"}
    with pytest.raises(ValueError):
        history.read_history(spark, path, limit=101)


def test_load_saved(spark):
    assert src.load_saved(spark, "no_such_table") is None
    spark.range(2).createOrReplaceTempView("kept")
    assert src.load_saved(spark, "kept").count() == 2


def test_write_table_drops_nan(spark, tmp_path):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),)], "a double")
    src.write_table(df, str(tmp_path / "p"))
    assert src.read_table(spark, str(tmp_path / "p")).where("a is null").count() == 2


@pytest.mark.parametrize("url,expected", [
    ("jdbc:postgresql://h/d", 'SELECT * FROM "s"."t" LIMIT 50'),
    ("jdbc:mysql://h/d", "SELECT * FROM `s`.`t` LIMIT 50"),
    ("jdbc:sqlserver://h", "SELECT TOP 50 * FROM [s].[t]"),
    ("jdbc:oracle:thin:@h", 'SELECT * FROM "s"."t" FETCH FIRST 50 ROWS ONLY')])
def test_jdbc_preview_text(url, expected):
    assert jdbc.preview_query(url, "s.t") == expected


def test_jdbc_options():
    url = "jdbc:postgresql://h/d"
    assert jdbc.read_options(url, "SELECT 1;")["query"] == "SELECT 1"
    split = jdbc.read_options(url, table="t", partition={"column": "id", "lower": 0, "upper": 9, "parts": 4})
    assert split["dbtable"] == '"t"' and split["numPartitions"] == "4"
    for bad in ({"query": "DELETE FROM t"}, {"query": "SELECT 1", "table": "t"}, {"table": 't"; DROP'}):
        with pytest.raises(ValueError):
            jdbc.read_options(url, **bad)
    assert "public" in jdbc.tables_query(url) and "PRIMARY KEY" in jdbc.columns_query(url, "s.t")


def test_sql_views_do_not_leak(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "name string, v int")
    assert tables.sql(df, 'SELECT SUM("v") AS s FROM data').first()["s"] == 3
    assert tables.sql(df.limit(0), "SELECT COUNT(*) AS n FROM data").first()["n"] == 0
    assert not spark.catalog.tableExists("data")
    with pytest.raises(ValueError):
        tables.sql(df, "DROP TABLE x")


# ---- roles


def test_roles_match_whole_words_and_longest_first(spark):
    df = spark.createDataFrame([], "total_note string, `Cost of Goods Sold` double, current_asset double, asset double, "
                                   "operatingExpense double, width double")
    found = detect_roles(df, "finance")
    assert found == {"cogs": "Cost of Goods Sold", "current_asset": "current_asset", "asset": "asset",
                     "expense": "operatingExpense"}
    assert not has_keyword("total", "ot") and not has_keyword("width", "id")


def test_role_override_wins(spark):
    df = src.from_rows(spark, DEMO_HEADERS, DEMO)
    found = detect_roles(df, "sales", {"revenue": "Total"})
    assert found["revenue"] == "Total" and found["quantity"] == "Jumlah" and found["product"] == "Produk"
    with pytest.raises(ValueError):
        detect_roles(df, "sales", {"revenue": "nope"})


def test_sales_on_the_demo_sheet(spark, rows):
    out = sales.sales(src.from_rows(spark, DEMO_HEADERS, DEMO), {"revenue": "Total"})
    assert rows(out["sales_totals"]) == [(129000000.0, 4)]
    assert out["product_performance"].first()["product"] == "Laptop ThinkPad"
    assert "top_customers" not in out


# ---- quality and audit


def test_error_tokens_are_literal(frame, rows):
    df = frame([(t,) for t in (*quality.ERROR_TOKENS, "#NAM", "fine")], "a string")
    got = rows(quality.check_error_tokens(df), "metric", "value")
    assert got == sorted((t, 1.0) for t in quality.ERROR_TOKENS)


@pytest.mark.parametrize("n,found", [(9, 0), (10, 1)])
def test_outliers_need_ten_values(frame, n, found):
    df = frame([(float(i),) for i in range(n - 1)] + [(1000.0,)], "a double")
    assert quality.check_outliers_iqr(df).count() == found


def test_outliers_skip_a_flat_column(frame):
    df = frame([(1.0,)] * 20 + [(50.0,)], "a double")
    assert quality.check_outliers_iqr(df).count() == 0


def test_remove_outliers_drops_null_rows(frame, rows):
    df = frame([(float(i), 1.0) for i in range(20)] + [(None, 1.0), (500.0, 1.0)], "a double, b double")
    assert quality.remove_outliers_iqr(df).count() == 20


def test_mode_takes_the_smallest_tie(frame, rows):
    df = frame([("b", 2), ("b", 2), ("a", 1), ("a", 1), (None, None)], "a string, b int")
    filled = quality.fill_missing_mode(df)
    assert ("a", 1) in rows(filled) and filled.where("a is null").count() == 0


def test_strip_keeps_null(frame, rows):
    df = frame([("\t x \n",), (None,)], "a string")
    assert rows(quality.strip_whitespace(df)) == [("x",), (None,)]


def test_clean_is_idempotent(frame, rows):
    df = frame([("a ", 1.0, None), ("a ", 1.0, None), ("b", None, "z"), ("b", 4.0, None)], "t string, v double, s string")
    fixes = ["remove_duplicates", "fill_missing_median", "drop_missing_high", "strip_whitespace"]
    once = quality.clean(df, fixes)
    assert rows(quality.clean(once, fixes)) == rows(once)
    with pytest.raises(ValueError):
        quality.clean(df, ["polish"])


def test_checks_on_an_empty_table(frame):
    df = frame([], "a double, b string, c timestamp")
    report = quality.quality_report(df).collect()
    assert {r["type"] for r in report} == {"constant_column"}
    assert insights.trends(df, ["c"]).count() == 0
    assert insights.anomalies_zscore(df).count() == 0
    assert profile.numeric_summary(df).first()["count"] == 0


def test_gaps_between_filled_cells(frame, rows):
    filled = {0, 2, 22, 43, 44}
    df = frame([(i, "x" if i in filled else None, None) for i in range(45)], "row_no long, a string, b string")
    want = [(1, 3, 1), (3, 23, 19)]
    for chunk in (1_000_000, 25, 21):
        got = audit.merged_cell_gaps("s", df, "row_no", chunk=chunk)
        assert rows(got, "row_from", "row_to", "n") == want, chunk


def test_header_lint(spark, rows):
    df = spark.createDataFrame([("t", i, n) for i, n in enumerate(["", None, "a b", "x#", "1a", "ok_1"])],
                               "table string, ordinal long, name string")
    got = {(r["n"], r["category"]) for r in audit.header_lint(df).collect()}
    assert got == {(0, "empty_header"), (1, "empty_header"), (2, "header_special_chars"), (3, "header_special_chars"),
                   (4, "header_starts_with_digit")}


def test_audit_sorts_by_severity(spark, frame):
    df = frame([(-1.0, None, "#N/A", 0), (2.0, None, "x", 1)], "amount double, gone string, note string, row_no long")
    found = audit.audit(spark, {"t": df, "none": df.limit(0)}).collect()
    ranks = [{"high": 0, "medium": 1, "low": 2}[r["severity"]] for r in found]
    assert ranks == sorted(ranks)
    assert {r["category"] for r in found} >= {"empty_sheet", "suspicious_text:not_available", "empty_column", "unexpected_negative"}
    assert audit.audit(spark, {}).first()["category"] == "empty_workbook"


# ---- profiling, insights, dashboard


def test_skew_and_kurtosis_are_bias_corrected(frame):
    values = [1.0, 2.0, 2.5, 9.0, 4.0, 30.0]
    got = profile._describe(frame([(v,) for v in values], "a double"), ["a"]).first()
    s = pd.Series(values)
    assert got["skew"] == pytest.approx(s.skew(), abs=1e-4) and got["kurtosis"] == pytest.approx(s.kurtosis(), abs=1e-4)


def test_correlation_of_a_flat_column_drops_out(frame):
    df = frame([(1.0, 2.0, float(i)) for i in range(5)], "a double, b double, c double")
    assert profile.correlations(df).count() == 0


def test_boolean_like_columns(frame):
    df = frame([("Yes", 1, "x"), ("no", 0, "y"), ("Yes", 1, None)], "a string, b int, c string")
    got = {r["column"]: r["label"] for r in tables.detect_column_types(df).collect()}
    assert got == {"a": "boolean", "b": "boolean", "c": "text"}


def test_trend_uses_the_absolute_mean(frame, rows):
    df = frame([(i, -100.0 + 5 * i) for i in range(6)], "at int, y double")
    got = rows(insights.trends(df, ["at"], ["y"]))
    assert got[0][1] == "up" and got[0][2] > 0


def test_halves_of_an_odd_series(frame):
    df = frame([(i, v) for i, v in enumerate([1.0, 3.0, 4.0, 8.0, 100.0])], "at int, y double")
    h = dashboard.halves(df, ["y"], ["at"]).first()
    assert (h["first_mean"], h["second_mean"], h["first_sum"], h["rest_sum"]) == (2.0, 6.0, 4.0, 112.0)
    short = dashboard.kpis(df.where("at < 3"), ["at"], ["y"]).first()
    assert short["change_pct"] == 0.0


# ---- fraud


def test_timing_edges(frame):
    base = datetime(2024, 1, 3)  # a Wednesday
    at = [base.replace(hour=21, minute=59), base.replace(hour=22), base.replace(hour=4, minute=59), base.replace(hour=5),
          datetime(2024, 1, 6, 12), datetime(2024, 1, 7, 12)]
    got = fraud.timing_patterns(frame([(t,) for t in at], "at timestamp")).first()
    assert (got["weekend"], got["night"], got["count"]) == (2, 2, 4)
    same_time = frame([(datetime(2024, 1, d),) for d in range(1, 8)], "at timestamp")
    assert fraud.timing_patterns(same_time).first()["night"] == 0


@pytest.mark.parametrize("n,rows_found", [(49, 0), (50, 9)])
def test_benford_needs_fifty_values(frame, n, rows_found):
    df = frame([(0.001 * (i + 1),) for i in range(n)] + [(-5.0,), (0.0,)], "a double")
    assert fraud.benford(df).count() == rows_found


def test_benford_on_small_numbers(frame):
    df = frame([(1.5e-5,)] * 60, "a double")
    first = {r["digit"]: r["n"] for r in fraud.benford(df).collect()}
    assert first["1"] == 60 and first["9"] == 0


def test_forest_finds_the_odd_row(spark):
    rows = [(i, float(i % 10), float(i % 7)) for i in range(600)] + [(999, 500.0, -300.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    found = isolation.isolation_forest(df, ["a", "b"], ["id"], key=["id"])
    first = found.first()
    assert first["id"] == 999 and first["severity"] == "high" and first["column"] in ("a", "b")
    again = isolation.isolation_forest(df.repartition(7), ["a", "b"], ["id"], key=["id"])
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in again.collect()]


def test_forest_on_four_rows_uses_z_scores(frame):
    df = frame([(1.0,), (1.0,), (1.0,), (9.0,)], "a double")
    assert isolation.isolation_forest(df).columns == ["column", "value", "score", "severity"]
    assert isolation.score_rows(df.limit(4)) is None


def test_forest_with_nulls_and_copies(spark):
    rows = [(1.0, None)] * 400 + [(float(i), float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double")
    scored = isolation.score_rows(df)
    assert scored.count() == 600 and scored.where("score is null or score > 1").count() == 0


def test_average_path():
    assert isolation.average_path([0, 1, 2]).tolist() == [0.0, 0.0, 1.0]
    assert isolation.average_path(256) == pytest.approx(10.2448, abs=1e-3)


# ---- scores


def test_risk_of_a_calm_table_is_low(frame):
    df = frame([(100.0 + i % 2, f"n{i}") for i in range(20)], "v double, t string")
    out = risk.risk(df)["score"].first()
    assert out["risk_level"] == "low"


def test_risk_per_group_equals_risk_alone(frame, rows):
    data = [(g, datetime(2024, 1, 1) + timedelta(days=i), float(100 - 3 * i * g + i % 5), "x" if i % 3 else "y") for g in (1, 2) for i in range(25)]
    df = frame(data, "g int, d timestamp, v double, t string")
    by_group = {r["g"]: r["overall_score"] for r in risk.risk(df, ["g"])["score"].collect()}
    for g in (1, 2):
        alone = risk.risk(df.where(F.col("g") == g).drop("g"))["score"].first()["overall_score"]
        assert by_group[g] == pytest.approx(alone, abs=0.01)


def test_latest_value_skips_nulls(frame):
    df = frame([(1, 10.0, 5.0), (2, 20.0, None), (3, None, None)], "year int, revenue double, profit double")
    got = finance.latest_values(df).first()
    assert (got["revenue"], got["profit"], got["asset"]) == (20.0, 5.0, None)


def test_health_score_of_a_sound_firm(frame):
    df = frame([(1, 100.0, 20.0, 10.0), (2, 200.0, 80.0, 60.0)], "year int, revenue double, cogs double, profit double")
    out = finance.financial_health(df)
    assert out["score"].first()["health_score"] == 90.0  # 50 + gross, net, revenue growth, profit growth
    names = {r["name"] for r in out["metrics"].collect()}
    assert names == {"gross_margin", "net_margin", "revenue_growth", "profit_growth"}


def test_profit_growth_from_zero(frame):
    df = frame([(1, 0.0), (2, 5.0)], "year int, profit double")
    got = finance.growth_metrics(df).collect()
    assert [(r["name"], r["value"]) for r in got] == [("profit_growth", 100.0)]


# ---- sales, inventory, people


def test_segments_need_two_customers(frame):
    one = frame([("a", 5.0), ("a", 6.0)], "customer string, revenue double")
    assert sales.customer_segments(one).count() == 0
    two = frame([("a", 5.0), ("b", 95.0)], "customer string, revenue double")
    got = {r["segment"]: r["customers"] for r in sales.customer_segments(two).collect()}
    assert got == {"high": 0, "medium": 1, "low": 1}


@pytest.mark.parametrize("days,grain", [(35, "day"), (36, "week"), (180, "week"), (181, "month")])
def test_trend_grain(frame, days, grain):
    start = datetime(2024, 1, 1)
    df = frame([(start, 1.0), (start + timedelta(days=days), 2.0)], "date timestamp, revenue double")
    assert {r["grain"] for r in sales.sales_trend(df).collect()} == {grain}


def _brute_pairs(data, n):
    from collections import Counter, defaultdict
    from itertools import combinations

    held = defaultdict(set)
    for c, p in data:
        held[c].add(p)
    counts = Counter(pair for items in held.values() for pair in combinations(sorted(items), 2))
    return sorted(((a, b, k) for (a, b), k in counts.items()), key=lambda r: (-r[2], r[0], r[1]))[:n]


@pytest.mark.parametrize("widely", [3, 8, 64])
def test_pairs_match_brute_force(spark, widely):
    import random

    random.seed(widely)
    data = [(f"c{random.randint(0, 60)}", f"p{min(random.randint(0, 40), random.randint(0, 40)):02d}") for _ in range(900)]
    data += [("huge", f"p{i:02d}") for i in range(41)] * 8  # one basket with every product and a hot share of rows
    df = spark.createDataFrame(data, "customer string, product string")
    got = [tuple(r) for r in cross_sell_pairs(df, widely_bought=widely).collect()]
    assert got == _brute_pairs(data, 10)


@pytest.mark.parametrize("block", [4, 1024])
@pytest.mark.parametrize("shape", ["random", "disjoint", "twins", "sparse"])
def test_pairs_where_many_are_equal(spark, monkeypatch, shape, block):
    import random

    from gridlore.operators import product_pairs

    for name, value in (("EASY_PAIRS", 0), ("EASY_PER_ROW", 0), ("BLOCK", block)):
        monkeypatch.setattr(product_pairs, name, value)
    rnd = random.Random(block)
    if shape == "random":
        data = [(f"c{rnd.randint(0, 30)}", f"p{rnd.randint(0, 60):02d}") for _ in range(500)]
    elif shape == "disjoint":
        data = [(f"c{c}", f"p{rnd.random()}") for c in range(6) for _ in range(40)]
    elif shape == "twins":
        data = [(f"c{c}{twin}", f"p{c * 30 + i:03d}") for c in range(4) for twin in "abc" for i in range(30)]
    else:  # single products but for one pair at the end of the names
        data = [(f"c{c}", f"p{c:03d}") for c in range(200)] + [(f"c{c}", x) for c in (1, 2) for x in ("z1", "z2")] + [("c5", "z3")]
    df = spark.createDataFrame(data, "customer string, product string")
    got = [tuple(r) for r in cross_sell_pairs(df, widely_bought=4).collect()]
    assert got == _brute_pairs(data, 10)


def test_pairs_of_large_disjoint_baskets(spark):
    df = spark.range(60_000).selectExpr("concat('c', id % 20) AS customer", "concat('p', lpad(id, 5, '0')) AS product")
    began = time.time()
    got = [tuple(r) for r in cross_sell_pairs(df).collect()]
    assert got == [("p00000", f"p{20 * k:05d}", 1) for k in range(1, 11)]
    assert time.time() - began < 60  # 90 million pairs are never formed


def test_pairs_need_three_customers(frame):
    df = frame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")] * 4, "customer string, product string")
    assert cross_sell_pairs(df).count() == 0


def test_stock_rules(frame, rows):
    df = frame([(f"i{k:02d}", float(s)) for k, s in enumerate([0, 1, 2, 3, 4, 5, 6, 7, 8, 100])], "item string, stock double")
    assert {r["class"]: r["count"] for r in inventory.stock_classes(df).collect()} == {
        "dead_stock": 1, "slow_moving": 2, "fast_moving": 3}
    assert rows(inventory.overstock_items(df), "item") == [("i09",)]
    first = inventory.reorder_suggestions(df).first()
    assert first["reorder_point"] == 1.35 and first["suggested_qty"] == 13


def test_people_on_a_small_table(frame, rows):
    df = frame([("ann", 10.0, "x"), ("bob", 20.0, "y"), ("ann", 30.0, "x"), ("cat", None, None)],
               "employee string, salary double, department string")
    out = people.people(df)
    assert rows(out["headcount"]) == [(4, 3, True)]
    assert rows(out["duplicate_employees"]) == [("ann", 2)]
    assert rows(out["duplicate_employee_rows"]) == [("ann", 10.0, "x"), ("ann", 30.0, "x")]
    assert rows(out["salary_by_department"]) == [("x", 20.0, 20.0, 2), ("y", 20.0, 20.0, 1)]


# ---- regression and forecasting


def test_models_learn_a_line(spark):
    df = spark.range(400).select(F.col("id").cast("double").alias("x"), (F.col("id") * 3 + 5).cast("double").alias("y"),
                                 F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("t"), "id")
    line = regression.train(df, "y", ["x"], "linear", ["id"])
    got = {r["term"]: r["value"] for r in regression.coefficients(line).collect()}
    assert got == pytest.approx({"x": 3.0, "intercept": 5.0}, abs=1e-6)
    assert regression.model_metrics(line).first()["r2"] == 1.0
    trees = regression.train(df, "y", ["x", "t"], "gbt", ["id"], rounds=5)
    ranked = regression.feature_importance(trees).collect()
    assert ranked[0]["feature"] == "x" and sum(r["importance"] for r in ranked) == pytest.approx(100, abs=0.1)
    unseen = spark.createDataFrame([(1.0, "zzz"), (None, "a")], "x double, t string")
    assert regression.predict(trees, unseen).where("predicted is not null").count() == 2
    assert {r["f_1"] for r in regression.encode(unseen, ["x", "t"], trees.labels).collect()} == {-1.0, 0.0}


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(500)
    a = {r["id"] for r in regression.train_test_split(df.repartition(3), ["id"])[1].collect()}
    b = {r["id"] for r in regression.train_test_split(df.repartition(11), ["id"])[1].collect()}
    assert a == b and 100 < len(a) < 200
    with pytest.raises(ValueError):
        regression.train_test_split(df.limit(2), ["id"])


def _series(spark, values, step=1):
    start = datetime(2024, 1, 1)
    return spark.createDataFrame([(start + timedelta(days=step * i), float(v)) for i, v in enumerate(values)], "ds timestamp, y double")


@pytest.mark.parametrize("n,step,method", [(1, 1, "linear"), (13, 1, "linear"), (14, 1, "seasonal"), (3, 7, "linear"),
                                           (4, 7, "seasonal"), (2, 30, "seasonal")])
def test_method_choice(spark, n, step, method):
    assert forecast.method_choice(_series(spark, range(n), step)).first()["method"] == method


def test_linear_forecast_continues_the_line(spark):
    got = forecast.linear_forecast(_series(spark, [1, 2, 3, 4]), 2).orderBy("ds").collect()
    assert [r["yhat"] for r in got] == pytest.approx([5.0, 6.0])
    assert got[0]["ds"] == datetime(2024, 1, 5) and got[0]["yhat_lower"] == pytest.approx(4.5)
    one = forecast.linear_forecast(_series(spark, [7]), 1).first()
    assert one["yhat"] == 7.0 and one["ds"] == datetime(2024, 1, 31)
    with pytest.raises(ValueError):
        forecast.linear_forecast(_series(spark, [1, 2]), 121)


def test_seasonal_model_recovers_a_weekly_wave(spark):
    y = [100 + i + 20 * math.sin(2 * math.pi * i / 7) for i in range(140)]
    series = _series(spark, y)
    out = forecast.seasonal_forecast(series, 14).orderBy("ds").collect()
    want = [100 + i + 20 * math.sin(2 * math.pi * i / 7) for i in range(140, 154)]
    error = sum(abs(r["yhat"] - w) / w for r, w in zip(out, want)) / 14
    assert error < 0.05
    linear = forecast.forecast_metrics(forecast.linear_fitted(series)).first()["mape"]
    seasonal = forecast.forecast_metrics(forecast.seasonal_model(series).where("not is_forecast")).first()["mape"]
    assert seasonal < linear / 3


def test_forecast_of_many_series(spark):
    rows = [(k, datetime(2024, 1, 1) + timedelta(days=i), float(i * k)) for k in (1, 2) for i in range(20 if k == 1 else 5)]
    df = spark.createDataFrame(rows, "k int, d timestamp, v double")
    out = forecast.forecast(df, "d", "v", 3, ["k"])
    got = {(r["k"], r["method"]) for r in out["forecast"].collect()}
    assert got == {(1, "seasonal"), (2, "linear")} and out["forecast"].count() == 6
    assert out["metrics"].count() == 2 and out["history"].count() == 25


def test_results_do_not_depend_on_partitions(spark, rows):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    for run in (lambda d: insights.trends(d, ["o_orderdate", "o_orderkey"]), lambda d: profile.numeric_summary(d),
                lambda d: dashboard.kpis(d, ["o_orderdate", "o_orderkey"])):
        assert rows(run(df)) == rows(run(df.repartition(13)))


def test_forest_scores_match_a_plain_walk():
    import numpy as np

    rng = np.random.default_rng(0)
    values = np.round(rng.normal(size=(256, 3)), 2)
    trees = [isolation.grow_tree(values, t, 7) for t in range(4)]

    def walk(tree, row):
        node = tree.iloc[0]
        while node["feature"] >= 0:
            side = "left" if row[int(node["feature"])] <= node["cut"] else "right"
            node = tree.iloc[int(node[side])]
        return node["depth"]

    rows = rng.normal(size=(40, 3)) * 2
    want = [2 ** (-np.mean([walk(t, r) for t in trees]) / isolation.average_path(256)) for r in rows]
    got = isolation.path_score(rows, [isolation.pack_tree(t) for t in trees], 256)
    assert got == pytest.approx(want)
    assert all((t["feature"] < 0).sum() == (t["feature"] >= 0).sum() + 1 for t in trees)


def test_old_stock_keeps_its_bracket(spark):
    df = spark.createDataFrame([(datetime(1990, 1, 1), 5.0)], "date timestamp, stock double")
    got = inventory.stock_aging(df, datetime(2024, 1, 1)).collect()
    assert [tuple(r) for r in got] == [(">365 days", 1, 5.0)]


def test_every_anomaly_is_counted(spark):
    df = spark.createDataFrame([(i, 1000.0 if i < 60 else 1.0 + i % 2) for i in range(3000)], "i long, v double")
    got = {r["name"]: r["value"] for r in insights.insight_counts(df.select("v"), ["v"]).collect()}
    assert got["anomalies"] == 60


def test_given_dates_are_all_used(spark):
    day, weekend = datetime(2024, 1, 3, 12), datetime(2024, 1, 6, 12)
    df = spark.createDataFrame([(day, day, weekend)] * 12, "a timestamp, b timestamp, c timestamp")
    got = fraud.timing_patterns(df, ["a", "b", "c"]).collect()
    assert [(r["column"], r["weekend"]) for r in got] == [("c", 12)]


def test_backslash_is_a_header_symbol(spark):
    df = spark.createDataFrame([("a\\b", 1), ("plain", 2)], "name string, ordinal int")
    assert df.where(F.col("name").rlike(audit.HEADER_SYMBOLS)).count() == 1


def test_pairs_are_sent_as_runs_and_copies_collapse():
    import pyarrow as pa

    from gridlore.operators import product_pairs as pp

    basket = list(range(200))
    lists = pa.record_batch({"a": pa.array([basket] * 300, pa.list_(pa.int64())), "b": pa.nulls(300, pa.list_(pa.int64()))})
    runs = list(pp._runs(iter([lists]), 8, 16, 4))
    assert sum(r.num_rows for r in runs) <= 4 * (300 * 19_900 // pp.RUN + 2)  # 6 million pairs, a row per part and run
    parts = [pa.concat_batches([r.filter(pa.compute.equal(r["part"], p)) for r in runs]) for p in range(4)]
    assert min(len(p) for p in parts) > 0
    found = [row for p in parts for b in pp._counted(iter([p]), 8, 16, 300, None) for row in zip(*(c.to_pylist() for c in b.columns))]
    assert sorted(found) == [(i, j, 300) for i in basket for j in basket[i + 1:]]
    assert [len(b) for b in pp._counted(iter(parts[:1]), 8, 16, 300, 5)] == [5]


def test_pairs_of_many_parts(spark, monkeypatch):
    import random

    from gridlore.operators import product_pairs

    monkeypatch.setattr(product_pairs, "PER_TASK", 100)
    rnd = random.Random(3)
    data = [(f"c{rnd.randint(0, 40)}", f"p{rnd.randint(0, 25)}") for _ in range(600)]
    got = [tuple(r) for r in cross_sell_pairs(spark.createDataFrame(data, "customer string, product string"), widely_bought=5).collect()]
    assert got == _brute_pairs(data, 10)


def test_trees_grow_on_cells_of_equal_bins(spark, monkeypatch):
    """Same trees as on all rows where features have few values, and few rows to grow them on."""
    from pyspark.ml.feature import VectorAssembler

    given, fit = [], regression.GBTRegressor._fit
    monkeypatch.setattr(regression.GBTRegressor, "_fit", lambda self, rows: given.append(rows.count()) or fit(self, rows))
    df = spark.range(6000).selectExpr("id", "id % 7 + 0.5 AS a", "id % 11 * 1.5 AS b", "(id % 7) * (id % 11) + pmod(hash(id), 50) / 10 AS y")
    model = regression.train(df, "y", ["a", "b"], "gbt", ["id"], rounds=5)
    assert given == [77]
    train_rows, test_rows = regression.train_test_split(df, ["id"])
    put = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform
    plain = regression.GBTRegressor(labelCol="y", maxIter=5, stepSize=regression.RATE, maxDepth=regression.DEPTH, seed=1).fit(put(train_rows))
    assert model.fitted.stages[-1].featureImportances.toArray() == pytest.approx(plain.featureImportances.toArray(), rel=1e-6)
    want = {r["id"]: r["prediction"] for r in plain.transform(put(test_rows)).collect()}
    got = {r["id"]: r["predicted"] for r in model.transform(model.test).collect()}
    assert got == pytest.approx(want)
    wide = spark.range(20_000).selectExpr("id", "double(id) AS a", "double(id) AS y")
    regression.train(wide, "y", ["a"], "gbt", ["id"], rounds=1)
    assert given[-1] == 32
