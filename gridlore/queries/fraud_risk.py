"""Queries for fraud rules and risk scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlore.operators import fraud as fr, isolation as iso, risk as rk
from gridlore.operators.near_rows import near_duplicate_rows
from gridlore.operators.fraud import BENFORD, ROUND_THRESHOLDS
from gridlore.queries.core import union_all
from gridlore.queries.quality import _view
from gridlore.queries.registry import Tables, query, rnd

_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice"]
_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("isolation_forest")
def q_forest(spark, sf):
    return iso.isolation_forest(Tables(spark, sf).lineitem, _FEATURES, ["l_orderkey", "l_partkey", "l_linenumber"], key=_KEY)


def _z_sql(table: str, group: str, cols, least: int) -> str:
    return union_all([f"""SELECT * FROM (SELECT {group}, {i} AS row_id, '{c}' AS "column", CAST({c} AS DOUBLE) AS v,
ABS(({c} - AVG({c}) OVER w) / STDDEV_SAMP({c}) OVER w) AS z, COUNT({c}) OVER w AS n FROM {table} WINDOW w AS (PARTITION BY {group}))
WHERE n >= {least}""" for c, i in cols])


# Orders per customer are small tables of their own.
@query("anomalies_small", f"""SELECT o_custkey, row_id AS o_orderkey, "column", v AS "value", {rnd('LEAST(1.0, z / 5)', 4)} AS score,
CASE WHEN z > 3.5 THEN 'high' ELSE 'medium' END AS severity FROM ({_z_sql('orders', 'o_custkey', [('o_totalprice', 'o_orderkey')], 3)})
WHERE z > 2.5""")
def q_small(spark, sf):
    table = Tables(spark, sf).orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return fr.anomalies_small(table, ["o_totalprice"], ["o_orderkey"], ["o_custkey"])


_NEAR_INPUT = """SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL
SELECT c_custkey + 10000000, c_name, c_nationkey, c_acctbal + 1, c_mktsegment FROM customer WHERE c_custkey % 50 = 0 UNION ALL
SELECT c_custkey + 20000000, CONCAT(' ', UPPER(c_name), '  '), c_nationkey, c_acctbal, 'OTHER' FROM customer WHERE c_custkey % 75 = 0"""


@query("near_duplicate_rows", f"""WITH RECURSIVE x AS MATERIALIZED (SELECT id, LOWER(TRIM(REGEXP_REPLACE(name, '\\s+', ' ', 'g'))) AS name, nation, balance, LOWER(segment) AS segment
FROM ({_NEAR_INPUT})),
links AS MATERIALIZED (SELECT a.id AS p, b.id AS q FROM x a JOIN x b ON a.id <> b.id AND (a.name = b.name OR a.balance = b.balance) AND
  (a.name IS DISTINCT FROM b.name)::INT + (a.nation IS DISTINCT FROM b.nation)::INT + (a.balance IS DISTINCT FROM b.balance)::INT
  + (a.segment IS DISTINCT FROM b.segment)::INT <= 1),
reached AS (SELECT p AS id, p AS r FROM links UNION SELECT reached.id, q FROM reached JOIN links ON r = p),
classes AS (SELECT id, MIN(r) AS class_id FROM reached GROUP BY id)
SELECT id, class_id, COUNT(*) OVER (PARTITION BY class_id) AS members FROM classes""")
def q_near_rows(spark, sf):
    t = Tables(spark, sf)
    customer = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    plain = customer.toDF("id", "name", "nation", "balance", "segment")
    changed = plain.where("id % 50 = 0").withColumn("id", F.col("id") + 10_000_000).withColumn("balance", F.col("balance") + 1)
    respelt = plain.where("id % 75 = 0").withColumn("id", F.col("id") + 20_000_000).withColumn("segment", F.lit("OTHER")).withColumn(
        "name", F.concat(F.lit(" "), F.upper("name"), F.lit("  ")))
    return near_duplicate_rows(plain.unionByName(changed).unionByName(respelt), "id")


@query("duplicate_groups", "SELECT text, lang, COUNT(*) AS \"count\" FROM documents GROUP BY text, lang HAVING COUNT(*) > 1")
def q_dup_groups(spark, sf):
    return fr.duplicate_groups(Tables(spark, sf).documents, ["text", "lang"])


@query("duplicate_groups_lines", """SELECT l_partkey, l_quantity, NULLIF(l_tax, 0) AS tax, COUNT(*) AS "count" FROM lineitem
WHERE l_tax <> 0 GROUP BY ALL HAVING COUNT(*) > 1""")
def q_dup_lines(spark, sf):
    table = Tables(spark, sf).lineitem.select("l_partkey", "l_quantity", F.expr("nullif(l_tax, 0)").alias("tax"))
    return fr.duplicate_groups(table, skip_null_keys=True)


_NIGHT = "EXTRACT(HOUR FROM ts) >= 22 OR EXTRACT(HOUR FROM ts) <= 4"
_WEEKEND = "EXTRACT(ISODOW FROM ts) >= 6"


@query("timing_patterns", f"""SELECT 'ts' AS "column", COUNT(*) FILTER (WHERE {_WEEKEND}) AS weekend, COUNT(*) FILTER (WHERE {_NIGHT}) AS night,
COUNT(*) FILTER (WHERE {_WEEKEND}) + COUNT(*) FILTER (WHERE {_NIGHT}) AS "count" FROM events""")
def q_timing(spark, sf):
    return fr.timing_patterns(Tables(spark, sf).events)


@query("timing_patterns_by_group", f"""SELECT * FROM (SELECT user_id, 'ts' AS "column", COUNT(*) FILTER (WHERE {_WEEKEND}) AS weekend,
CASE WHEN COUNT(DISTINCT STRFTIME(ts, '%H:%M:%S.%f')) > 1 THEN COUNT(*) FILTER (WHERE {_NIGHT}) ELSE 0 END AS night,
COUNT(*) FILTER (WHERE {_WEEKEND}) + COUNT(*) FILTER (WHERE {_NIGHT}) AS "count" FROM events GROUP BY user_id HAVING COUNT(*) >= 5) WHERE "count" > 0""")
def q_timing_group(spark, sf):
    return fr.timing_patterns(Tables(spark, sf).events, group_by=["user_id"])


@query("timing_examples", f"""SELECT 'weekend' AS kind, CAST(ts AS TIMESTAMP) AS "at" FROM (SELECT ts FROM events WHERE {_WEEKEND} ORDER BY ts LIMIT 5)
UNION ALL SELECT 'night', CAST(ts AS TIMESTAMP) FROM (SELECT ts FROM events WHERE {_NIGHT} ORDER BY ts LIMIT 5)""")
def q_timing_examples(spark, sf):
    return fr.timing_examples(Tables(spark, sf).events, "ts")


_ROUND = "SELECT l_suppkey, l_quantity * 1000 AS units, FLOOR(l_extendedprice / 50) * 50.0 AS price, l_discount FROM lineitem"


def _round_sql(group: str = "") -> str:
    key, by = (f"{group}, ", f"GROUP BY {group} ") if group else ("", "")
    return f"WITH x AS ({_ROUND}) " + union_all([
        f"SELECT {key}'{c}' AS \"column\", CAST({t} AS BIGINT) AS threshold, COUNT(*) FILTER (WHERE {c} >= {t} AND FMOD({c}, {t}) = 0) AS \"count\" "
        f"FROM x {by}HAVING COUNT(*) FILTER (WHERE {c} >= {t} AND FMOD({c}, {t}) = 0) >= 3 AND COUNT({c}) >= 5"
        for c in ("units", "price", "l_discount") for t in ROUND_THRESHOLDS])


@query("round_numbers", _round_sql())
def q_round(spark, sf):
    table = _view(Tables(spark, sf), _ROUND, "lineitem")
    return fr.round_numbers(table, ["units", "price", "l_discount"])


@query("round_numbers_by_group", _round_sql("l_suppkey"))
def q_round_group(spark, sf):
    table = _view(Tables(spark, sf), _ROUND, "lineitem")
    return fr.round_numbers(table, ["units", "price", "l_discount"], ["l_suppkey"])


def _benford_sql(table: str, cols, group: str = "", deviant: str = "") -> str:
    key = f"{group}, " if group else ""
    digits = ", ".join(f"('{d}', {e})" for d, e in BENFORD.items())
    parts = [f"""SELECT {key}'{c}' AS "column", d.digit, COUNT(*) FILTER (WHERE f = d.digit) AS n,
{rnd('COUNT(*) FILTER (WHERE f = d.digit) / CAST(COUNT(*) AS DOUBLE)', 4)} AS actual, CAST(d.e AS DOUBLE) AS expected,
{rnd('ABS(COUNT(*) FILTER (WHERE f = d.digit) / CAST(COUNT(*) AS DOUBLE) - CAST(d.e AS DOUBLE))', 4)} AS deviation,
ABS(COUNT(*) FILTER (WHERE f = d.digit) / CAST(COUNT(*) AS DOUBLE) - CAST(d.e AS DOUBLE)) > 0.05 AS deviant
FROM (SELECT {key}REGEXP_EXTRACT(CAST(CAST({c} AS DOUBLE) AS VARCHAR), '[1-9]') AS f FROM {table} WHERE {c} > 0), (VALUES {digits}) d(digit, e)
GROUP BY {key}d.digit, d.e HAVING COUNT(*) >= 50""" for c in cols]
    return f"SELECT * FROM ({union_all(parts)}) {deviant}"


@query("benford", _benford_sql("lineitem", ("l_extendedprice", "l_discount", "l_quantity")))
def q_benford(spark, sf):
    return fr.benford(Tables(spark, sf).lineitem, ["l_extendedprice", "l_discount", "l_quantity"])


@query("benford_by_group", _benford_sql("lineitem", ("l_extendedprice",), "l_suppkey", "WHERE deviant"))
def q_benford_group(spark, sf):
    return fr.benford(Tables(spark, sf).lineitem, ["l_extendedprice"], ["l_suppkey"], only_deviant=True)


_LEDGER = """SELECT user_id, CAST(value AS DOUBLE) AS value, FLOOR(value) * 100 AS amount, ts FROM events"""
_PATTERNS = f"""SELECT 'duplicate_rows' AS pattern, CAST(NULL AS VARCHAR) AS "column", COUNT(*) AS "count" FROM (SELECT user_id, value, amount, ts, COUNT(*) AS k
FROM x GROUP BY ALL HAVING COUNT(*) > 1) HAVING COUNT(*) > 0 UNION ALL SELECT 'unusual_timing', 'ts', COUNT(*) FILTER (WHERE {_WEEKEND}) + COUNT(*) FILTER (WHERE {_NIGHT})
FROM x UNION ALL SELECT 'round_numbers', NULL, COUNT(*) FROM ({union_all([
    f"SELECT 1 FROM x HAVING COUNT(*) FILTER (WHERE {c} >= {t} AND FMOD({c}, {t}) = 0) >= 3" for c in ("user_id", "value", "amount")
    for t in ROUND_THRESHOLDS])}) HAVING COUNT(*) > 0 UNION ALL
SELECT 'first_digits', "column", COUNT(*) FROM ({_benford_sql('x', ('user_id', 'value', 'amount'))}) WHERE deviant GROUP BY "column" """


@query("suspicious_patterns", f"WITH x AS ({_LEDGER}) SELECT * FROM ({_PATTERNS})")
def q_patterns(spark, sf):
    return fr.suspicious_patterns(_view(Tables(spark, sf), _LEDGER, "events"))


_SCORED = f"""WITH x AS (SELECT l_suppkey, l_quantity * 1000 AS units, l_extendedprice AS price FROM lineitem),
a AS ({union_all([f'''SELECT l_suppkey FROM (SELECT l_suppkey, ABS(({c} - AVG({c}) OVER w) / STDDEV_SAMP({c}) OVER w) AS z, COUNT(*) OVER w AS n
FROM x WINDOW w AS (PARTITION BY l_suppkey)) WHERE n >= 3 AND z > 2.5''' for c in ('units', 'price')])}),
p AS (SELECT l_suppkey FROM (SELECT l_suppkey, COUNT(*) AS k FROM (SELECT l_suppkey FROM x GROUP BY l_suppkey, units, price HAVING COUNT(*) > 1)
GROUP BY l_suppkey) UNION ALL SELECT DISTINCT l_suppkey FROM ({union_all([
    f"SELECT l_suppkey FROM x GROUP BY l_suppkey HAVING COUNT(*) >= 5 AND COUNT(*) FILTER (WHERE {c} >= {t} AND FMOD({c}, {t}) = 0) >= 3"
    for c in ('units', 'price') for t in ROUND_THRESHOLDS])}) UNION ALL
SELECT DISTINCT l_suppkey FROM ({_benford_sql('x', ('units',), 'l_suppkey')}) WHERE deviant UNION ALL
SELECT DISTINCT l_suppkey FROM ({_benford_sql('x', ('price',), 'l_suppkey')}) WHERE deviant),
h AS (SELECT l_suppkey, 1 AS a, 0 AS p FROM a UNION ALL SELECT l_suppkey, 0, 1 FROM p)
SELECT l_suppkey, CAST(SUM(a) AS BIGINT) AS anomalies, CAST(SUM(p) AS BIGINT) AS patterns,
CAST(LEAST(100, SUM(a) * 5 + SUM(p) * 15) AS DOUBLE) AS fraud_score FROM h GROUP BY l_suppkey"""


@query("fraud_score_by_supplier", _SCORED)
def q_score(spark, sf):
    table = _view(Tables(spark, sf), "SELECT l_suppkey, l_quantity * 1000 AS units, l_extendedprice AS price FROM lineitem", "lineitem")
    anomalies = fr.anomalies_small(table, group_by=["l_suppkey"])
    return fr.fraud_score(anomalies, fr.suspicious_patterns(table, ["l_suppkey"]), ["l_suppkey"])


@query("fraud_score")
def q_fraud(spark, sf):
    return fr.fraud(_view(Tables(spark, sf), _LEDGER, "events"))["score"]


# ---- risk ------------------------------------------------------------------------------

_RISKY = """SELECT o_orderkey, o_orderdate, NULLIF(o_orderstatus, 'P') AS status, o_orderpriority,
  CASE WHEN o_custkey % 4 = 0 THEN 'one' ELSE 'other' END AS channel, o_custkey % 10 AS desk, o_totalprice,
  {days} * -3.0 + o_totalprice / 1000 + 12000 AS falling,
  CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_totalprice END AS partial FROM orders"""
_RISK_SPARK = _RISKY.format(days="DATEDIFF(o_orderdate, TIMESTAMP '1995-01-01')")
_RISK_DUCK = _RISKY.format(days="DATEDIFF('day', TIMESTAMP '1995-01-01', o_orderdate)")
_R_NUM, _R_TXT = ("o_totalprice", "falling", "partial"), ("status", "o_orderpriority", "channel")


def _risk_table(spark, sf, group: bool):
    table = _view(Tables(spark, sf), _RISK_SPARK, "orders")
    return table.select(*([] if not group else ["desk"]), "o_orderdate", *_R_TXT, *_R_NUM)


def _reason(cond: str, name: str = "c") -> str:
    return f"COALESCE(STRING_AGG(DISTINCT {name}, ',' ORDER BY {name}) FILTER (WHERE {cond}), '')"


def _dim(name: str, weight: float, key: str, score: str, reason: str, tail: str) -> str:
    return (f"SELECT {key}'{name}' AS name, {rnd(score)} AS score, CAST({weight} AS DOUBLE) AS weight, {reason} AS reason {tail}")


def _risk_sql(group: str = "") -> str:
    key = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    part = f"PARTITION BY {group}" if group else ""
    cols = ("o_orderdate", *_R_TXT, *_R_NUM)
    vol = union_all([f"SELECT {key}'{c}' AS c, CASE WHEN COUNT({c}) >= 5 AND AVG({c}) <> 0 THEN STDDEV_SAMP({c}) / ABS(AVG({c})) END AS cv FROM x {by}"
                     for c in _R_NUM])
    con = union_all([f"""SELECT {key}'{c}' AS c, CASE WHEN SUM(n) >= 10 AND COUNT(*) >= 2 THEN CASE WHEN MAX(n) / CAST(SUM(n) AS DOUBLE) > 0.5 THEN
MAX(n) / CAST(SUM(n) AS DOUBLE) * 100 WHEN SUM(n) FILTER (WHERE r <= 3) / CAST(SUM(n) AS DOUBLE) > 0.8 THEN SUM(n) FILTER (WHERE r <= 3)
/ CAST(SUM(n) AS DOUBLE) * 80 END END AS s FROM (SELECT {key}{c}, COUNT(*) AS n, ROW_NUMBER() OVER ({part} ORDER BY COUNT(*) DESC, {c}) AS r
FROM x WHERE {c} IS NOT NULL GROUP BY {key}{c}) {by}""" for c in _R_TXT])
    fall = union_all([f"""SELECT {key}'{c}' AS c, REGR_SLOPE(y, p) * COUNT(*) / ABS(AVG(y)) * 100 AS d FROM (SELECT {key}{c} AS y,
ROW_NUMBER() OVER ({part} ORDER BY o_orderdate, {c}) - 1 AS p FROM x WHERE {c} IS NOT NULL) {by} {'HAVING' if group else 'HAVING'} COUNT(*) >= 5"""
                      for c in _R_NUM])
    gone = union_all([f"SELECT {key}'{c}' AS c, COUNT(*) - COUNT({c}) AS g, COUNT(*) AS r FROM x {by}" for c in cols])
    return union_all([
        _dim("volatility", 0.3, key, "LEAST(100.0, COALESCE(MAX(cv), 0) * 100)", _reason("cv > 0.5"), f"FROM ({vol}) {by}"),
        _dim("concentration", 0.25, key, "LEAST(100.0, COALESCE(MAX(s), 0))", _reason("s IS NOT NULL"), f"FROM ({con}) {by}"),
        _dim("trend", 0.25, key, "COALESCE(MAX(CASE WHEN d < -10 THEN LEAST(100.0, ABS(d) * 2) END), 0)", _reason("d < -10"),
             f"FROM ({fall}) {by}"),
        _dim("missing", 0.2, key, "LEAST(100.0, SUM(g) * 100.0 / CAST(SUM(r) AS DOUBLE) * 2)", _reason("g * 100.0 > r * 20.0"),
             f"FROM ({gone}) {by}")])


_RX = f"WITH x AS ({_RISK_DUCK}) "
_PARTS = {"volatility_risk": "volatility", "concentration_risk": "concentration", "trend_risk": "trend", "missing_risk": "missing"}


def _dimension_query(name: str, dim: str):
    @query(name, _RX + f"SELECT * FROM ({_risk_sql()}) WHERE name = '{dim}'")
    def run(spark, sf):
        return getattr(rk, name)(_risk_table(spark, sf, False))


for _name, _dimension in _PARTS.items():
    _dimension_query(_name, _dimension)

_LEVEL = ("CASE WHEN overall_score >= 75 THEN 'critical' WHEN overall_score >= 50 THEN 'high' WHEN overall_score >= 25 THEN 'medium' "
          "ELSE 'low' END AS risk_level")
_MEAN = rnd("SUM(score * weight) / SUM(weight)")


@query("risk_score", _RX + f"SELECT *, {_LEVEL} FROM (SELECT {_MEAN} AS overall_score FROM ({_risk_sql()}))")
def q_risk(spark, sf):
    return rk.risk(_risk_table(spark, sf, False))["score"]


@query("risk_dimensions_by_group", _RX + _risk_sql("desk"))
def q_risk_dims(spark, sf):
    return rk.risk(_risk_table(spark, sf, True), ["desk"])["dimensions"]


@query("risk_score_by_group", _RX + f"SELECT *, {_LEVEL} FROM (SELECT desk, {_MEAN} AS overall_score FROM ({_risk_sql('desk')}) GROUP BY desk)")
def q_risk_group(spark, sf):
    return rk.risk(_risk_table(spark, sf, True), ["desk"])["score"]
