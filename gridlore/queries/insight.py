"""Queries for insights and dashboard data."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlore.operators import dashboard as dash, insights as ins
from gridlore.queries.core import union_all
from gridlore.queries.quality import _view
from gridlore.queries.registry import Tables, pct, query, rnd

# Orders in date order, with a rising, a falling and a gappy figure.
_SERIES = """SELECT o_orderkey, o_orderdate, o_orderpriority, o_orderstatus, o_totalprice,
  DATEDIFF({day}o_orderdate, TIMESTAMP '1995-01-01') * 10.0 + o_totalprice / 1000 AS rising,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE -5000.0 - o_totalprice / 100 END AS negative
FROM orders"""
_SPARK_SERIES = _SERIES.format(day="")
_DUCK_SERIES = _SERIES.replace("DATEDIFF({day}o_orderdate, TIMESTAMP '1995-01-01')",
                               "DATEDIFF('day', TIMESTAMP '1995-01-01', o_orderdate)")
_ORDER = ["o_orderdate", "o_orderkey"]
_METRICS = ("o_totalprice", "rising", "negative")
_X = f"WITH x AS ({_DUCK_SERIES}) "


def _series(spark, sf):
    return _view(Tables(spark, sf), _SPARK_SERIES, "orders")


def _trend(c: str, group: str = "") -> str:
    key = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return f"""SELECT {key}'{c}' AS metric, CASE WHEN ch > 0 THEN 'up' ELSE 'down' END AS direction, {rnd('ch')} AS change_pct
FROM (SELECT {key}REGR_SLOPE(y, p) * COUNT(*) / ABS(AVG(y)) * 100 AS ch, COUNT(*) AS n FROM (SELECT {key}CAST({c} AS DOUBLE) AS y,
ROW_NUMBER() OVER ({part}ORDER BY o_orderdate, o_orderkey) - 1 AS p FROM x WHERE {c} IS NOT NULL)
{'GROUP BY ' + group if group else ''}) WHERE n >= 5 AND ABS(ch) >= 5"""


@query("trends", _X + union_all([_trend(c) for c in _METRICS]))
def q_trends(spark, sf):
    return ins.trends(_series(spark, sf), _ORDER, _METRICS)


@query("trends_by_group", _X + union_all([_trend(c, "o_orderpriority") for c in _METRICS]))
def q_trends_group(spark, sf):
    return ins.trends(_series(spark, sf), _ORDER, _METRICS, ["o_orderpriority"])


_CELLS = """SELECT event_id, 'value' AS "column", CAST(value AS DOUBLE) AS v, event_type FROM events
UNION ALL SELECT event_id, 'user_id', CAST(user_id AS DOUBLE), event_type FROM events"""


@query("anomalies_zscore", f"""SELECT event_id, "column", v AS "value", {rnd('z', 4)} AS z_score FROM (SELECT *,
ABS((v - AVG(v) OVER (PARTITION BY "column")) / STDDEV_SAMP(v) OVER (PARTITION BY "column")) AS z FROM ({_CELLS}))
WHERE z > 3 ORDER BY z DESC, "column", v, event_id LIMIT 50""")
def q_anomalies(spark, sf):
    return ins.anomalies_zscore(Tables(spark, sf).events.select("event_id", "value", "user_id"), ids=["event_id"])


@query("anomalies_zscore_by_group", f"""SELECT event_type, event_id, "column", v AS "value", {rnd('z', 4)} AS z_score FROM (SELECT *,
ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY z DESC, "column", v, event_id) AS r FROM (SELECT *,
ABS((v - AVG(v) OVER w) / STDDEV_SAMP(v) OVER w) AS z FROM ({_CELLS}) WINDOW w AS (PARTITION BY "column", event_type))
WHERE z > 3) WHERE r <= 50""")
def q_anomalies_group(spark, sf):
    table = Tables(spark, sf).events.select("event_id", "value", "user_id", "event_type")
    return ins.anomalies_zscore(table, ids=["event_id"], group_by=["event_type"])


_LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "value")
_STRONG = "SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_discount * 100 - l_tax AS value FROM lineitem"


@query("strong_correlations", f"WITH x AS ({_STRONG}) SELECT col_1, col_2, {rnd('r', 4)} AS pearson, CASE WHEN ABS(r) >= 0.8 THEN "
       "'very_strong' WHEN ABS(r) >= 0.6 THEN 'strong' ELSE 'moderate' END AS strength, CASE WHEN r > 0 THEN 'positive' ELSE "
       "'negative' END AS direction FROM (" + union_all([
           f"SELECT '{a}' AS col_1, '{b}' AS col_2, CORR({a}, {b}) AS r FROM x" for i, a in enumerate(_LINE) for b in _LINE[i + 1:]])
       + ") WHERE ABS(r) >= 0.5")
def q_strong(spark, sf):
    return ins.strong_correlations(_view(Tables(spark, sf), _STRONG, "lineitem"))


def _best(c: str, m: str, n: int) -> str:
    return f"""SELECT * FROM (SELECT '{c}' AS "column", '{m}' AS metric, {c} AS category, {rnd(f'AVG({m})', 4)} AS "value",
CAST(ROW_NUMBER() OVER (ORDER BY AVG({m}) DESC, {c}) AS INTEGER) AS "rank" FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY {c}) WHERE "rank" <= {n}"""


def _lines(t: Tables):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        "p_name", "p_brand", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount")


@query("top_performers", union_all([_best(c, m, 5) for c in ("p_brand", "l_returnflag") for m in
                                    ("l_quantity", "l_extendedprice", "l_discount")]))
def q_performers(spark, sf):
    return ins.top_performers(_lines(Tables(spark, sf)), metrics=["l_quantity", "l_extendedprice", "l_discount"])


@query("top_performers_by_group", union_all([
    f"""SELECT * FROM (SELECT l_linestatus, '{c}' AS "column", '{m}' AS metric, {c} AS category, {rnd(f'AVG({m})', 4)} AS "value",
CAST(ROW_NUMBER() OVER (PARTITION BY l_linestatus ORDER BY AVG({m}) DESC, {c}) AS INTEGER) AS "rank" FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY l_linestatus, {c}) WHERE "rank" <= 5""" for c in ("p_brand", "l_returnflag") for m in ("l_quantity", "l_discount")]))
def q_performers_group(spark, sf):
    t = Tables(spark, sf)
    table = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_linestatus", "p_brand", "l_returnflag", "l_quantity", "l_discount")
    return ins.top_performers(table, group_by=["l_linestatus"])


_Z = " + ".join(f"(SELECT COUNT(*) FROM (SELECT ABS(({c} - AVG({c}) OVER ()) / STDDEV_SAMP({c}) OVER ()) AS z FROM x) WHERE z > 3)"
                for c in ("o_orderkey", *_METRICS))
_N = ("o_orderkey", *_METRICS)


@query("insight_counts", _X + f"""SELECT 'rows' AS name, COUNT(*) AS "value" FROM x UNION ALL SELECT 'columns', 7 UNION ALL
SELECT 'numeric_columns', 4 UNION ALL SELECT 'text_columns', 2 UNION ALL SELECT 'date_columns', 1 UNION ALL
SELECT 'trends', COUNT(*) FROM ({union_all([_trend(c) for c in _N])}) UNION ALL SELECT 'anomalies', {_Z} UNION ALL
SELECT 'correlations', COUNT(*) FROM ({union_all([f"SELECT CORR({a}, {b}) AS r FROM x" for i, a in enumerate(_N) for b in _N[i + 1:]])})
WHERE ABS(r) >= 0.5""")
def q_counts(spark, sf):
    return ins.insight_counts(_series(spark, sf), _ORDER)


# ---- dashboard -------------------------------------------------------------------------

_HALVES = """(SELECT COUNT(*) AS n, AVG(y) FILTER (WHERE p < n2) AS a, AVG(y) FILTER (WHERE p >= n2 AND p < 2 * n2) AS b,
SUM(y) FILTER (WHERE p < n2) AS sa, SUM(y) FILTER (WHERE p >= n2) AS sb, SUM(y) AS total, AVG(y) AS mean, MIN(y) AS lo, MAX(y) AS hi
FROM (SELECT CAST({c} AS DOUBLE) AS y, ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS p, COUNT(*) OVER () // 2 AS n2
FROM x WHERE {c} IS NOT NULL))"""
_CHANGE = "CASE WHEN n // 2 > 1 AND ABS({a}) > 1e-9 THEN ({b} - {a}) / {a} * 100 ELSE 0 END"


def _cards(i: int, c: str) -> str:
    ch = rnd(_CHANGE.format(a="a", b="b"))
    rows = (("total", "total", ch), ("mean", "mean", ch), ("min", "lo", "CAST(0 AS DOUBLE)"), ("max", "hi", "CAST(0 AS DOUBLE)"))
    return union_all([f"SELECT {i * 4 + j} AS ord, '{card}' AS card, '{c}' AS \"column\", {rnd(v)} AS \"value\", {k} AS change_pct "
                      f"FROM {_HALVES.format(c=c)}" for j, (card, v, k) in enumerate(rows)])


@query("kpis", _X + union_all([_cards(i, c) for i, c in enumerate(_METRICS)]))
def q_kpis(spark, sf):
    return dash.kpis(_series(spark, sf), _ORDER, _METRICS)


@query("data_period", """SELECT 'o_orderdate' AS "column", CAST(MIN(o_orderdate) AS TIMESTAMP) AS "first",
CAST(MAX(o_orderdate) AS TIMESTAMP) AS "last" FROM orders""")
def q_period(spark, sf):
    return dash.data_period(Tables(spark, sf).orders)


@query("line_chart_data", _X + union_all([
    f"""SELECT 'line' AS chart, 'trend {c}' AS title, STRFTIME(d, '%Y-%m-%d') AS label, '{c}' AS series, {rnd('v', 4)} AS "value",
CAST(ROW_NUMBER() OVER (ORDER BY d) AS INTEGER) AS ord FROM (SELECT DATE_TRUNC('month', o_orderdate) AS d, AVG({c}) AS v FROM x
GROUP BY 1) WHERE v IS NOT NULL""" for c in _METRICS]))
def q_line(spark, sf):
    return dash.line_chart_data(_series(spark, sf), "month", "o_orderdate", _METRICS)


@query("bar_chart_data", _X + union_all([
    f"""SELECT * FROM (SELECT 'bar' AS chart, 'mean o_totalprice by {c}' AS title, {c} AS label, 'o_totalprice' AS series,
{rnd('AVG(o_totalprice)', 4)} AS "value", CAST(ROW_NUMBER() OVER (ORDER BY AVG(o_totalprice) DESC, {c}) AS INTEGER) AS ord
FROM x GROUP BY {c}) WHERE ord <= 10""" for c in ("o_orderpriority", "o_orderstatus")]))
def q_bar(spark, sf):
    return dash.bar_chart_data(_series(spark, sf), metrics=["o_totalprice", "rising"])


@query("pie_chart_data", _X + union_all([
    f"""SELECT * FROM (SELECT 'pie' AS chart, 'distribution {c}' AS title, {c} AS label, 'count' AS series,
CAST(COUNT(*) AS DOUBLE) AS "value", CAST(ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, {c}) AS INTEGER) AS ord
FROM x GROUP BY {c}) WHERE ord <= 8""" for c in ("o_orderpriority", "o_orderstatus")]))
def q_pie(spark, sf):
    return dash.pie_chart_data(_series(spark, sf))


@query("dashboard_summary", _X + f"""SELECT {rnd('(SELECT SUM(o_totalprice) FROM x)')} AS total_revenue,
{rnd('(SELECT SUM(rising) FROM x)')} AS total_profit, {rnd(_CHANGE.format(a='sa', b='sb'))} AS growth, n AS row_count,
CAST(7 AS BIGINT) AS column_count, CAST(3 AS BIGINT) AS numeric_count FROM {_HALVES.format(c='o_totalprice')}""")
def q_summary(spark, sf):
    return dash.dashboard_summary(_series(spark, sf), _ORDER, _METRICS)


@query("dashboard_insights", _X + f"""SELECT CAST(DENSE_RANK() OVER (ORDER BY o) AS INTEGER) AS ord, code, "column", "text", "value", value_2, value_3
FROM (SELECT 0 AS o, 'size' AS code, CAST(NULL AS VARCHAR) AS "column", CAST(NULL AS VARCHAR) AS "text", CAST(COUNT(*) AS DOUBLE) AS "value",
  CAST(7 AS DOUBLE) AS value_2, CAST(NULL AS DOUBLE) AS value_3 FROM x UNION ALL
{union_all([f"SELECT {i + 1}, 'range', '{c}', NULL, {rnd(f'MIN({c})')}, {rnd(f'MAX({c})')}, {rnd(f'AVG({c})')} FROM x"
            for i, c in enumerate(("o_orderkey", "o_totalprice"))])} UNION ALL
{union_all([f'''SELECT * FROM (SELECT {10 + i} AS o, 'top_values', '{c}', {c}, CAST(COUNT(*) AS DOUBLE), CAST(ROW_NUMBER() OVER (ORDER BY
COUNT(*) DESC, {c}) AS DOUBLE) AS r, CAST(NULL AS DOUBLE) FROM x GROUP BY {c}) WHERE r <= 3'''
            for i, c in enumerate(("o_orderpriority", "o_orderstatus"))])})""")
def q_dash_insights(spark, sf):
    return dash.dashboard_insights(_series(spark, sf), _ORDER)
