"""Queries for financial health, inventory and people analytics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from gridlore.operators import finance as fin, inventory as inv, people as ppl
from gridlore.operators.finance import FIGURES, POINTS
from gridlore.operators.inventory import AGE_BRACKETS
from gridlore.queries.core import union_all
from gridlore.queries.quality import _view
from gridlore.queries.registry import Tables, pct, query, rnd

# ---- finance: monthly books of each supplier -------------------------------------------

_BOOKS = """SELECT l_suppkey AS entity, DATE_TRUNC('month', o_orderdate) AS month,
  CASE WHEN l_suppkey % 11 = 3 THEN NULL ELSE CAST(SUM(price * (1 - discount)) AS DOUBLE) END AS revenue,
  CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE CAST(SUM(price * share) AS DOUBLE) END AS cogs,
  CAST(SUM(price * tax) AS DOUBLE) AS expense,
  CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE CAST(SUM(price * (margin - discount)) AS DOUBLE) END AS profit,
  CAST(SUM(price) AS DOUBLE) * 2 AS asset, CAST(SUM(price * tax) AS DOUBLE) * 40 AS liability,
  CASE WHEN l_suppkey % 2 = 0 THEN NULL ELSE CAST(SUM(price) AS DOUBLE) END AS current_asset,
  CAST(SUM(price * discount) AS DOUBLE) * 15 AS current_liability,
  SUM(l_quantity) * 500 AS inventory, CASE WHEN MAX(l_linenumber) > 4 THEN SUM(l_quantity) * 100 END AS receivable
FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(14,2)) AS price, CAST(l_discount AS DECIMAL(4,2)) AS discount,
  CAST(l_tax AS DECIMAL(4,2)) AS tax, CAST('0.60' AS DECIMAL(4,2)) AS share, CAST('0.20' AS DECIMAL(4,2)) AS margin FROM lineitem) l
JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey, DATE_TRUNC('month', o_orderdate)"""
_ROLES = {"date": "month", **{f: f for f in FIGURES if f != "equity"}}
_KNOWN = [f for f in FIGURES if f != "equity"]


def _books(spark, sf):
    return _view(Tables(spark, sf), _BOOKS, "lineitem", "orders")


def _latest_sql(key: str = "entity") -> str:
    keyed = f"{key}, " if key else ""
    at = "month" if key else "{m: month, e: entity}"
    picks = ", ".join(f"ARG_MAX({c}, {at}) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in _KNOWN)
    return f"SELECT {keyed}{picks}, CAST(NULL AS DOUBLE) AS equity FROM books {'GROUP BY ' + key if key else ''}"


_B = f"WITH books AS ({_BOOKS}), latest AS ({_latest_sql()}) "
_B1 = f"WITH books AS ({_BOOKS}), latest AS ({_latest_sql('')}) "


def _verdict(v, *steps, low):
    return "CASE " + " ".join(f"WHEN {v} > {b} THEN '{s}'" for b, s in steps) + f" ELSE '{low}' END"


def _metric(family, name, value, unit, verdict, where, digits=2, key="entity, ", source="latest") -> str:
    return (f"SELECT {key}'{family}' AS family, '{name}' AS name, {rnd(value, digits)} AS \"value\", '{unit}' AS unit, {verdict} AS verdict "
            f"FROM {source} WHERE ({where}) AND ({value}) IS NOT NULL")


def _family(family: str, key: str) -> str:
    m = lambda *a, **k: _metric(family, *a, key=key, **k)
    if family == "profitability":
        gross, net = "(revenue - cogs) * 100 / revenue", "COALESCE(profit, revenue - expense) * 100 / revenue"
        oper = "(revenue - cogs - expense) * 100 / revenue"
        return union_all([
            m("gross_margin", gross, "%", _verdict(gross, (40, "good"), (20, "fair"), low="low"), "revenue > 0"),
            m("net_margin", net, "%", _verdict(net, (15, "good"), (5, "fair"), low="low"), "revenue > 0"),
            m("operating_margin", oper, "%", _verdict(oper, (20, "good"), (10, "fair"), low="low"), "revenue > 0"),
            m("profit_indicator", "profit", "currency", _verdict("profit", (0, "positive"), low="negative"), "COALESCE(revenue, 0) <= 0")])
    if family == "liquidity":
        cur, quick = "current_asset / current_liability", "(current_asset - COALESCE(inventory, 0)) / current_liability"
        solv = "asset / liability"
        short = "current_asset IS NOT NULL AND COALESCE(current_liability, 0) > 0"
        return union_all([
            m("current_ratio", cur, "x", _verdict(cur, (1.5, "healthy"), (1, "fair"), low="low"), short),
            m("quick_ratio", quick, "x", _verdict(quick, (1, "healthy"), (0.5, "fair"), low="low"), short),
            m("solvency_ratio", solv, "x", _verdict(solv, (1.5, "healthy"), (1, "fair"), low="low"), f"NOT ({short}) AND liability > 0")])
    pace = lambda v, a, b: _verdict(v, (a, "fast"), (b, "normal"), low="slow")
    return union_all([
        m("asset_turnover", "revenue / asset", "x", _verdict("revenue / asset", (1, "efficient"), low="inefficient"), "revenue > 0 AND asset > 0", 4),
        m("inventory_turnover", "revenue / inventory", "x", pace("revenue / inventory", 6, 3), "revenue > 0 AND inventory > 0"),
        m("receivables_turnover", "revenue / receivable", "x", pace("revenue / receivable", 12, 6), "revenue > 0 AND receivable > 0")])


def _growth(key: str) -> str:
    by = "GROUP BY entity" if key else ""
    at = "month" if key else "{m: month, e: entity}"
    ends = lambda c: (f"(SELECT {key}COUNT({c}) AS n, ARG_MIN({c}, {at}) FILTER (WHERE {c} IS NOT NULL) AS a, "
                      f"ARG_MAX({c}, {at}) FILTER (WHERE {c} IS NOT NULL) AS z FROM books {by})")
    rev = "(z - a) * 100 / NULLIF(ABS(a), 0)"
    pro = "CASE WHEN a <> 0 THEN (z - a) * 100 / NULLIF(ABS(a), 0) WHEN z > 0 THEN 100.0 ELSE 0.0 END"
    say = lambda v: _verdict(v, (0, "growing"), low="declining")
    return union_all([
        _metric("growth", "revenue_growth", rev, "%", say(rev), "n >= 2 AND a > 0", key=key, source=ends("revenue")),
        _metric("growth", "profit_growth", pro, "%", say(pro), "n >= 2", key=key, source=ends("profit"))])


@query("latest_values", _B + "SELECT * FROM latest")
def q_latest(spark, sf):
    return fin.latest_values(_books(spark, sf), _ROLES, group_by=["entity"])


@query("latest_values_whole_table", _B1 + "SELECT * FROM latest")
def q_latest_whole(spark, sf):
    return fin.latest_values(_books(spark, sf), _ROLES, ["month", "entity"])


def _ratio_query(family: str, fn):
    name = f"{family}_ratios"

    @query(name, _B + _family(family, "entity, "))
    def run(spark, sf):
        return fn(fin.latest_values(_books(spark, sf), _ROLES, group_by=["entity"]), ["entity"])


for _fam, _fn in (("profitability", fin.profitability_ratios), ("liquidity", fin.liquidity_ratios),
                  ("efficiency", fin.efficiency_ratios)):
    _ratio_query(_fam, _fn)


@query("growth_metrics", _B + _growth("entity, "))
def q_growth(spark, sf):
    return fin.growth_metrics(_books(spark, sf), _ROLES, ["entity"])


def _all_metrics(key: str) -> str:
    return union_all([_family(f, key) for f in ("profitability", "liquidity", "efficiency")] + [_growth(key)])


def _health(key: str, base: str) -> str:
    points = " ".join(f"WHEN family = '{f}' AND verdict = '{v}' THEN {p}" for (f, v), p in POINTS.items())
    by = "GROUP BY entity" if key else ""
    return base + f"""SELECT *, CASE WHEN health_score >= 80 THEN 'excellent' WHEN health_score >= 60 THEN 'good'
WHEN health_score >= 40 THEN 'fair' WHEN health_score >= 20 THEN 'poor' ELSE 'critical' END AS health_level FROM (
SELECT {key}CAST(GREATEST(0, LEAST(100, 50 + SUM(p))) AS DOUBLE) AS health_score FROM (
SELECT {key}CASE {points} ELSE 0 END AS p FROM ({_all_metrics(key)}) UNION ALL SELECT {key}0 FROM latest) {by})"""


@query("health_score", _health("entity, ", _B))
def q_health(spark, sf):
    return fin.financial_health(_books(spark, sf), _ROLES, group_by=["entity"])["score"]


@query("health_score_whole_table", _health("", _B1))
def q_health_whole(spark, sf):
    return fin.financial_health(_books(spark, sf), _ROLES, tie_break=["entity"])["score"]


# ---- inventory: one row per part -------------------------------------------------------

_STOCK = """SELECT p_partkey AS item, p_brand AS location, p_type AS category, MAX(l_shipdate) AS date,
  CAST(CAST(SUM(l_quantity) AS BIGINT) % 100 AS DOUBLE) AS stock
FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey, p_brand, p_type"""
_S = f"WITH x AS ({_STOCK}) "
_AS_OF = datetime(2001, 12, 31)
_QS = ("(SELECT QUANTILE_CONT(stock, 0.25) AS lo, QUANTILE_CONT(stock, 0.75) AS hi, QUANTILE_CONT(stock, 0.5) AS med, "
       "QUANTILE_CONT(stock, 0.9) AS p90, AVG(stock) AS mean, COUNT(stock) AS n FROM x)")
_CLASSES = {"dead_stock": "stock = 0", "slow_moving": "stock > 0 AND stock <= lo", "fast_moving": "stock > hi AND hi > 0"}


def _stock(spark, sf):
    return _view(Tables(spark, sf), _STOCK, "part", "lineitem")


@query("stock_classes", _S + union_all([
    f"SELECT '{c}' AS \"class\", COUNT(*) FILTER (WHERE {w}) AS \"count\", {pct(f'COUNT(*) FILTER (WHERE {w})', 'COUNT(stock)')} AS pct FROM x, {_QS}"
    for c, w in _CLASSES.items()]))
def q_classes(spark, sf):
    return inv.stock_classes(_stock(spark, sf))


@query("stock_class_items", _S + union_all([
    f"SELECT * FROM (SELECT '{c}' AS \"class\", CAST(item AS VARCHAR) AS item, CAST(ROW_NUMBER() OVER (ORDER BY item) AS INTEGER) AS \"rank\" "
    f"FROM x, {_QS} WHERE {w}) WHERE \"rank\" <= 20" for c, w in _CLASSES.items()]))
def q_class_items(spark, sf):
    return inv.stock_class_items(_stock(spark, sf))


@query("stock_aging", _S + f"""SELECT bracket, COUNT(*) AS "count", {rnd('SUM(stock)')} AS total_value FROM (SELECT stock, CASE
{' '.join(f"WHEN age >= {a}{'' if b is None else f' AND age <= {b}'} THEN '{n}'" for n, a, b in AGE_BRACKETS)} END AS bracket FROM (SELECT stock,
FLOOR((EPOCH(TIMESTAMP '2001-12-31') - EPOCH(date)) / 86400) AS age FROM x WHERE stock IS NOT NULL)) WHERE bracket IS NOT NULL GROUP BY bracket""")
def q_aging(spark, sf):
    return inv.stock_aging(_stock(spark, sf), _AS_OF)


@query("reorder_suggestions", _S + f"""SELECT CAST(item AS VARCHAR) AS item, stock AS current_stock, {rnd('rp')} AS reorder_point,
CAST(FLOOR(GREATEST(mean - stock, rp * 2)) AS BIGINT) AS suggested_qty FROM (SELECT item, stock, mean, GREATEST(1.0, med * 0.3) AS rp FROM x, {_QS})
WHERE stock < rp ORDER BY x.item LIMIT 20""".replace("ORDER BY x.item", "ORDER BY CAST(item AS BIGINT)"))
def q_reorder(spark, sf):
    return inv.reorder_suggestions(_stock(spark, sf))


@query("overstock_items", _S + f"""SELECT CAST(i AS VARCHAR) AS item, stock, {rnd('p90')} AS recommended_max FROM (SELECT item AS i, stock, p90 FROM x, {_QS})
WHERE stock > p90 ORDER BY i LIMIT 20""")
def q_overstock(spark, sf):
    return inv.overstock_items(_stock(spark, sf))


@query("location_distribution", _S + f"""SELECT location, COUNT(*) AS "count", {pct('COUNT(*)', '(SELECT COUNT(location) FROM x)')} AS percentage
FROM x GROUP BY location ORDER BY "count" DESC, location LIMIT 20""")
def q_locations(spark, sf):
    return inv.location_distribution(_stock(spark, sf))


@query("stock_totals", _S + f"SELECT COUNT(*) AS items, {rnd('SUM(stock)')} AS total_stock FROM x")
def q_stock_totals(spark, sf):
    return inv.stock_totals(_stock(spark, sf))


# ---- people: customers as staff, events as time sheets -----------------------------------

_STAFF = """SELECT CONCAT('Person ', CAST(c_custkey % 1000 AS STRING)) AS employee, c_mktsegment AS department,
  CAST(c_nationkey AS STRING) AS location, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_acctbal END AS salary FROM customer"""
_SHEETS = """SELECT CONCAT('User ', CAST(user_id AS STRING)) AS employee, event_type AS attendance, ts AS date, value AS overtime,
  3000 + user_id * 10 AS salary, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS productivity FROM events"""
_P, _T = f"WITH x AS ({_STAFF}) ", f"WITH x AS ({_SHEETS}) "


def _staff(spark, sf):
    return _view(Tables(spark, sf), _STAFF, "customer")


def _sheets(spark, sf):
    return _view(Tables(spark, sf), _SHEETS, "events")


@query("salary_stats", _P + f"""SELECT {rnd('AVG(salary)')} AS "avg", {rnd('QUANTILE_CONT(salary, 0.5)')} AS "median", {rnd('MIN(salary)')} AS "min",
{rnd('MAX(salary)')} AS "max", {rnd('MAX(salary) - MIN(salary)')} AS "range", {rnd('STDDEV_SAMP(salary)')} AS std_dev, {rnd('SUM(salary)')} AS total FROM x""")
def q_salary(spark, sf):
    return ppl.salary_stats(_staff(spark, sf))


@query("salary_by_department", _P + f"""SELECT department, {rnd('AVG(salary)')} AS "avg", {rnd('QUANTILE_CONT(salary, 0.5)')} AS "median",
COUNT(salary) AS "count" FROM x GROUP BY department""")
def q_salary_dept(spark, sf):
    return ppl.salary_by_department(_staff(spark, sf))


@query("headcount", _P + """SELECT COUNT(*) AS total, COUNT(DISTINCT employee) AS unique_employees,
COUNT(DISTINCT employee) < COUNT(*) AS has_duplicates FROM x""")
def q_headcount(spark, sf):
    return ppl.headcount(_staff(spark, sf))


@query("headcount_by_department", _P + 'SELECT department, COUNT(*) AS "count" FROM x GROUP BY 1')
def q_headcount_dept(spark, sf):
    return ppl.headcount_by(_staff(spark, sf), "department")


@query("headcount_by_location", _P + 'SELECT location, COUNT(*) AS "count" FROM x GROUP BY 1')
def q_headcount_loc(spark, sf):
    return ppl.headcount_by(_staff(spark, sf), "location")


@query("overtime_stats", _T + f"""SELECT {rnd('SUM(overtime)')} AS total_hours, {rnd('AVG(overtime)')} AS avg_hours,
{rnd('MAX(overtime)')} AS max_hours FROM x""")
def q_overtime(spark, sf):
    return ppl.overtime_stats(_sheets(spark, sf))


@query("overtime_by_employee", _T + f"""SELECT employee, {rnd('h')} AS total_hours FROM (SELECT employee, SUM(overtime) AS h FROM x GROUP BY 1)
ORDER BY h DESC, employee LIMIT 20""")
def q_overtime_employee(spark, sf):
    return ppl.overtime_by_employee(_sheets(spark, sf))


@query("overtime_cost", _T + f"SELECT {rnd(rnd('AVG(salary)') + ' / 173 * SUM(overtime) * 1.5')} AS estimated_cost FROM x")
def q_overtime_cost(spark, sf):
    return ppl.overtime_cost(_sheets(spark, sf))


@query("attendance_distribution", _T + """SELECT (SELECT COUNT(DISTINCT attendance) FROM x) AS unique_values, attendance AS "value", COUNT(*) AS "count"
FROM x GROUP BY attendance ORDER BY "count" DESC, "value" LIMIT 10""")
def q_attendance(spark, sf):
    return ppl.attendance_distribution(_sheets(spark, sf))


@query("attendance_monthly", _T + """SELECT CAST(DATE_TRUNC('month', date) AS TIMESTAMP) AS month, attendance AS "value", COUNT(*) AS "count"
FROM x GROUP BY 1, 2""")
def q_attendance_month(spark, sf):
    return ppl.attendance_monthly(_sheets(spark, sf))


_DUPS = 'SELECT employee AS name, COUNT(*) AS "count" FROM x GROUP BY 1 HAVING COUNT(*) > 1 ORDER BY "count" DESC, name LIMIT 20'


@query("duplicate_employees", _P + _DUPS)
def q_duplicates(spark, sf):
    return ppl.duplicate_employees(_staff(spark, sf))


@query("duplicate_employee_rows", _P + f"SELECT employee AS name, salary, department FROM x WHERE employee IN (SELECT name FROM ({_DUPS}))")
def q_duplicate_rows(spark, sf):
    return ppl.duplicate_employee_rows(_staff(spark, sf))


@query("productivity_stats", _T + f"""SELECT {rnd('AVG(productivity)')} AS "avg", {rnd('QUANTILE_CONT(productivity, 0.5)')} AS "median",
{rnd('MIN(productivity)')} AS "min", {rnd('MAX(productivity)')} AS "max" FROM x""")
def q_productivity(spark, sf):
    return ppl.productivity_stats(_sheets(spark, sf))


_SCORES = "(SELECT employee, AVG(productivity) AS s FROM x GROUP BY 1 HAVING AVG(productivity) IS NOT NULL)"


@query("top_bottom_performers", _T + f"""SELECT * FROM (SELECT 'top' AS "group", employee, {rnd('s')} AS score FROM {_SCORES} ORDER BY s DESC, employee LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'bottom', employee, {rnd('s')} FROM {_SCORES} ORDER BY s, employee DESC LIMIT 5)""")
def q_performers(spark, sf):
    return ppl.top_bottom_performers(_sheets(spark, sf))
