"""Sales queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlore.operators import sales as ops
from gridlore.operators.product_pairs import cross_sell_pairs
from gridlore.queries.inputs import SALES, sales_input
from gridlore.queries.registry import Tables, pct, query, rnd


@query("top_customers", f"""WITH {SALES},
g AS (SELECT customer, SUM(revenue) AS rev FROM sales GROUP BY customer)
SELECT customer AS name, {rnd('rev')} AS revenue,
       {pct('rev', '(SELECT SUM(rev) FROM g)')} AS pct_total
FROM g ORDER BY rev DESC, customer LIMIT 20""")
def q_top_customers(spark, sf):
    return ops.top_customers(sales_input(Tables(spark, sf), "customer", "revenue"))


@query("customer_segments", f"""WITH {SALES},
g AS (SELECT customer, CAST(SUM(revenue) AS DOUBLE) AS rev FROM sales GROUP BY customer),
m AS (SELECT AVG(rev) AS mean, SUM(rev) AS total, COUNT(*) AS n FROM g),
names(segment) AS (VALUES ('high'), ('medium'), ('low')),
c AS (SELECT CASE WHEN rev > mean * 2 THEN 'high' WHEN rev > mean * 0.5 THEN 'medium'
             ELSE 'low' END AS segment, rev FROM g, m)
SELECT names.segment, COUNT(rev) AS customers,
       {pct('COUNT(rev)', '(SELECT n FROM m)')} AS pct_customers,
       {pct('COALESCE(SUM(rev), 0)', '(SELECT total FROM m)')} AS pct_revenue
FROM names LEFT JOIN c USING (segment) GROUP BY names.segment""")
def q_segments(spark, sf):
    return ops.customer_segments(sales_input(Tables(spark, sf), "customer", "revenue"))


@query("pareto_share", f"""WITH {SALES},
g AS (SELECT customer, SUM(revenue) AS rev FROM sales GROUP BY customer),
r AS (SELECT CAST(SUM(rev) OVER (ORDER BY rev DESC, customer ROWS UNBOUNDED PRECEDING) AS DOUBLE)
             AS running, CAST(SUM(rev) OVER () AS DOUBLE) AS total FROM g)
SELECT COUNT(*) AS customers, COUNT(*) FILTER (WHERE running <= total * 0.8) AS top_customers,
       {pct('COUNT(*) FILTER (WHERE running <= total * 0.8)', 'COUNT(*)')} AS pct_customers
FROM r""")
def q_pareto(spark, sf):
    return ops.pareto_share(sales_input(Tables(spark, sf), "customer", "revenue"))


def _trend_sql(source: str, grain: str) -> str:
    return f"""WITH {source},
p AS (SELECT DATE_TRUNC('{grain}', date) AS period, SUM(revenue) AS s FROM x GROUP BY 1),
l AS (SELECT period, CAST(s AS DOUBLE) AS s,
             CAST(LAG(s) OVER (ORDER BY period) AS DOUBLE) AS prev FROM p)
SELECT '{grain}' AS grain, CAST(period AS TIMESTAMP) AS period, {rnd('s')} AS revenue,
       CASE WHEN prev > 0 THEN {pct('(s - prev)', 'prev')} END AS growth FROM l"""


_ORDERS = ("x AS (SELECT o_orderdate AS date, CAST(o_totalprice AS DECIMAL(14,2)) AS revenue "
           "FROM orders)")
_QUARTER = ("x AS (SELECT o_orderdate AS date, CAST(o_totalprice AS DECIMAL(14,2)) AS revenue "
            "FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' "
            "AND o_orderdate < TIMESTAMP '1996-04-01')")
_EVENTS = "x AS (SELECT ts AS date, CAST(value AS DECIMAL(14,2)) AS revenue FROM events)"


def _orders(t: Tables):
    return t.orders.select(F.col("o_orderdate").alias("date"),
                           F.col("o_totalprice").cast("decimal(14,2)").alias("revenue"))


def _events(t: Tables):
    return t.events.select(F.col("ts").alias("date"),
                           F.col("value").cast("decimal(14,2)").alias("revenue"))


@query("sales_trend_monthly", _trend_sql(_ORDERS, "month"))
def q_trend_month(spark, sf):
    return ops.sales_trend(_orders(Tables(spark, sf)))


@query("sales_trend_weekly", _trend_sql(_QUARTER, "week"))
def q_trend_week(spark, sf):
    quarter = _orders(Tables(spark, sf)).where(
        "date >= timestamp'1996-01-01' and date < timestamp'1996-04-01'")
    return ops.sales_trend(quarter)


@query("sales_trend_daily", _trend_sql(_EVENTS, "day"))
def q_trend_day(spark, sf):
    return ops.sales_trend(_events(Tables(spark, sf)))


@query("sales_trend_direction", f"""WITH t AS ({_trend_sql(_ORDERS, 'month')})
SELECT MAX(grain) AS grain, COUNT(growth) AS periods, {rnd('AVG(growth)')} AS avg_growth,
       CASE WHEN AVG(growth) > 2 THEN 'rising' WHEN AVG(growth) > -2 THEN 'stable'
            WHEN AVG(growth) IS NOT NULL THEN 'falling' END AS direction FROM t""")
def q_direction(spark, sf):
    return ops.trend_direction(ops.sales_trend(_orders(Tables(spark, sf))))


@query("product_performance", f"""WITH {SALES},
g AS (SELECT product, SUM(revenue) AS rev, SUM(profit) AS won FROM sales GROUP BY product)
SELECT product, {rnd('rev')} AS revenue, {rnd('won')} AS profit,
       CASE WHEN rev > 0 THEN {pct('won', 'rev')} END AS margin,
       {pct('rev', '(SELECT SUM(rev) FROM g)')} AS pct_total
FROM g ORDER BY rev DESC, product LIMIT 20""")
def q_products(spark, sf):
    return ops.product_performance(sales_input(Tables(spark, sf), "product", "revenue", "profit"), profit="profit")


@query("regional_analysis", f"""WITH {SALES},
g AS (SELECT region, SUM(revenue) AS rev, COUNT(revenue) AS n FROM sales GROUP BY region)
SELECT region, {rnd('rev')} AS revenue, n AS count,
       {pct('rev', '(SELECT SUM(rev) FROM g)')} AS pct_revenue
FROM g ORDER BY rev DESC, region LIMIT 20""")
def q_regions(spark, sf):
    return ops.regional_analysis(sales_input(Tables(spark, sf), "region", "revenue"))


def _pairs_sql(item: str) -> str:
    return f"""WITH {SALES},
b AS (SELECT DISTINCT customer, {item} AS item FROM sales)
SELECT a.item AS product_1, c.item AS product_2, COUNT(*) AS frequency
FROM b a JOIN b c ON a.customer = c.customer AND a.item < c.item
GROUP BY 1, 2 ORDER BY frequency DESC, product_1, product_2 LIMIT 10"""


@query("cross_sell_pairs", _pairs_sql("product"))
def q_pairs(spark, sf):
    return cross_sell_pairs(sales_input(Tables(spark, sf), "customer", "product"))


@query("cross_sell_pairs_parts", """WITH
b AS (SELECT DISTINCT o_custkey AS customer, CAST(l_partkey AS VARCHAR) AS item
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT a.item AS product_1, c.item AS product_2, COUNT(*) AS frequency
FROM b a JOIN b c ON a.customer = c.customer AND a.item < c.item
GROUP BY 1, 2 ORDER BY frequency DESC, product_1, product_2 LIMIT 10""")
def q_pairs_parts(spark, sf):
    t = Tables(spark, sf)
    bought = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return cross_sell_pairs(bought, "o_custkey", "l_partkey")


@query("sales_totals", f"""WITH {SALES}
SELECT {rnd('SUM(revenue)')} AS total_revenue, COUNT(*) AS transactions FROM sales""")
def q_totals(spark, sf):
    return ops.sales_totals(sales_input(Tables(spark, sf), "revenue"))
