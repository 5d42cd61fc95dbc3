"""Queries for regression and forecasting."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlore.functions.numeric import rounded
from gridlore.operators import forecast as fc, regression as reg
from gridlore.queries.core import union_all
from gridlore.queries.registry import Tables, query, rnd

_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_DRAW = ("CAST(('0x' || SUBSTR(MD5(CONCAT_WS('|', l_orderkey, l_partkey, l_suppkey, l_linenumber)), 1, 8)) AS UBIGINT) "
         "/ 4294967296.0")
_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]


def _lines(spark, sf):
    return Tables(spark, sf).lineitem


@query("train_test_split", f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN {_DRAW} >= 0.3 THEN 'train' ELSE 'test' END AS side
FROM lineitem""")
def q_split(spark, sf):
    train, test = reg.train_test_split(_lines(spark, sf).select(*_KEY), _KEY)
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


@query("prepare_features", """WITH codes AS (SELECT l_returnflag, ROW_NUMBER() OVER (ORDER BY l_returnflag) - 1 AS code FROM
(SELECT DISTINCT l_returnflag FROM lineitem WHERE l_quantity <> 50))
SELECT l_orderkey, l_linenumber, l_quantity AS f_0, CAST(code AS DOUBLE) AS f_1, l_extendedprice AS target
FROM lineitem JOIN codes USING (l_returnflag) WHERE l_quantity <> 50""")
def q_prepare(spark, sf):
    table = _lines(spark, sf).withColumn("l_quantity", F.expr("nullif(l_quantity, 50.0)"))
    ready = reg.prepare_features(table, "l_extendedprice", ["l_quantity", "l_returnflag"])
    return ready.rows.select("l_orderkey", "l_linenumber", "f_0", "f_1", F.col("__target").alias("target"))


def _linear(spark, sf):
    return reg.train(_lines(spark, sf), "l_extendedprice", ["l_quantity"], "linear", _KEY)


_FIT = f"""WITH fit AS (SELECT REGR_SLOPE(l_extendedprice, l_quantity) AS b, REGR_INTERCEPT(l_extendedprice, l_quantity) AS a
FROM lineitem WHERE {_DRAW} >= 0.3) """


@query("train_linear", _FIT + f"SELECT 'l_quantity' AS term, {rnd('b', 4)} AS \"value\" FROM fit UNION ALL SELECT 'intercept', {rnd('a', 4)} FROM fit")
def q_linear(spark, sf):
    return reg.coefficients(_linear(spark, sf)).withColumn("value", rounded(F.col("value"), 4))


@query("predict_linear", _FIT + f"SELECT l_orderkey, l_linenumber, l_partkey, {rnd('a + b * l_quantity', 2)} AS predicted FROM lineitem, fit")
def q_predict(spark, sf):
    out = reg.predict(_linear(spark, sf), _lines(spark, sf))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", rounded(F.col("predicted"), 2).alias("predicted"))


@query("actual_vs_predicted", _FIT + f"""SELECT l_extendedprice AS actual, {rnd('a + b * l_quantity', 2)} AS predicted FROM lineitem, fit
WHERE {_DRAW} < 0.3""")
def q_pairs(spark, sf):
    return reg.actual_vs_predicted(_linear(spark, sf)).withColumn("predicted", rounded(F.col("predicted"), 2))


@query("model_metrics", _FIT + f"""SELECT COUNT(*) AS n, {rnd('AVG(ABS(e))', 2)} AS mae, {rnd('SQRT(AVG(e * e))', 2)} AS rmse,
{rnd('1 - SUM(e * e) / (VAR_POP(y) * COUNT(*))', 4)} AS r2 FROM (SELECT l_extendedprice AS y, l_extendedprice - (a + b * l_quantity) AS e
FROM lineitem, fit WHERE {_DRAW} < 0.3)""")
def q_model_metrics(spark, sf):
    out = reg.model_metrics(_linear(spark, sf))
    return out.withColumns({c: rounded(F.col(c), 2) for c in ("mae", "rmse")})


@query("regression_metrics", f"""SELECT COUNT(*) AS n, {rnd('AVG(ABS(e))', 4)} AS mae, {rnd('SQRT(AVG(e * e))', 4)} AS rmse,
{rnd('1 - SUM(e * e) / (VAR_POP(y) * COUNT(*))', 4)} AS r2 FROM (SELECT l_extendedprice AS y, l_extendedprice - l_quantity * 1500 AS e FROM lineitem)""")
def q_metrics(spark, sf):
    table = _lines(spark, sf).select("l_extendedprice", (F.col("l_quantity") * 1500).alias("guess"))
    return reg.regression_metrics(table, "l_extendedprice", "guess")


def _solved(features: list[str], rows: str) -> tuple[str, str]:
    """SQL of the least-squares slopes w1, w2, ... by elimination on the covariances of ``rows``
    (x1, x2, ..., y), and the name of the row that has them."""
    n = range(1, len(features) + 1)
    cells = [f"COVAR_POP(x{i}, x{j}) AS a{i}{j}" for i in n for j in n] + [f"COVAR_POP(x{i}, y) AS b{i}" for i in n]
    steps = [f"e0 AS (SELECT {', '.join(cells)} FROM ({rows}))"]
    for k in n[:-1]:
        cells = []
        for i in n:
            less = f" - a{i}{k} / a{k}{k} * " if i > k else None
            cells += [(f"a{i}{j}{less}a{k}{j} AS a{i}{j}" if less else f"a{i}{j}") for j in n]
            cells.append(f"b{i}{less}b{k} AS b{i}" if less else f"b{i}")
        steps.append(f"e{k} AS (SELECT {', '.join(cells)} FROM e{k - 1})")
    last = f"e{len(n) - 1}"
    for i in reversed(n):
        known = "".join(f" - a{i}{j} * w{j}" for j in n if j > i)
        steps.append(f"s{i} AS (SELECT *, (b{i}{known}) / a{i}{i} AS w{i} FROM {last})")
        last = f"s{i}"
    return "WITH " + ", ".join(steps), last


_CODED = f"""SELECT l_quantity AS x1, l_discount AS x2, l_tax AS x3, CAST(code AS DOUBLE) AS x4, l_extendedprice AS y FROM lineitem JOIN
(SELECT l_returnflag, ROW_NUMBER() OVER (ORDER BY l_returnflag) - 1 AS code FROM (SELECT DISTINCT l_returnflag FROM lineitem)) USING (l_returnflag)
WHERE {_DRAW} >= 0.3"""
_WEIGHTS, _LAST = _solved(_FEATURES, _CODED)
_ALL_WEIGHTS = " + ".join(f"ABS(w{i})" for i in range(1, len(_FEATURES) + 1))


@query("feature_importance_linear", f"{_WEIGHTS} " + union_all([
    f"SELECT '{f}' AS feature, {rnd(f'ABS(w{i}) / ({_ALL_WEIGHTS}) * 100')} AS importance FROM {_LAST}" for i, f in enumerate(_FEATURES, 1)]))
def q_importance(spark, sf):
    return reg.feature_importance(reg.train(_lines(spark, sf), "l_extendedprice", _FEATURES, "linear", _KEY))


@query("train_boosted_trees")
def q_boosted(spark, sf):
    model = reg.train(_lines(spark, sf), "l_extendedprice", _FEATURES, "gbt", _KEY)
    return reg.feature_importance(model).select(F.col("feature").alias("name"), F.col("importance").alias("value")).unionByName(
        reg.model_metrics(model).select(F.inline(F.array(*[
            F.struct(F.lit(m).alias("name"), F.col(m).alias("value")) for m in ("mae", "rmse", "r2")]))))


# ---- forecasting -------------------------------------------------------------------------

_DAILY = """SELECT DATE_TRUNC('day', ts) AS ds, CAST(SUM(CAST(value AS DECIMAL(14,2))) AS DOUBLE) AS y FROM events GROUP BY 1"""
_NATIONS = """SELECT n_name, DATE_TRUNC('month', o_orderdate) AS ds, CAST(SUM(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS y
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"""
_FIRSTS = """SELECT * EXCLUDE (r) FROM (SELECT user_id, CAST(DATE_TRUNC('day', ts) AS TIMESTAMP) AS ds, CAST(value AS DOUBLE) AS y,
ROW_NUMBER() OVER (PARTITION BY user_id, DATE_TRUNC('day', ts) ORDER BY ts, event_id) AS r FROM events) WHERE r = 1"""


def _daily(spark, sf):
    return fc.prepare_series(Tables(spark, sf).events, "ts", "value", agg="sum")


def _nation_rows(spark, sf):
    t = Tables(spark, sf)
    return (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("n_name", "o_orderdate", "o_totalprice"))


def _nations(spark, sf):
    return fc.prepare_series(_nation_rows(spark, sf), "o_orderdate", "o_totalprice", ["n_name"], "month", "sum")


def _cents(df, *cols):
    return df.withColumns({c: rounded(F.col(c), 2) for c in cols})


@query("prepare_series_first", _FIRSTS)
def q_series_first(spark, sf):
    return fc.prepare_series(Tables(spark, sf).events, "ts", "value", ["user_id"], order_by=["event_id"])


@query("prepare_series_sum", f"SELECT n_name, CAST(ds AS TIMESTAMP) AS ds, {rnd('y')} AS y FROM ({_NATIONS})")
def q_series_sum(spark, sf):
    return _cents(_nations(spark, sf), "y")


_GAPS = "SELECT {k}ds, y, EPOCH(ds) - EPOCH(LAG(ds) OVER ({p}ORDER BY ds)) AS gap, ROW_NUMBER() OVER ({p}ORDER BY ds) - 1 AS pos FROM ({s})"


def _gaps(series: str, key: str = "") -> str:
    return _GAPS.format(k=f"{key}, " if key else "", p=f"PARTITION BY {key} " if key else "", s=series)


def _freq_sql(series: str, key: str = "") -> str:
    k, by = (f"{key}, ", f"GROUP BY {key}") if key else ("", "")
    return f"""SELECT {k}COUNT(*) AS points, CASE WHEN COUNT(gap) = 0 OR QUANTILE_CONT(gap, 0.5) <= 172800 THEN 'D'
WHEN QUANTILE_CONT(gap, 0.5) <= 864000 THEN 'W' ELSE 'M' END AS frequency FROM ({_gaps(series, key)}) {by}"""


@query("detect_frequency", _freq_sql(_DAILY))
def q_frequency(spark, sf):
    return fc.detect_frequency(_daily(spark, sf))


_CUSTOMERS = "SELECT o_custkey, DATE_TRUNC('day', o_orderdate) AS ds, SUM(o_totalprice) AS y FROM orders GROUP BY 1, 2"


def _customer_series(spark, sf):
    return fc.prepare_series(Tables(spark, sf).orders, "o_orderdate", "o_totalprice", ["o_custkey"], agg="sum")


@query("detect_frequency_by_key", _freq_sql(_CUSTOMERS, "o_custkey"))
def q_frequency_key(spark, sf):
    return fc.detect_frequency(_customer_series(spark, sf), ["o_custkey"])


@query("forecast_method_choice", f"""SELECT *, CASE WHEN points >= CASE frequency WHEN 'D' THEN 14 WHEN 'W' THEN 4 ELSE 2 END THEN 'seasonal'
ELSE 'linear' END AS method FROM ({_freq_sql(_CUSTOMERS, 'o_custkey')})""")
def q_choice(spark, sf):
    return fc.method_choice(_customer_series(spark, sf), ["o_custkey"])


def _linear_sql(series: str, key: str = "") -> str:
    k, by = (f"{key}, ", f"GROUP BY {key}") if key else ("", "")
    part = f"PARTITION BY {key} " if key else ""
    join = f"USING ({key})" if key else "ON TRUE"
    y = "(a + b * (n - 1 + i))"
    return f"""WITH g AS ({_gaps(series, key)}),
fit AS (SELECT {k}COUNT(*) AS n, COALESCE(REGR_SLOPE(y, pos), 0) AS b, COALESCE(REGR_INTERCEPT(y, pos), AVG(y)) AS a, EPOCH(MAX(ds)) AS last FROM g {by}),
step AS (SELECT {k}gap FROM (SELECT {k}gap, ROW_NUMBER() OVER ({part}ORDER BY COUNT(*) DESC, gap) AS r FROM g WHERE gap IS NOT NULL GROUP BY {k}gap)
WHERE r = 1)
SELECT {k}CAST(MAKE_TIMESTAMP(CAST((last + COALESCE(gap, 2592000) * i) * 1000000 AS BIGINT)) AS TIMESTAMP) AS ds, {rnd(y)} AS yhat,
{rnd(y + ' * 0.9')} AS yhat_lower, {rnd(y + ' * 1.1')} AS yhat_upper FROM fit LEFT JOIN step {join}, (SELECT UNNEST(RANGE(1, 13)) AS i)"""


@query("linear_forecast", _linear_sql(_DAILY))
def q_forecast_line(spark, sf):
    return _cents(fc.linear_forecast(_daily(spark, sf)), "yhat", "yhat_lower", "yhat_upper")


@query("linear_forecast_by_key", _linear_sql(_NATIONS, "n_name"))
def q_forecast_lines(spark, sf):
    return _cents(fc.linear_forecast(_nations(spark, sf), keys=["n_name"]), "yhat", "yhat_lower", "yhat_upper")


@query("forecast_metrics_by_key", f"""WITH g AS ({_gaps(_NATIONS, 'n_name')}), fit AS (SELECT n_name, REGR_SLOPE(y, pos) AS b, REGR_INTERCEPT(y, pos) AS a
FROM g GROUP BY n_name) SELECT n_name, {rnd('AVG(ABS(e))')} AS mae, {rnd('SQRT(AVG(e * e))')} AS rmse, {rnd('AVG(ABS(e / y)) * 100', 4)} AS mape
FROM (SELECT n_name, y, y - (a + b * pos) AS e FROM g JOIN fit USING (n_name)) GROUP BY n_name""")
def q_forecast_metrics(spark, sf):
    fitted = fc.linear_fitted(_nations(spark, sf), ["n_name"])
    return _cents(fc.forecast_metrics(fitted, keys=["n_name"]), "mae", "rmse")


@query("forecast_history", f"SELECT CAST(ds AS TIMESTAMP) AS ds, {rnd('y')} AS y FROM ({_DAILY})")
def q_history(spark, sf):
    return _cents(fc.forecast_history(_daily(spark, sf)), "y")


@query("seasonal_forecast_by_key")
def q_seasonal(spark, sf):
    return fc.seasonal_forecast(_nations(spark, sf), keys=["n_name"])


@query("forecast_components_by_key")
def q_components(spark, sf):
    return fc.forecast_components(_nations(spark, sf), keys=["n_name"])


@query("forecast_many_series")
def q_many(spark, sf):
    return fc.forecast(Tables(spark, sf).orders, "o_orderdate", "o_totalprice", keys=["o_custkey"], agg="sum")["forecast"]
