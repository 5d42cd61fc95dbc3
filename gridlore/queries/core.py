"""Queries for sources, typing, ad-hoc SQL and profiling."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridlore.functions.numeric import rounded
from gridlore.operators import audit as aud, profile as prof, sales as sales_ops, tables as tab
from gridlore.queries.inputs import SALES, sales_input
from gridlore.queries.registry import ORACLE, Tables, pct, query, rnd
from gridlore.session import shared_dir
from gridlore.sources import history, tables as src
from gridlore.sources.raw import read_raw


def union_all(parts) -> str:
    return "\nUNION ALL\n".join(parts)


# ---- sources -------------------------------------------------------------------------

_TEXT = """SELECT l_orderkey, l_linenumber,
  CAST(l_quantity AS STRING) AS quantity,
  CASE WHEN l_linenumber <= 5 THEN CAST(l_extendedprice AS STRING) ELSE 'n/a' END AS price,
  CASE WHEN l_linenumber <= 2 THEN CAST(l_tax AS STRING) ELSE 'n/a' END AS tax,
  CAST(l_shipdate AS STRING) AS shipped,
  CASE WHEN l_quantity = 50 AND l_linenumber = 1 THEN '7' END AS rare
FROM lineitem"""


def _text_table(t: Tables):
    t.lineitem.createOrReplaceTempView("lineitem")
    return t.spark.sql(_TEXT)


def _coerced(shipped: str) -> str:
    return f"""SELECT l_orderkey, l_linenumber, l_quantity AS quantity,
  CASE WHEN l_linenumber <= 5 THEN l_extendedprice END AS price,
  CASE WHEN l_linenumber <= 2 THEN CAST(l_tax AS VARCHAR) ELSE 'n/a' END AS tax,
  {shipped} AS shipped,
  CASE WHEN l_quantity = 50 AND l_linenumber = 1 THEN '7' END AS rare FROM lineitem"""


@query("coerce_types", _coerced("l_shipdate"))
def q_coerce(spark, sf):
    return src.coerce_types(_text_table(Tables(spark, sf)))


@query("coerce_types_numbers_only", _coerced("CAST(l_shipdate AS VARCHAR)"))
def q_coerce_numbers(spark, sf):
    return src.coerce_types(_text_table(Tables(spark, sf)), dates=False)


def new_folder(spark) -> str:
    return f"{shared_dir(spark)}/gridlore-{uuid.uuid4().hex}"


@query("csv_write_read", """SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CAST(c_nationkey AS BIGINT)
AS c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def q_csv(spark, sf):
    folder = new_folder(spark)
    src.write_table(Tables(spark, sf).customer, folder, "csv")
    return src.read_table(spark, folder, "csv")


def _quoted_text(c: str):
    return F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))


#: Bytes of text in a file that a query writes.
FILE_BYTES = 1 << 25


def _document_files(spark, sf, header: bool) -> str:
    """Documents as delimited text in several files, in order of language and id: texts with
    their commas, quotes and line breaks; a cell too many or too few in some rows. With headers
    there is a folder per language, whose first file begins with the header. Files are parts of
    some FILE_BYTES of the order, so that none is written by one task for all."""
    folder = new_folder(spark)
    docs = Tables(spark, sf).documents.where("doc_id is not null")
    extra = F.when(F.col("doc_id") % 7 == 0, F.lit("more, or less"))
    last = F.when(F.col("doc_id") % 11 != 0, F.col("lang"))
    lines = docs.select("lang", "doc_id", F.concat_ws(
        ",", F.col("doc_id").cast("string"), _quoted_text("text"), last, F.when(extra.isNotNull(), F.concat(F.lit('"'), extra, F.lit('"')))).alias("line"))
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 32)).first()[0] or 0
    files = max(4, -(-size // FILE_BYTES))
    if header:
        names = docs.select("lang").distinct().select("lang", F.lit(None).cast("bigint").alias("doc_id"), F.lit("doc_id,text,lang").alias("line"))
        lines = lines.unionByName(names)
        order = [F.col("lang"), F.col("doc_id").asc_nulls_first()]
        spread = lines.repartitionByRange(files, *order).sortWithinPartitions(*order)
        spread.select("lang", "line").write.partitionBy("lang").text(folder)
    else:
        spread = lines.repartitionByRange(files, "lang", "doc_id").sortWithinPartitions("lang", "doc_id")
        spread.select("line").write.text(folder)
    return folder


_RAGGED = "3 + (doc_id % 7 = 0)::BIGINT - (doc_id % 11 = 0)::BIGINT"


@query("read_raw_files", f"""SELECT ROW_NUMBER() OVER (ORDER BY lang, doc_id) - 1 AS row_no, CAST(doc_id AS VARCHAR) AS first_cell, text AS second_cell,
CASE WHEN doc_id % 7 = 0 THEN 'more, or less' WHEN doc_id % 11 = 0 THEN text ELSE lang END AS last_cell, CAST({_RAGGED} AS INTEGER) AS width
FROM documents WHERE doc_id IS NOT NULL""")
def q_raw_files(spark, sf):
    raw = read_raw(spark, _document_files(spark, sf, False))
    cell = lambda i: F.element_at("cells", i)
    return raw.select("row_no", cell(1).alias("first_cell"), cell(2).alias("second_cell"), cell(-1).alias("last_cell"), F.size("cells").alias("width"))


@query("audit_ragged_files", f"""WITH rows AS (
  SELECT lang, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY doc_id) AS i, {_RAGGED} AS width FROM documents WHERE doc_id IS NOT NULL)
SELECT 'medium' AS severity, 'inconsistent_columns' AS category, lang AS sheet, CAST(NULL AS VARCHAR) AS "column",
i AS row_from, i AS row_to, width AS n FROM rows WHERE width <> 3""")
def q_ragged_files(spark, sf):
    raw = read_raw(spark, _document_files(spark, sf, True))
    return aud.ragged_rows(raw, F.regexp_extract("file", "lang=([^/]*)/", 1), continued=True)


@query("csv_surplus_cells", """SELECT CAST(c_custkey AS BIGINT) AS key, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN 'kept, too' END AS "Column_2",
CASE WHEN c_custkey % 10 = 0 THEN CAST(c_nationkey AS VARCHAR) END AS "Column_3", ROW_NUMBER() OVER (ORDER BY c_custkey) - 1 AS row_no FROM customer""")
def q_csv_surplus(spark, sf):
    folder = new_folder(spark)
    more = F.when(F.col("c_custkey") % 5 == 0, F.lit('"kept, too"'))
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", more, F.when(F.col("c_custkey") % 10 == 0, F.col("c_nationkey").cast("string")))
    lines = Tables(spark, sf).customer.select("c_custkey", line.alias("line"))
    head = spark.range(1).select(F.lit(None).cast("bigint").alias("c_custkey"), F.lit("key,name").alias("line"))
    lines.unionByName(head).coalesce(1).sortWithinPartitions(F.col("c_custkey").asc_nulls_first()).select("line").write.text(folder)
    return src.read_table(spark, folder, "csv", row_no=True)


@query("parquet_write_read", """SELECT o_orderkey, o_orderdate,
CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS price FROM orders""")
def q_parquet(spark, sf):
    folder = new_folder(spark)
    nan = F.when(F.col("o_orderstatus") == "F", F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    table = Tables(spark, sf).orders.select("o_orderkey", "o_orderdate", nan.alias("price"))
    src.write_table(table, folder, "parquet")
    return src.read_table(spark, folder, "parquet")


_ROW_NO = """SELECT o_orderkey, (ROW_NUMBER() OVER (ORDER BY CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2
ELSE 3 END, o_orderkey) - 1)::BIGINT AS row_no FROM orders"""


def _numbered(spark, sf, fmt):
    """Orders in three files of unequal size, one per status, read with row numbers."""
    folder, orders = new_folder(spark), Tables(spark, sf).orders
    for i, only in enumerate(("o_orderstatus = 'F'", "o_orderstatus = 'O'", "o_orderstatus NOT IN ('F', 'O')")):
        part = orders.where(only).select("o_orderkey", "o_totalprice").orderBy("o_orderkey")
        src.write_table(part.coalesce(1), f"{folder}/part={i}", fmt)
    return src.read_table(spark, folder, fmt, row_no=True).select("o_orderkey", "row_no")


@query("read_table_row_no", _ROW_NO)
def q_row_no(spark, sf):
    return _numbered(spark, sf, "parquet")


@query("read_table_row_no_csv", _ROW_NO)
def q_row_no_csv(spark, sf):
    return _numbered(spark, sf, "csv")


@query("coerce_types_dates", """SELECT o_orderkey, CAST(o_orderdate AS DATE)::TIMESTAMP AS month_first,
CAST(o_orderdate AS DATE)::TIMESTAMP AS day_first, CAST(o_orderdate AS DATE)::TIMESTAMP AS dotted FROM orders""")
def q_coerce_dates(spark, sf):
    form = lambda pattern, name: F.date_format("o_orderdate", pattern).alias(name)
    return src.coerce_types(Tables(spark, sf).orders.select(
        "o_orderkey", form("MM/dd/yyyy", "month_first"), form("d/M/yyyy", "day_first"), form("dd.MM.yyyy", "dotted")))


_BOOK = ("region", "nation", "customer", "orders")


@query("read_workbook", union_all([
    f"SELECT '{n}' AS \"table\", CAST({k} AS BIGINT) AS columns, COUNT(*) AS \"rows\", '{c}' AS max_column, "
    f"CAST(MAX({c}) AS DOUBLE) AS max_value FROM {n}"
    for n, k, c in (("region", 2, "r_regionkey"), ("nation", 3, "n_nationkey"), ("customer", 5, "c_custkey"),
                    ("orders", 6, "o_orderkey"))]))
def q_workbook(spark, sf):
    book = src.read_workbook(spark, {n: f"{sf}/{n}.parquet" for n in _BOOK})
    return prof.table_dimensions(book)


@query("table_dimensions", ORACLE["read_workbook"])
def q_dimensions(spark, sf):
    t = Tables(spark, sf)
    return prof.table_dimensions({n: getattr(t, n) for n in _BOOK})


@query("load_saved", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def q_load_saved(spark, sf):
    Tables(spark, sf).orders.createOrReplaceTempView("saved_orders")
    return src.load_saved(spark, "saved_orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("save_result_read_history", f"""WITH {SALES},
g AS (SELECT region, SUM(revenue) AS rev FROM sales GROUP BY region)
SELECT 'sales' AS sheet_name, 'regional' AS analysis_type, region, {rnd('rev')} AS revenue
FROM g ORDER BY rev DESC, region LIMIT 20""")
def q_history(spark, sf):
    folder = new_folder(spark)
    t = Tables(spark, sf)
    history.save_result(prof.group_agg(t.orders, "o_orderstatus", "o_totalprice"), folder, "orders", "totals")
    history.save_result(sales_ops.regional_analysis(sales_input(t, "region", "revenue")), folder, "sales", "regional")
    rows = history.read_history(spark, folder, "regional")
    body = F.from_json("result_json", "region string, revenue double")
    return rows.select("sheet_name", "analysis_type", body["region"].alias("region"),
                       body["revenue"].alias("revenue"))


# ---- projection, typing, SQL -----------------------------------------------------------


@query("range_filter", """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
WHERE l_quantity BETWEEN 10 AND 20""")
def q_range(spark, sf):
    rows = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return tab.range_filter(rows, "l_quantity", 10, 20)


@query("range_filter_text", """SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS VARCHAR) AS price
FROM lineitem WHERE l_linenumber <= 5 AND l_extendedprice BETWEEN 1000 AND 2000""")
def q_range_text(spark, sf):
    text = _text_table(Tables(spark, sf)).select("l_orderkey", "l_linenumber", "price")
    return tab.range_filter(text, "price", 1000, 2000)


_LABELLED = """SELECT l_orderkey, l_linenumber, l_shipdate,
  CASE WHEN l_linestatus = 'O' THEN 'Yes' ELSE 'no' END AS open,
  CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS first_line, l_returnflag = 'R' AS returned,
  CAST(l_quantity AS STRING) AS quantity,
  CASE WHEN l_linenumber <= 5 THEN CAST(l_tax AS STRING) ELSE 'n/a' END AS tax, l_returnflag
FROM lineitem"""


@query("detect_column_types", """WITH x AS (SELECT
  CASE WHEN COUNT(DISTINCT l_orderkey) = 2 AND BOOL_AND(l_orderkey IN (0, 1)) THEN 'boolean' ELSE 'numeric' END AS a,
  CASE WHEN AVG(CASE WHEN l_linenumber <= 5 THEN 1 ELSE 0 END) > 0.8 THEN 'numeric' ELSE 'text' END AS b FROM lineitem)
SELECT 'l_orderkey' AS "column", a AS label FROM x UNION ALL SELECT 'l_linenumber', 'numeric' UNION ALL
SELECT 'l_shipdate', 'date' UNION ALL SELECT 'open', 'boolean' UNION ALL SELECT 'first_line', 'boolean' UNION ALL
SELECT 'returned', 'boolean' UNION ALL SELECT 'quantity', 'numeric' UNION ALL SELECT 'tax', b FROM x UNION ALL
SELECT 'l_returnflag', 'text'""")
def q_types(spark, sf):
    t = Tables(spark, sf)
    t.lineitem.createOrReplaceTempView("lineitem")
    return tab.detect_column_types(spark.sql(_LABELLED))


@query("preview", "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 5")
def q_preview(spark, sf):
    return tab.preview(Tables(spark, sf).orders, ["o_orderdate", "o_orderkey"], 5)


_ADHOC = """SELECT "l_returnflag", "l_linestatus", COUNT(*) AS n,
  COUNT(*) FILTER (WHERE "l_discount" > 0.05) AS discounted,
  CAST(SUM(CAST("l_extendedprice" AS DECIMAL(14,2))) AS DOUBLE) AS total,
  PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY "l_quantity") AS median_quantity
FROM {table} GROUP BY ALL"""


@query("sql_over_table", _ADHOC.format(table="lineitem"))
def q_sql(spark, sf):
    return tab.sql(Tables(spark, sf).lineitem, _ADHOC.format(table="data"))


_ADHOC_JOIN = """WITH spent AS (SELECT o_custkey, COUNT(*) AS orders,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS total FROM orders GROUP BY o_custkey)
SELECT c_mktsegment, COUNT(*) AS customers, MAX(total) AS best,
  CAST(SUM(orders) AS BIGINT) AS orders, COUNT(*) FILTER (WHERE o_custkey IS NULL) AS idle
FROM customer LEFT JOIN spent ON c_custkey = o_custkey GROUP BY c_mktsegment"""


@query("sql_over_named_tables", _ADHOC_JOIN)
def q_sql_named(spark, sf):
    t = Tables(spark, sf)
    return tab.sql({"customer": t.customer, "orders": t.orders}, _ADHOC_JOIN)


_HOLES = """SELECT l_orderkey, l_linenumber, NULLIF(l_quantity, 50.0) AS quantity,
  CASE WHEN l_linenumber < 5 THEN l_tax END AS tax FROM lineitem"""


def _holes(t: Tables):
    t.lineitem.createOrReplaceTempView("lineitem")
    return t.spark.sql(_HOLES)


@query("drop_null_rows_any", f"SELECT * FROM ({_HOLES}) WHERE quantity IS NOT NULL AND tax IS NOT NULL")
def q_drop_any(spark, sf):
    return tab.drop_null_rows(_holes(Tables(spark, sf)), ["quantity", "tax"])


@query("drop_null_rows_all", f"SELECT * FROM ({_HOLES}) WHERE quantity IS NOT NULL OR tax IS NOT NULL")
def q_drop_all(spark, sf):
    return tab.drop_null_rows(_holes(Tables(spark, sf)), ["quantity", "tax"], "all")


@query("sort_dedupe", """SELECT * EXCLUDE (r) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_orderdate
ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1""")
def q_dedupe(spark, sf):
    return tab.sort_dedupe(Tables(spark, sf).orders, "o_orderdate", ["o_orderkey"])


# ---- profiling -------------------------------------------------------------------------

_FN = {"sum": "CAST(SUM({c}) AS DOUBLE)", "mean": "AVG({c})", "count": "COUNT({c})", "min": "MIN({c})",
       "max": "MAX({c})", "std": "STDDEV_SAMP({c})", "var": "VAR_SAMP({c})"}


def _group_query(fn: str, sql: str):
    value = "CAST(l_extendedprice AS DECIMAL(14,2))" if fn == "sum" else "l_extendedprice"
    cell = sql.format(c=value)
    shown = cell if fn == "count" else rnd(cell)

    @query(f"group_agg_{fn}", f"SELECT l_returnflag, {shown} AS l_extendedprice FROM lineitem GROUP BY 1")
    def run(spark, sf):
        rows = Tables(spark, sf).lineitem.select("l_returnflag", "l_extendedprice")
        if fn == "sum":
            rows = rows.withColumn("l_extendedprice", F.col("l_extendedprice").cast("decimal(14,2)"))
        out = prof.group_agg(rows, "l_returnflag", "l_extendedprice", fn)
        return out if fn == "count" else out.withColumn("l_extendedprice", rounded(F.col("l_extendedprice"), 2))


for _fn, _sql in _FN.items():
    _group_query(_fn, _sql)


def _ranked(table: str, cols, n: int) -> str:
    return union_all([f"""SELECT * FROM (SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS "value", COUNT(*) AS "count",
CAST(ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, {c}) AS INTEGER) AS "rank", SUM(COUNT(*)) OVER () AS total
FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE "rank" <= {n}""" for c in cols])


_PART_TEXT = ("p_name", "p_brand", "p_type")


@query("top_values", f'SELECT "column", "value", "count", "rank" FROM ({_ranked("part", _PART_TEXT, 10)})')
def q_top_values(spark, sf):
    return prof.top_values(Tables(spark, sf).part)


@query("value_distribution", f"""SELECT "column", "value", "count", {pct('"count"', 'total')} AS pct
FROM ({_ranked("part", _PART_TEXT, 20)})""")
def q_distribution(spark, sf):
    return prof.value_distribution(Tables(spark, sf).part)


def _figures(table: str, cols, figures: dict[str, str]) -> str:
    return union_all([
        "SELECT '" + c + "' AS \"column\", " + ", ".join(f'{e.format(c=c)} AS "{k}"' for k, e in figures.items())
        + f" FROM {table}" for c in cols])


_BASIC = {"count": "COUNT({c})", "mean": rnd("AVG({c})", 4), "std": rnd("STDDEV_SAMP({c})", 4),
          "min": rnd("MIN({c})", 4), "max": rnd("MAX({c})", 4)}


def _q(p: float) -> str:
    return rnd("QUANTILE_CONT({c}, " + str(p) + ")", 4)


_SUMMARY = {**_BASIC, "p25": _q(0.25), "median": _q(0.5), "p75": _q(0.75)}
_LINE_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("numeric_summary", _figures("lineitem", _LINE_NUMBERS, _SUMMARY))
def q_numeric(spark, sf):
    return prof.numeric_summary(Tables(spark, sf).lineitem, list(_LINE_NUMBERS))


@query("numeric_summary_by_group", union_all([
    "SELECT l_suppkey, '" + c + "' AS \"column\", " + ", ".join(
        f'{e.format(c=c)} AS "{k}"' for k, e in _SUMMARY.items()) + " FROM lineitem GROUP BY l_suppkey"
    for c in ("l_quantity", "l_extendedprice")]))
def q_numeric_group(spark, sf):
    return prof.numeric_summary(Tables(spark, sf).lineitem, ["l_quantity", "l_extendedprice"], ["l_suppkey"])


def _pairs(table: str, cols, digits: int = 6) -> str:
    return union_all([f"SELECT '{a}' AS col_1, '{b}' AS col_2, {rnd(f'CORR({a}, {b})', digits)} AS correlation FROM {table}"
                      for i, a in enumerate(cols) for b in cols[i + 1:]])


@query("correlations", _pairs("lineitem", _LINE_NUMBERS))
def q_corr(spark, sf):
    out = prof.correlations(Tables(spark, sf).lineitem, list(_LINE_NUMBERS))
    return out.withColumn("correlation", rounded(F.col("correlation"), 6))


_PART = """SELECT p_partkey, NULLIF(p_name, 'small ring') AS p_name, p_brand, NULLIF(p_size, 7) AS p_size, p_retailprice
FROM part"""


def _part(t: Tables):
    t.part.createOrReplaceTempView("part")
    return t.spark.sql(_PART)


_PART_TYPES = {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_size": "int", "p_retailprice": "double"}


def _table_stats_sql() -> str:
    parts = []
    for c, k in _PART_TYPES.items():
        number = k != "string"
        figures = ", ".join(
            f'{e.format(c=c) if number else "CAST(NULL AS " + ("BIGINT" if f == "count" else "DOUBLE") + ")"} AS "{f}"'
            for f, e in _SUMMARY.items())
        text = (f"COUNT(DISTINCT {c}) AS \"unique\", (SELECT {c} FROM x WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) "
                f"DESC, {c} LIMIT 1) AS \"top\", (SELECT COUNT(*) FROM x WHERE {c} IS NOT NULL GROUP BY {c} "
                "ORDER BY COUNT(*) DESC LIMIT 1) AS top_freq") if not number else (
            'CAST(NULL AS BIGINT) AS "unique", CAST(NULL AS VARCHAR) AS "top", CAST(NULL AS BIGINT) AS top_freq')
        parts.append(f"SELECT '{c}' AS \"column\", '{k}' AS dtype, COUNT(*) AS row_count, COUNT(*) - COUNT({c}) AS missing, "
                     f"{figures}, {text} FROM x")
    return f"WITH x AS ({_PART}) {union_all(parts)}"


@query("table_statistics", _table_stats_sql())
def q_table_stats(spark, sf):
    return prof.table_statistics(_part(Tables(spark, sf)))


@query("summary_columns", f"WITH x AS ({_PART}) " + union_all([
    f"SELECT '{c}' AS \"column\", '{k}' AS dtype, COUNT(*) AS \"rows\", COUNT(*) - COUNT({c}) AS missing, "
    f"{pct(f'COUNT(*) - COUNT({c})', 'COUNT(*)')} AS missing_pct FROM x" for c, k in _PART_TYPES.items()]))
def q_summary_columns(spark, sf):
    return prof.summary_statistics(_part(Tables(spark, sf)))["columns"]


_DESCRIBE = {**_BASIC, "p5": _q(0.05), "p25": _q(0.25), "p50": _q(0.5), "p75": _q(0.75), "p95": _q(0.95),
             "skew": rnd("SKEWNESS({c})", 4), "kurtosis": rnd("KURTOSIS({c})", 4)}


@query("summary_numeric", f"WITH x AS ({_PART}) " + _figures("x", ("p_partkey", "p_size", "p_retailprice"), _DESCRIBE))
def q_summary_numeric(spark, sf):
    return prof.summary_statistics(_part(Tables(spark, sf)))["numeric"]


@query("summary_categorical", f"WITH x AS ({_PART}) " + union_all([
    f"""SELECT '{c}' AS "column", (SELECT COUNT(DISTINCT {c}) FROM x) AS unique_count,
(SELECT COUNT(*) - COUNT({c}) FROM x) AS missing_count, "value", "count", "rank" FROM (SELECT {c} AS "value", COUNT(*) AS "count",
CAST(ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, {c} ASC NULLS LAST) AS INTEGER) AS "rank" FROM x GROUP BY {c}) WHERE "rank" <= 10"""
    for c in ("p_name", "p_brand")]))
def q_summary_categorical(spark, sf):
    return prof.summary_statistics(_part(Tables(spark, sf)))["categorical"]


@query("summary_correlation", f"WITH x AS ({_PART}) " + _pairs("x", ("p_partkey", "p_size", "p_retailprice"), 4))
def q_summary_corr(spark, sf):
    return prof.summary_statistics(_part(Tables(spark, sf)))["correlation"]


_FACTS = """SELECT c_mktsegment, c_nationkey, NULLIF(c_mktsegment, 'BUILDING') AS segment,
  FLOOR(c_acctbal / 1000) * 1000 AS balance, CASE WHEN c_custkey % 97 = 0 THEN c_acctbal * 50 ELSE 1.0 END AS tail,
  'x' AS fixed, MAKE_DATE(1995 + c_nationkey, 1, 1) AS since FROM customer"""
_FACT_COLS = ("c_mktsegment", "c_nationkey", "segment", "balance", "tail", "fixed", "since")


def _fact(code, column="NULL", text="NULL", values=(), tail="FROM x"):
    cells = [f"CAST({v} AS DOUBLE)" for v in values] + ["CAST(NULL AS DOUBLE)"] * (4 - len(values))
    names = ("value", "value_2", "value_3", "value_4")
    return (f"SELECT {code} AS code, CAST({column} AS VARCHAR) AS \"column\", CAST({text} AS VARCHAR) AS \"text\", "
            + ", ".join(f'{c} AS "{n}"' for c, n in zip(cells, names)) + f" {tail}")


def _facts_sql() -> str:
    gone = " + ".join(f"(COUNT(*) - COUNT({c}))" for c in _FACT_COLS)
    parts = [
        _fact("'rows_columns'", values=["COUNT(*)", "7"]),
        _fact("'missing'", values=[gone, pct(f"({gone})", "(COUNT(*) * 7)", 1)]),
        "SELECT * FROM (" + _fact(
            "'duplicates'", values=["COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM x))",
                                    pct("(COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM x)))", "COUNT(*)", 1)])
        + ") WHERE \"value\" > 0",
    ]
    for c in ("c_nationkey", "balance", "tail"):
        parts.append(_fact("'range'", f"'{c}'", values=[rnd(f"MIN({c})", 4), rnd(f"MAX({c})", 4), rnd(f"AVG({c})", 4),
                                                        rnd(f"QUANTILE_CONT({c}, 0.5)", 4)]))
        parts.append("SELECT * FROM (" + _fact(
            f"CASE WHEN SKEWNESS({c}) > 0 THEN 'skewed_right' ELSE 'skewed_left' END", f"'{c}'",
            values=[rnd(f"SKEWNESS({c})", 4)]) + ") WHERE ABS(\"value\") > 1")
    for c in ("c_mktsegment", "segment", "fixed"):
        top = f"(SELECT {c} FROM x WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1)"
        k = f"COUNT(DISTINCT {c})"
        parts.append(_fact(f"CASE WHEN {k} <= 1 THEN 'constant_text' WHEN {k} < 20 THEN 'few_values' ELSE 'many_values' END",
                           f"'{c}'", f"CASE WHEN {k} > 1 AND {k} < 20 THEN {top} END", [k]))
    parts.append(_fact("'period'", "'since'", "STRFTIME(MIN(since), '%Y-%m-%d') || '/' || STRFTIME(MAX(since), '%Y-%m-%d')"))
    return f"WITH x AS ({_FACTS}) " + union_all(parts)


@query("dataset_insights", _facts_sql())
def q_facts(spark, sf):
    Tables(spark, sf).customer.createOrReplaceTempView("customer")
    table = spark.sql(_FACTS).withColumn("balance", F.col("balance").cast("double"))
    return prof.dataset_insights(table)
