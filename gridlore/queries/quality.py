"""Queries for quality checks, fixes and the audit of several tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlore.operators import audit as aud, quality as qual
from gridlore.operators.audit import ERROR_PATTERNS
from gridlore.operators.quality import ERROR_TOKENS
from gridlore.queries.core import union_all
from gridlore.queries.registry import Tables, pct, query, rnd

# A table with missing cells, copies, negatives, error texts and a constant column.
_DIRTY = """SELECT l_suppkey, NULLIF(l_quantity, 50.0) AS quantity,
  CASE WHEN l_linenumber > 2 THEN NULL ELSE l_extendedprice END AS price, l_discount - 0.02 AS margin,
  CASE WHEN l_linenumber = 7 THEN '#REF!' WHEN l_linenumber = 6 THEN 'see #N/A here'
       WHEN l_linenumber = 5 THEN '  #####' WHEN l_linenumber = 4 THEN '#NAM' ELSE l_returnflag END AS note,
  CASE WHEN l_linestatus = 'O' THEN l_returnflag END AS flag, 'same' AS fixed,
  CONCAT(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS code
FROM lineitem"""
_COLS = ("l_suppkey", "quantity", "price", "margin", "note", "flag", "fixed", "code")
_NUM = ("l_suppkey", "quantity", "price", "margin")
_TXT = ("note", "flag", "fixed", "code")
_D = f"WITH x AS ({_DIRTY}) "


def _view(t: Tables, sql: str, *names: str):
    for n in names:
        getattr(t, n).createOrReplaceTempView(n)
    return t.spark.sql(sql)


def _dirty(spark, sf):
    return _view(Tables(spark, sf), _DIRTY, "lineitem")


def _issue(kind, severity, column, metric, value, total, tail) -> str:
    return (f"SELECT '{kind}' AS \"type\", {severity} AS severity, {column} AS \"column\", {metric} AS metric, "
            f"CAST({value} AS DOUBLE) AS \"value\", CAST({total} AS BIGINT) AS total {tail}")


def _steps(v, *steps, low="'low'"):
    return "CASE " + " ".join(f"WHEN {v} > {b} THEN '{s}'" for b, s in steps) + f" ELSE {low} END"


_MISSING = "SELECT * FROM (" + union_all([
    _issue("missing_values", _steps(pct(f"COUNT(*) - COUNT({c})", "COUNT(*)"), (50, "high"), (20, "medium")), f"'{c}'",
           "'missing_pct'", pct(f"COUNT(*) - COUNT({c})", "COUNT(*)"), "COUNT(*)", f"FROM x HAVING COUNT(*) > COUNT({c})")
    for c in _COLS]) + ")"
_DUPLICATES = _issue("duplicates", "CASE WHEN e > r * 0.05 THEN 'medium' ELSE 'low' END", "CAST(NULL AS VARCHAR)", "'duplicate_rows'", "e", "r",
                     "FROM (SELECT COUNT(*) AS r, COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM x)) AS e FROM x) WHERE e > 0")
def _outliers_sql(cols) -> str:
    return "SELECT * FROM (" + union_all([
        _issue("outliers", _steps("p", (10, "high"), (5, "medium")), f"'{c}'", "'outlier_pct'", "p", "n",
               f"""FROM (SELECT COUNT({c}) AS n, SUM(CASE WHEN {c} < lo OR {c} > hi THEN 1 ELSE 0 END) AS k, {pct(
                   f'SUM(CASE WHEN {c} < lo OR {c} > hi THEN 1 ELSE 0 END)', f'COUNT({c})')} AS p
FROM x, (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi, a, b FROM (SELECT QUANTILE_CONT({c}, 0.25) AS a,
QUANTILE_CONT({c}, 0.75) AS b FROM x)) WHERE a <> b) WHERE n >= 10 AND k > 0""") for c in cols]) + ")"


_OUTLIERS = _outliers_sql(_NUM)
_NEGATIVES = "SELECT * FROM (" + union_all([
    _issue("invalid_data", _steps("p", (5, "medium")), f"'{c}'", "'negative_pct'", "p", "n",
           f"FROM (SELECT COUNT({c}) AS n, COUNT(*) FILTER (WHERE {c} < 0) AS k, {pct(f'COUNT(*) FILTER (WHERE {c} < 0)', f'COUNT({c})')} "
           "AS p FROM x) WHERE k > 0") for c in _NUM]) + ")"
_TOKENS = "SELECT * FROM (" + union_all([
    _issue("invalid_data", "'high'", f"'{c}'", f"'{t}'", "k", "n",
           f"FROM (SELECT COUNT({c}) AS n, COUNT(*) FILTER (WHERE CONTAINS({c}, '{t}')) AS k FROM x) WHERE k > 0")
    for c in _TXT for t in ERROR_TOKENS]) + ")"
_CONSTANT = "SELECT * FROM (" + union_all([
    _issue("constant_column", "'low'", f"'{c}'", "'distinct'", "d", "r",
           f"FROM (SELECT COUNT(DISTINCT {c}) AS d, COUNT(*) AS r FROM x) WHERE d <= 1") for c in _COLS]) + ")"
_CARDINALITY = "SELECT * FROM (" + union_all([
    _issue("high_cardinality", "'low'", f"'{c}'", "'distinct'", "d", "r",
           f"FROM (SELECT COUNT(DISTINCT {c}) AS d, COUNT(*) AS r FROM x) WHERE d > GREATEST(50, r * 0.5)") for c in _TXT]) + ")"


@query("check_missing", _D + _MISSING)
def q_missing(spark, sf):
    return qual.check_missing(_dirty(spark, sf))


@query("check_duplicates", f"WITH x AS (SELECT * EXCLUDE (code) FROM ({_DIRTY})) " + _DUPLICATES)
def q_duplicates(spark, sf):
    return qual.check_duplicates(_dirty(spark, sf).drop("code"))


@query("check_duplicate_texts", "WITH x AS (SELECT text, lang FROM documents) " + _DUPLICATES)
def q_duplicate_texts(spark, sf):
    return qual.check_duplicates(Tables(spark, sf).documents.select("text", "lang"))


@query("check_outliers_iqr", _D + _OUTLIERS)
def q_outliers(spark, sf):
    return qual.check_outliers_iqr(_dirty(spark, sf))


_EVENT_OUT = _outliers_sql(("value", "user_id"))


@query("check_outliers_iqr_events", "WITH x AS (SELECT value, user_id FROM events) " + _EVENT_OUT)
def q_outliers_events(spark, sf):
    return qual.check_outliers_iqr(Tables(spark, sf).events.select("value", "user_id"))


@query("check_negatives", _D + _NEGATIVES)
def q_negatives(spark, sf):
    return qual.check_negatives(_dirty(spark, sf))


@query("check_error_tokens", _D + _TOKENS)
def q_tokens(spark, sf):
    return qual.check_error_tokens(_dirty(spark, sf))


@query("check_constant", _D + _CONSTANT)
def q_constant(spark, sf):
    return qual.check_constant(_dirty(spark, sf))


@query("check_high_cardinality", _D + _CARDINALITY)
def q_cardinality(spark, sf):
    return qual.check_high_cardinality(_dirty(spark, sf))


@query("check_high_cardinality_texts", "WITH x AS (SELECT text, lang, source FROM documents) SELECT * FROM (" + union_all([
    _issue("high_cardinality", "'low'", f"'{c}'", "'distinct'", "d", "r",
           f"FROM (SELECT COUNT(DISTINCT {c}) AS d, COUNT(*) AS r FROM x) WHERE d > GREATEST(50, r * 0.5)")
    for c in ("text", "lang", "source")]) + ")")
def q_cardinality_texts(spark, sf):
    return qual.check_high_cardinality(Tables(spark, sf).documents.select("text", "lang", "source"))


@query("quality_report", _D + union_all([_MISSING, _DUPLICATES, _OUTLIERS, _NEGATIVES, _TOKENS, _CONSTANT, _CARDINALITY]))
def q_report(spark, sf):
    return qual.quality_report(_dirty(spark, sf))


# ---- fixes -----------------------------------------------------------------------------

_GAPS = """SELECT l_orderkey, l_linenumber, NULLIF(l_quantity, 50.0) AS quantity,
  CASE WHEN l_linenumber > 5 THEN NULL ELSE l_extendedprice END AS price,
  CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 4 THEN 'n/a' ELSE CAST(l_tax AS STRING) END AS tax_text,
  CASE WHEN l_linenumber > 1 THEN NULL ELSE l_discount END AS sparse,
  CASE WHEN l_linestatus = 'O' AND l_linenumber < 5 THEN NULL ELSE l_returnflag END AS flag, 'same' AS fixed,
  CASE WHEN l_linenumber = 2 THEN NULL ELSE l_shipdate END AS shipped
FROM lineitem"""
_G = f"WITH x AS ({_GAPS}) "


def _gaps(spark, sf):
    return _view(Tables(spark, sf), _GAPS, "lineitem")


@query("fix_remove_duplicates", "SELECT DISTINCT l_quantity, l_discount, l_returnflag FROM lineitem")
def q_fix_duplicates(spark, sf):
    table = Tables(spark, sf).lineitem.select("l_quantity", "l_discount", "l_returnflag")
    return qual.clean(table, ["remove_duplicates"])


def _rounded_doubles(df, *names):
    from gridlore.functions.numeric import rounded

    return df.withColumns({n: rounded(F.col(n), 4) for n in names})


@query("fix_fill_missing_mean", _G + f"""SELECT l_orderkey, l_linenumber,
  {rnd('COALESCE(quantity, (SELECT AVG(quantity) FROM x))', 4)} AS quantity,
  {rnd('COALESCE(price, (SELECT AVG(price) FROM x))', 4)} AS price,
  {rnd('COALESCE(sparse, (SELECT AVG(sparse) FROM x))', 4)} AS sparse,
  CASE WHEN tax_text IS NULL THEN {rnd('(SELECT AVG(TRY_CAST(tax_text AS DOUBLE)) FROM x)', 4)}
       ELSE TRY_CAST(tax_text AS DOUBLE) END AS tax_text, flag, fixed, shipped FROM x""")
def q_fix_mean(spark, sf):
    from gridlore.functions.numeric import number_from_text

    out = qual.clean(_gaps(spark, sf), ["fill_missing_mean"])
    return _rounded_doubles(out.withColumn("tax_text", number_from_text(F.col("tax_text"))),
                            "quantity", "price", "sparse", "tax_text")


@query("fix_fill_missing_median", _G + f"""SELECT l_orderkey, l_linenumber, tax_text, flag, fixed, shipped,
  {rnd('COALESCE(quantity, (SELECT QUANTILE_CONT(quantity, 0.5) FROM x))', 4)} AS quantity,
  {rnd('COALESCE(price, (SELECT QUANTILE_CONT(price, 0.5) FROM x))', 4)} AS price,
  {rnd('COALESCE(sparse, (SELECT QUANTILE_CONT(sparse, 0.5) FROM x))', 4)} AS sparse FROM x""")
def q_fix_median(spark, sf):
    return _rounded_doubles(qual.clean(_gaps(spark, sf), ["fill_missing_median"]), "quantity", "price", "sparse")


def _mode(c: str) -> str:
    return f"COALESCE({c}, (SELECT {c} FROM x WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1)) AS {c}"


@query("fix_fill_missing_mode", _G + "SELECT l_orderkey, l_linenumber, fixed, " + ", ".join(
    _mode(c) for c in ("quantity", "price", "sparse", "tax_text", "flag", "shipped")) + " FROM x")
def q_fix_mode(spark, sf):
    return qual.clean(_gaps(spark, sf), ["fill_missing_mode"])


@query("fix_drop_missing_high", _G + "SELECT * EXCLUDE (sparse) FROM x")
def q_fix_drop(spark, sf):
    return qual.clean(_gaps(spark, sf).where("l_orderkey is not null"), ["drop_missing_high"])


_FENCES = " AND ".join(
    f"{c} BETWEEN (SELECT a - 1.5 * (b - a) FROM q_{c}) AND (SELECT b + 1.5 * (b - a) FROM q_{c})"
    for c in ("value", "user_id", "weight"))
_EV = "SELECT event_id, CAST(value AS DOUBLE) AS value, user_id, NULLIF(value * 2, 20) AS weight, event_type FROM events"


@query("fix_remove_outliers_iqr", f"WITH x AS ({_EV}), " + ", ".join(
    f"q_{c} AS (SELECT QUANTILE_CONT({c}, 0.25) AS a, QUANTILE_CONT({c}, 0.75) AS b FROM x)"
    for c in ("value", "user_id", "weight")) + f" SELECT * FROM x WHERE {_FENCES}")
def q_fix_outliers(spark, sf):
    table = _view(Tables(spark, sf), _EV, "events")
    return qual.clean(table, ["remove_outliers_iqr"])


_PAD = ("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CONCAT('  ', text, CHR(9), CHR(10)) END AS text, "
        "CONCAT(lang, ' ') AS lang FROM documents")


@query("fix_strip_whitespace", f"""SELECT doc_id, REGEXP_REPLACE(REGEXP_REPLACE(text, '^\\s+', ''), '\\s+$', '') AS text,
TRIM(lang) AS lang FROM ({_PAD})""")
def q_fix_strip(spark, sf):
    return qual.clean(_view(Tables(spark, sf), _PAD, "documents"), ["strip_whitespace"])


@query("fix_drop_constant_columns", _G + "SELECT * EXCLUDE (fixed) FROM x")
def q_fix_constant(spark, sf):
    return qual.clean(_gaps(spark, sf), ["drop_constant_columns"])


@query("fix_report", f"""WITH x AS (SELECT NULLIF(l_quantity, 50.0) AS quantity, l_returnflag, CONCAT(l_linestatus, ' ') AS status,
  CASE WHEN l_linenumber > 1 THEN NULL ELSE l_discount END AS sparse, 'same' AS fixed FROM lineitem),
d AS (SELECT DISTINCT * FROM x)
SELECT * FROM (SELECT 1 AS step, 'remove_duplicates' AS fix, 'rows_removed' AS change, CAST(NULL AS VARCHAR) AS "column",
  COUNT(*) - (SELECT COUNT(*) FROM d) AS n FROM x UNION ALL
SELECT 2, 'drop_missing_high', 'column_dropped', 'sparse', CAST(1 AS BIGINT) FROM d HAVING AVG(CASE WHEN sparse IS NULL THEN 1 ELSE 0 END) > 0.5
UNION ALL SELECT 3, 'fill_missing_median', 'nulls_filled', 'quantity', COUNT(*) - COUNT(quantity) FROM d
UNION ALL SELECT 3, 'fill_missing_median', 'nulls_filled', 'sparse', COUNT(*) - COUNT(sparse) FROM d
  HAVING AVG(CASE WHEN sparse IS NULL THEN 1 ELSE 0 END) <= 0.5
UNION ALL SELECT 4, 'strip_whitespace', 'cells_stripped', 'status', COUNT(*) FROM d
UNION ALL SELECT 5, 'drop_constant_columns', 'column_dropped', 'fixed', 1) WHERE n > 0""")
def q_fix_report(spark, sf):
    table = _view(Tables(spark, sf), """SELECT NULLIF(l_quantity, 50.0) AS quantity, l_returnflag,
      CONCAT(l_linestatus, ' ') AS status, CASE WHEN l_linenumber > 1 THEN NULL ELSE l_discount END AS sparse,
      'same' AS fixed FROM lineitem""", "lineitem")
    return qual.fix_report(table, ["remove_duplicates", "drop_missing_high", "fill_missing_median", "strip_whitespace",
                                   "drop_constant_columns"])


# ---- audit -----------------------------------------------------------------------------


def _finding(severity, category, sheet, column="NULL", a="NULL", b="NULL", n="NULL", tail="") -> str:
    return (f"SELECT '{severity}' AS severity, CAST({category} AS VARCHAR) AS category, CAST({sheet} AS VARCHAR) AS sheet, "
            f"CAST({column} AS VARCHAR) AS \"column\", CAST({a} AS BIGINT) AS row_from, CAST({b} AS BIGINT) AS row_to, "
            f"CAST({n} AS BIGINT) AS n {tail}")


_HOLLOW = "SELECT NULLIF(c_custkey, c_custkey) AS a, NULLIF(c_name, c_name) AS b FROM customer"
_EMPTY_SHEET = _finding("high", "'empty_sheet'", "'hollow'", n="0",
                        tail="FROM customer HAVING COUNT(*) = COUNT(CASE WHEN c_custkey = c_custkey THEN 1 END)")


@query("audit_empty_sheet", _EMPTY_SHEET)
def q_empty_sheet(spark, sf):
    t = Tables(spark, sf)
    hollow = _view(t, _HOLLOW, "customer")
    return aud.empty_sheet("hollow", hollow).unionByName(aud.empty_sheet("customer", t.customer))


@query("audit_empty_workbook", """SELECT 'high' AS severity, 'empty_workbook' AS category, CAST(NULL AS VARCHAR) AS sheet,
CAST(NULL AS VARCHAR) AS "column", CAST(NULL AS BIGINT) AS row_from, CAST(NULL AS BIGINT) AS row_to, CAST(0 AS BIGINT) AS n
FROM region WHERE r_regionkey < 0""")
def q_empty_workbook(spark, sf):
    return aud.empty_workbook(spark, {"region": Tables(spark, sf).region})


@query("audit_inconsistent_columns", """WITH lines AS (SELECT doc_id, STRING_SPLIT(text, CHR(10)) AS l FROM documents),
rows AS (SELECT doc_id, LEN(STRING_SPLIT(l[1], ',')) AS width, UNNEST(l) AS line, GENERATE_SUBSCRIPTS(l, 1) AS i FROM lines)
SELECT 'medium' AS severity, 'inconsistent_columns' AS category, CAST(doc_id AS VARCHAR) AS sheet, CAST(NULL AS VARCHAR) AS "column",
CAST(i AS BIGINT) AS row_from, CAST(i AS BIGINT) AS row_to, CAST(LEN(STRING_SPLIT(line, ',')) AS BIGINT) AS n
FROM rows WHERE LEN(STRING_SPLIT(line, ',')) <> width""")
def q_ragged(spark, sf):
    lines = F.split("text", "\n")
    width = F.size(F.split(lines[0], ",")).alias("width")
    rows = Tables(spark, sf).documents.select("doc_id", width, F.posexplode(lines).alias("row_no", "line"))
    raw = rows.select("doc_id", "width", "row_no", F.split("line", ",").alias("cells"))
    return aud.inconsistent_columns(F.col("doc_id"), raw, "cells", F.col("width"), "row_no")


_BLANK = "SELECT c_custkey, NULLIF(c_mktsegment, c_mktsegment) AS segment, c_acctbal FROM customer"


@query("audit_empty_column", _finding("medium", "'empty_column'", "'customer'", "'segment'", n="COUNT(*)",
                                      tail=f"FROM ({_BLANK}) HAVING COUNT(segment) = 0"))
def q_empty_column(spark, sf):
    return aud.empty_column("customer", _view(Tables(spark, sf), _BLANK, "customer"))


_SIGNED = "SELECT c_custkey, c_acctbal AS total_balance, c_acctbal AS width_cm FROM customer"


@query("audit_unexpected_negative", _finding("medium", "'unexpected_negative'", "'customer'", "'total_balance'",
                                             n="COUNT(*)", tail=f"FROM ({_SIGNED}) WHERE total_balance < 0 HAVING COUNT(*) > 0"))
def q_negative_names(spark, sf):
    return aud.unexpected_negative("customer", _view(Tables(spark, sf), _SIGNED, "customer"))


_MARKED = """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN CONCAT(text, ' #REF!') WHEN doc_id % 7 = 1 THEN CONCAT('#######', text)
  WHEN doc_id % 7 = 2 THEN CONCAT(text, '#NAME?') ELSE text END AS text, lang FROM documents"""


@query("audit_suspicious_text", f"WITH x AS ({_MARKED}) SELECT * FROM (" + union_all([
    _finding("high", f"'suspicious_text:{name}'", "'documents'", f"'{c}'", n="COUNT(*)",
             tail=f"FROM x WHERE REGEXP_MATCHES({c}, '{pattern}') HAVING COUNT(*) > 0")
    for name, pattern in ERROR_PATTERNS for c in ("text", "lang")]) + ")")
def q_suspicious(spark, sf):
    return aud.suspicious_text("documents", _view(Tables(spark, sf), _MARKED, "documents"))


_CATALOGUE = """SELECT p_type AS "table", p_partkey AS ordinal, CASE WHEN p_size % 5 = 0 THEN p_name WHEN p_size % 5 = 1 THEN
  CONCAT(CAST(p_size AS STRING), p_type) WHEN p_size % 5 = 2 THEN '  ' WHEN p_size % 5 = 3 THEN NULL ELSE p_type END AS name FROM part"""


@query("audit_header_lint", f"""SELECT 'low' AS severity, category, "table" AS sheet, name AS "column", CAST(NULL AS BIGINT) AS row_from,
CAST(NULL AS BIGINT) AS row_to, ordinal AS n FROM (SELECT *, CASE WHEN name IS NULL OR TRIM(name) = '' THEN 'empty_header'
WHEN REGEXP_MATCHES(name, '[ #@!$%^&*()+=\\[\\]{{}}|\\\\;:''",.<>/?~`]') THEN 'header_special_chars'
WHEN REGEXP_MATCHES(name, '^[0-9]') THEN 'header_starts_with_digit' END AS category FROM ({_CATALOGUE})) WHERE category IS NOT NULL""")
def q_headers(spark, sf):
    t = Tables(spark, sf)
    return aud.header_lint(_view(t, _CATALOGUE.replace('"table"', "`table`"), "part"))


_SPARSE = """SELECT event_id AS row_no, CASE WHEN user_id % 3 > 0 THEN event_type END AS kind,
  CASE WHEN user_id % 7 = 0 THEN props END AS props, event_type FROM events"""


@query("audit_merged_cell_gaps", f"WITH x AS ({_SPARSE}) " + union_all([
    _finding("low", "'merged_cell_gap'", "'events'", f"'{c}'", "p + 1", "row_no + 1", "row_no - p - 1",
             f"FROM (SELECT row_no, LAG(row_no) OVER (ORDER BY row_no) AS p FROM x WHERE {c} IS NOT NULL) "
             "WHERE row_no - p BETWEEN 2 AND 20") for c in ("kind", "props")]))
def q_gaps(spark, sf):
    return aud.merged_cell_gaps("events", _view(Tables(spark, sf), _SPARSE, "events"), "row_no")


_A_CUSTOMER = """SELECT c_custkey, c_acctbal AS total_balance, NULLIF(c_mktsegment, c_mktsegment) AS segment,
  CASE WHEN c_nationkey = 3 THEN '#DIV/0!' ELSE c_name END AS `full name` FROM customer"""


@query("audit", _finding("high", "'suspicious_text:div_zero'", "'customer'", "'full name'", n="COUNT(*)",
                         tail="FROM customer WHERE c_nationkey = 3 HAVING COUNT(*) > 0") + " UNION ALL " + union_all([
    _finding("medium", "'empty_column'", "'customer'", "'segment'", n="COUNT(*)", tail="FROM customer"),
    _finding("medium", "'unexpected_negative'", "'customer'", "'total_balance'", n="COUNT(*)",
             tail="FROM customer WHERE c_acctbal < 0 HAVING COUNT(*) > 0"),
    _finding("low", "'header_special_chars'", "'customer'", "'full name'", n="4")]) + " UNION ALL SELECT * FROM (" + union_all([
    _finding("low", "'merged_cell_gap'", "'events'", f"'{c}'", "p + 1", "row_no + 1", "row_no - p - 1",
             f"FROM (SELECT row_no, LAG(row_no) OVER (ORDER BY row_no) AS p FROM ({_SPARSE}) WHERE {c} IS NOT NULL) "
             "WHERE row_no - p BETWEEN 2 AND 20") for c in ("kind", "props")]) + ")")
def q_audit(spark, sf):
    t = Tables(spark, sf)
    return aud.audit(spark, {"customer": _view(t, _A_CUSTOMER, "customer"), "events": _view(t, _SPARSE, "events")})
