"""KPI cards, chart data and headline facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from gridlore.functions.numeric import as_double, mean_of, rounded
from gridlore.functions.schema import columns_of
from gridlore.operators.insights import category_means, few_valued
from gridlore.plans.halves import column_facts
from gridlore.plans.shape import quoted, same_keys, top_per, value_counts

# Fixed values of the rules.
MAX_CARDS = 12
CARDS = ("total", "mean", "min", "max")  # of a column, and the names of their facts
LINE_METRICS = 3
BAR_COLUMNS, BAR_CATEGORIES, BAR_TOP = 2, 20, 10
PIE_COLUMNS, PIE_CATEGORIES, PIE_TOP = 3, 10, 8
MAX_FACTS = 5
TINY = 1e-9

POINT = "chart string, title string, label string, series string, value double, ord int"


def halves(df: DataFrame, cols: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """(column, n, first_mean, second_mean, first_sum, rest_sum) over the non-null rows in
    order: the first n div 2 rows, the n div 2 after them, and everything after the first.
    """
    _, facts = column_facts(df, cols, order_by)
    rows = [(f["column"], f["n"], *_half_means(f), f["first_sum"], f["rest_sum"]) for f in facts if f["n"]]
    return df.sparkSession.createDataFrame(
        rows, "column string, n bigint, first_mean double, second_mean double, first_sum double, rest_sum double")


def _half_means(f: dict) -> tuple[float | None, float | None]:
    half = f["n"] // 2
    return (f["first_sum"] / half, f["second_sum"] / half) if half else (None, None)


def _change(before: float | None, after: float | None) -> float:
    """Percent; 0 where there is no base to speak of."""
    return (after - before) * 100 / before if before is not None and abs(before) > TINY else 0.0


def _card_columns(df: DataFrame, cols: Sequence[str] | None) -> tuple[list[str], int | None]:
    """The numeric columns that cards are made of, and how many of them are shown."""
    return (list(cols), None) if cols else (columns_of(df, "numeric"), -(-MAX_CARDS // len(CARDS)))


def kpis(df: DataFrame, order_by: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """(ord, card, column, value, change_pct): total, mean, min and max per numeric column,
    for the columns given, or else for the first 3 that have any value (12 cards). The
    change of the first two compares the means of the two halves."""
    cols, most = _card_columns(df, cols)
    if most is not None and len(cols) > most:  # without values: no cards
        filled = df.agg(*[F.count(as_double(quoted(c))) for c in cols]).first()
        cols = [c for c, n in zip(cols, filled) if n][:most]
    return _cards(df, column_facts(df, cols, order_by)[1] if cols else [])


def _cards(df: DataFrame, facts: Sequence[dict]) -> DataFrame:
    rows = []
    for i, f in enumerate(facts):
        change = _change(*_half_means(f)) if f["n"] // 2 > 1 else 0.0
        for k, card in enumerate(CARDS if f["n"] else ()):
            rows.append((i * len(CARDS) + k, card, f["column"], f[card], change if k < 2 else 0.0))
    cards = df.sparkSession.createDataFrame(rows, "ord int, card string, column string, value double, change_pct double")
    return cards.select("ord", "card", "column", rounded(F.col("value"), 2).alias("value"), rounded(F.col("change_pct"), 2).alias("change_pct")).orderBy("ord")


def data_period(df: DataFrame, date: str | None = None) -> DataFrame:
    """(column, first, last) of the first date column."""
    date = date or columns_of(df, "date")[0]
    c = quoted(date).cast("timestamp")
    return df.agg(F.min(c).alias("first"), F.max(c).alias("last")).where("first is not null").select(
        F.lit(date).alias("column"), "first", "last")


def line_chart_data(df: DataFrame, grain: str = "day", date: str | None = None,
                    metrics: Sequence[str] | None = None) -> DataFrame:
    """Chart points: mean of the first 3 numeric columns per day, week, month, ... in date
    order. One point per period keeps the chart small whatever the table's size."""
    date = date or columns_of(df, "date")[0]
    metrics = list(metrics or columns_of(df, "numeric")[:LINE_METRICS])
    per = df.where(quoted(date).isNotNull()).groupBy(
        F.date_trunc(grain, quoted(date)).alias("__p")
    ).agg(*[mean_of(as_double(quoted(m))).alias(f"m{j}") for j, m in enumerate(metrics)])
    points = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(m).alias("series"), F.col(f"m{j}").alias("v"))
                       for j, m in enumerate(metrics)])
    long = per.select("__p", F.inline(points)).where("v is not null")
    # one row per period and metric: bounded by the calendar
    number = F.row_number().over(Window.partitionBy("series").orderBy("__p"))
    return long.select(
        F.lit("line").alias("chart"), F.concat(F.lit("trend "), "series").alias("title"),
        F.date_format("__p", "yyyy-MM-dd").alias("label"), "series",
        rounded(F.col("v"), 4).alias("value"), number.alias("ord"))


def bar_chart_data(df: DataFrame, cols: Sequence[str] | None = None,
                   metrics: Sequence[str] | None = None) -> DataFrame:
    """Chart points: for the text columns given, else the first 2, with 2 to 20 values, the 10 categories
    with the highest mean of the first of 2 numeric columns that has any value."""
    cats = list(cols) if cols else columns_of(df, "text")[:BAR_COLUMNS]
    metrics = list(metrics) if metrics else columns_of(df, "numeric")[:2]
    means = category_means(df, cats, metrics, 2, BAR_CATEGORIES)
    used = means.groupBy("column").agg(F.min("metric_no").alias("metric_no"))
    means = same_keys(means, used, ["column", "metric_no"], small_right=True)
    best = top_per(means, ["column"], [F.desc("mean"), F.col("value")], BAR_TOP)
    return best.select(
        F.lit("bar").alias("chart"),
        F.concat(F.lit("mean "), "metric", F.lit(" by "), "column").alias("title"),
        F.col("value").alias("label"), F.col("metric").alias("series"),
        rounded(F.col("mean"), 4).alias("value"), F.col("rank").alias("ord"))


def _few_counts(df: DataFrame, cols: Sequence[str], low: int, high: int) -> DataFrame:
    cols = few_valued(df, cols, high)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint")
    counts = value_counts(df, cols)
    kept = counts.groupBy("column").agg(F.count("*").alias("k")).where(F.col("k").between(low, high))
    return counts.join(F.broadcast(kept.select("column")), "column", "left_semi")


def pie_chart_data(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Chart points: counts of the 8 most frequent values of the first 3 text columns with
    2 to 10 values."""
    cats = list(cols) if cols else columns_of(df, "text")[:PIE_COLUMNS]
    counts = _few_counts(df, cats, 2, PIE_CATEGORIES)
    best = top_per(counts, ["column"], [F.desc("n"), F.col("value")], PIE_TOP)
    return best.select(
        F.lit("pie").alias("chart"), F.concat(F.lit("distribution "), "column").alias("title"),
        F.col("value").alias("label"), F.lit("count").alias("series"),
        F.col("n").cast("double").alias("value"), F.col("rank").alias("ord"))


def dashboard_summary(df: DataFrame, order_by: Sequence[str],
                      cols: Sequence[str] | None = None) -> DataFrame:
    """One row: sums of the first two numeric columns (of ``cols`` if given), growth of the
    first (second half against first half, an odd middle row counting as second), and counts."""
    numbers = list(cols or columns_of(df, "numeric"))
    return _summary(df, numbers, *column_facts(df, numbers[:2], order_by))


def _summary(df: DataFrame, numbers: Sequence[str], rows: int, facts: Sequence[dict]) -> DataFrame:
    totals = [facts[i]["total"] or 0.0 if len(facts) > i else 0.0 for i in range(2)]
    growth = 0.0
    if len(facts) == 2 and facts[0]["n"] // 2 > 1:
        growth = _change(facts[0]["first_sum"], facts[0]["rest_sum"])
    out = df.sparkSession.createDataFrame(
        [(*totals, growth, rows, len(df.columns), len(numbers))],
        "total_revenue double, total_profit double, growth double, row_count bigint, column_count bigint, numeric_count bigint")
    return out.select(*[rounded(F.col(c), 2).alias(c) for c in ("total_revenue", "total_profit", "growth")], "row_count", "column_count", "numeric_count")


def dashboard_insights(df: DataFrame, order_by: Sequence[str], n: int = MAX_FACTS,
                       metrics: Sequence[str] | None = None, texts: Sequence[str] | None = None) -> DataFrame:
    """(ord, code, column, text, value, value_2, value_3): the first n of these facts.

    size (rows, columns), range of the numeric columns given, else of 2 (min, max, mean),
    top_values of the text columns given, else of 2, with at most 20 values (value, count,
    rank), period of the first date column, kpis_up / kpis_down (cards changing by more than 5 %).
    """
    numbers = columns_of(df, "numeric")
    metrics = list(metrics or numbers[:2])
    rows, facts = column_facts(df, list(dict.fromkeys([*metrics, *numbers])), order_by)
    return _headlines(df, n, metrics, list(texts or columns_of(df, "text")[:2]), rows, facts)


def _headlines(df: DataFrame, n: int, metrics: Sequence[str], texts: Sequence[str], rows: int, facts: Sequence[dict]) -> DataFrame:
    spark, dates, none = df.sparkSession, columns_of(df, "date"), F.lit(None)
    kind = "__ord int, code string, column string, text string, value double, value_2 double, value_3 double"

    def shown(frame, order, code, column, text, *values):
        cells = [v.cast("double") for v in values] + [none.cast("double")] * (3 - len(values))
        return frame.select(
            order.cast("int").alias("__ord"), F.lit(code).alias("code"), column.cast("string").alias("column"),
            text.cast("string").alias("text"), *[c.alias(a) for c, a in zip(cells, ("value", "value_2", "value_3"))])

    named = {f["column"]: f for f in facts}
    plain = [(0, "size", None, None, float(rows), float(len(df.columns)), None)]
    ranges = [(i + 1, "range", c, None, named[c]["min"], named[c]["max"], named[c]["mean"]) for i, c in enumerate(metrics) if named[c]["n"]]
    most = -(-MAX_CARDS // len(CARDS))
    cards = [f for f in facts if f["n"] and f["column"] in columns_of(df, "numeric")][:most]
    changes = [float(rnd) for f in cards if f["n"] // 2 > 1 for rnd in [_change(*_half_means(f))] * 2]
    after = len(metrics) + len(texts) + 20
    moved = [(after + 10, "kpis_up", float(sum(c > 5 for c in changes))), (after + 11, "kpis_down", float(sum(c < -5 for c in changes)))]
    plain += ranges + [(o, code, None, None, k, None, None) for o, code, k in moved if k]
    parts = [spark.createDataFrame(plain, kind)]
    parts[0] = parts[0].select("__ord", "code", "column", "text", *[
        F.when(F.col("code") == "range", rounded(F.col(c), 2)).otherwise(F.col(c)).alias(c) for c in ("value", "value_2", "value_3")])
    if texts:
        place = F.create_map(*[F.lit(x) for i, c in enumerate(texts) for x in (c, i)])
        counts = _few_counts(df, texts, 1, BAR_CATEGORIES)
        best = top_per(counts, ["column"], [F.desc("n"), F.col("value")], 3)
        best = best.withColumn("p", place[F.col("column")])
        parts.append(shown(best, F.lit(len(metrics) + 10) + F.col("p"), "top_values", F.col("column"),
                           F.col("value"), F.col("n"), F.col("rank")))
    if dates:
        span = data_period(df)
        period = F.concat_ws("/", F.date_format("first", "yyyy-MM-dd"), F.date_format("last", "yyyy-MM-dd"))
        parts.append(shown(span, F.lit(after), "period", F.col("column"), period))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    # the facts are a few dozen rows at most
    rank = F.dense_rank().over(Window.orderBy("__ord"))
    return out.withColumn("ord", rank).where(F.col("ord") <= n).drop("__ord").orderBy("ord", "value_2")


def dashboard(df: DataFrame, order_by: Sequence[str]) -> dict[str, DataFrame]:
    """All dashboard results the table has the columns for; insights, summary and cards share
    one look at the numeric columns."""
    numbers, texts, dates = (columns_of(df, k) for k in ("numeric", "text", "date"))
    rows, facts = column_facts(df, numbers, order_by)
    most = -(-MAX_CARDS // len(CARDS))
    out = {"insights": _headlines(df, MAX_FACTS, numbers[:2], texts[:2], rows, facts),
           "summary": _summary(df, numbers, rows, facts[:2])}
    if numbers:
        out["kpis"] = _cards(df, [f for f in facts if f["n"]][:most])
    if dates:
        out["period"] = data_period(df)
    if dates and numbers:
        out["line"] = line_chart_data(df)
    if texts and numbers:
        out["bar"] = bar_chart_data(df)
    if texts:
        out["pie"] = pie_chart_data(df)
    return out
