"""Financial health: ratios from the latest figures, growth, and a score, per entity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from gridlore.functions.numeric import as_double, grade, rounded
from gridlore.functions.schema import detect_roles
from gridlore.plans.shape import quoted

FIGURES = ("revenue", "cogs", "profit", "expense", "asset", "liability", "equity", "current_asset",
           "current_liability", "inventory", "receivable")

# Points per family and verdict, and the levels of the score.
POINTS = {
    ("profitability", "good"): 10, ("profitability", "positive"): 10, ("profitability", "fair"): 5,
    ("profitability", "low"): -10, ("profitability", "negative"): -10,
    ("liquidity", "healthy"): 10, ("liquidity", "fair"): 5, ("liquidity", "low"): -10,
    ("efficiency", "efficient"): 8, ("efficiency", "fast"): 8,
    ("efficiency", "inefficient"): -5, ("efficiency", "slow"): -5,
    ("growth", "growing"): 10, ("growth", "declining"): -10,
}
NEUTRAL = 50.0
LEVELS = ((80.0, "excellent"), (60.0, "good"), (40.0, "fair"), (20.0, "poor"))


def latest_values(df: DataFrame, roles: Mapping[str, str] | None = None,
                  order_by: Sequence[str] | None = None, group_by: Sequence[str] = ()) -> DataFrame:
    """One row (per group) with the last non-null value of each figure.

    Order is ``order_by``, else the date role. One aggregate finds all figures: the
    ordering is hidden where a figure is null, so each takes its own last row.
    """
    found = detect_roles(df, "finance", roles)
    return df.groupBy(*map(quoted, group_by)).agg(*_latest_picks(found, order_by))


def _latest_picks(found: Mapping[str, str], order_by: Sequence[str] | None) -> list:
    order = list(order_by or ([found["date"]] if "date" in found else []))
    if not order:
        raise ValueError("an order is needed: give order_by or a date role")
    # a single order column keeps the aggregate hash-based
    at = quoted(order[0]) if len(order) == 1 else F.struct(*map(quoted, order))
    picks = []
    for figure in FIGURES:
        if figure in found:
            value = as_double(quoted(found[figure]))
            picks.append(F.max_by(value, F.when(value.isNotNull(), at)).alias(figure))
        else:
            picks.append(F.max(F.lit(None).cast("double")).alias(figure))
    return picks


def _metric(family, name, value, unit, verdict, when, digits=2):
    return F.when(when & value.isNotNull(), F.struct(
        F.lit(family).alias("family"), F.lit(name).alias("name"), rounded(value, digits).alias("value"),
        F.lit(unit).alias("unit"), verdict.alias("verdict")))


def _rows(latest: DataFrame, metrics, group_by) -> DataFrame:
    return latest.select(*map(quoted, group_by), F.inline(F.array_compact(F.array(*metrics))))


def _profitability_ratios() -> list:
    rev, cogs, profit, cost = (F.col(c) for c in ("revenue", "cogs", "profit", "expense"))
    sold = F.coalesce(rev > 0, F.lit(False))
    share = lambda part: F.try_divide(part * 100, rev)
    gross, net = share(rev - cogs), share(F.coalesce(profit, rev - cost))
    operating = share(rev - cogs - cost)
    return [
        _metric("profitability", "gross_margin", gross, "%",
                grade(gross, (40, "good"), (20, "fair"), otherwise="low"), sold),
        _metric("profitability", "net_margin", net, "%",
                grade(net, (15, "good"), (5, "fair"), otherwise="low"), sold),
        _metric("profitability", "operating_margin", operating, "%",
                grade(operating, (20, "good"), (10, "fair"), otherwise="low"), sold),
        _metric("profitability", "profit_indicator", profit, "currency",
                grade(profit, (0, "positive"), otherwise="negative"), ~sold),
    ]


def _liquidity_ratios() -> list:
    have, owe = F.col("current_asset"), F.col("current_liability")
    short = F.coalesce((owe > 0) & have.isNotNull(), F.lit(False))
    current = F.try_divide(have, owe)
    quick = F.try_divide(have - F.coalesce("inventory", F.lit(0.0)), owe)
    all_owed = F.coalesce(F.col("liability") > 0, F.lit(False))
    solvency = F.try_divide(F.col("asset"), F.col("liability"))
    strict = lambda c: grade(c, (1.5, "healthy"), (1, "fair"), otherwise="low")
    return [
        _metric("liquidity", "current_ratio", current, "x", strict(current), short),
        _metric("liquidity", "quick_ratio", quick, "x",
                grade(quick, (1, "healthy"), (0.5, "fair"), otherwise="low"), short),
        _metric("liquidity", "solvency_ratio", solvency, "x", strict(solvency), ~short & all_owed),
    ]


def _efficiency_ratios() -> list:
    rev = F.col("revenue")
    per = lambda base: F.try_divide(rev, F.col(base))
    on = lambda base: F.coalesce((rev > 0) & (F.col(base) > 0), F.lit(False))
    speed = lambda c, fast, normal: grade(c, (fast, "fast"), (normal, "normal"), otherwise="slow")
    return [
        _metric("efficiency", "asset_turnover", per("asset"), "x",
                grade(per("asset"), (1, "efficient"), otherwise="inefficient"), on("asset"), 4),
        _metric("efficiency", "inventory_turnover", per("inventory"), "x",
                speed(per("inventory"), 6, 3), on("inventory")),
        _metric("efficiency", "receivables_turnover", per("receivable"), "x",
                speed(per("receivable"), 12, 6), on("receivable")),
    ]


def profitability_ratios(latest: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """Gross, net and operating margin; without revenue the sign of the profit."""
    return _rows(latest, _profitability_ratios(), group_by)


def liquidity_ratios(latest: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """Current and quick ratio, or assets over liabilities where those are unknown."""
    return _rows(latest, _liquidity_ratios(), group_by)


def efficiency_ratios(latest: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """Turnover of assets, inventory and receivables."""
    return _rows(latest, _efficiency_ratios(), group_by)


def growth_metrics(df: DataFrame, roles: Mapping[str, str] | None = None,
                   group_by: Sequence[str] = (), tie_break: Sequence[str] = ()) -> DataFrame:
    """Revenue and profit growth, last against first by date (at least 2 dated values)."""
    found = detect_roles(df, "finance", roles)
    ends = df.groupBy(*map(quoted, group_by)).agg(*_growth_picks(found, tie_break))
    return _rows(ends, _growth_metrics(), group_by)


def _growth_picks(found: Mapping[str, str], tie_break: Sequence[str]) -> list:
    if "date" not in found:
        raise ValueError("growth needs a date column")
    date = quoted(found["date"])
    picks = []
    for figure in ("revenue", "profit"):
        value = as_double(quoted(found[figure])) if figure in found else F.lit(None).cast("double")
        order = F.struct(date, *map(quoted, tie_break)) if tie_break else date
        at = F.when(value.isNotNull() & date.isNotNull(), order)
        picks += [F.count(at).alias(f"{figure}_n"), F.min_by(value, at).alias(f"{figure}_a"),
                  F.max_by(value, at).alias(f"{figure}_z")]
    return picks


def _growth_metrics() -> list:
    metrics = []
    for figure in ("revenue", "profit"):
        first, last = F.col(f"{figure}_a"), F.col(f"{figure}_z")
        value = F.try_divide((last - first) * 100, F.abs(first))
        usable = F.col(f"{figure}_n") >= 2
        if figure == "revenue":
            usable = usable & (first > 0)
        else:
            value = F.when(first != 0, value).when(last > 0, 100.0).when(last.isNotNull(), 0.0)
        verdict = grade(value, (0, "growing"), otherwise="declining")
        metrics.append(_metric("growth", f"{figure}_growth", value, "%", verdict, usable))
    return metrics


def health_score(metrics: DataFrame, entities: DataFrame | None = None,
                 group_by: Sequence[str] = ()) -> DataFrame:
    """(health_score, health_level): 50 plus the points of each verdict, within 0 to 100.

    ``entities`` lists the groups to score; those without any metric stay at 50.
    """
    keys = [quoted(g) for g in group_by]
    points = _points(F.col("family"), F.col("verdict"))
    scored = metrics.select(*keys, points.alias("p"))
    if entities is not None:
        scored = scored.unionByName(entities.select(*keys, F.lit(0.0).alias("p")))
    out = scored.groupBy(*keys).agg((F.lit(NEUTRAL) + F.coalesce(F.sum("p"), F.lit(0.0))).alias("__t"))
    return out.select(*keys, *_levels(F.col("__t")))


def _points(family, verdict):
    known = ", ".join(f"'{f}:{v}', {float(p)}D" for (f, v), p in POINTS.items())
    worth = F.try_element_at(F.expr(f"map({known})"), F.concat(family, F.lit(":"), verdict))
    return F.coalesce(worth, F.lit(0.0))


def _levels(total):
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))
    level = F.lit("critical")
    for bound, name in reversed(LEVELS):
        level = F.when(score >= bound, name).otherwise(level)
    return score.alias("health_score"), level.alias("health_level")


def financial_health(df: DataFrame, roles: Mapping[str, str] | None = None,
                     order_by: Sequence[str] | None = None, group_by: Sequence[str] = (),
                     tie_break: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Latest figures, all metrics in one table, and the score.

    One aggregate per entity yields everything; metrics and score are then expressions on
    its row, so nothing is shuffled again.
    """
    found = detect_roles(df, "finance", roles)
    order = list(order_by or ([found["date"], *tie_break] if "date" in found else []))
    picks, metrics = _latest_picks(found, order), [
        *_profitability_ratios(), *_liquidity_ratios(), *_efficiency_ratios()]
    if "date" in found:
        picks, metrics = picks + _growth_picks(found, tie_break), metrics + _growth_metrics()
    keys = [quoted(g) for g in group_by]
    wide = df.groupBy(*keys).agg(*picks).withColumn("__metrics", F.array_compact(F.array(*metrics)))
    total = F.aggregate("__metrics", F.lit(NEUTRAL), lambda acc, m: acc + _points(m["family"], m["verdict"]))
    return {"latest": wide.select(*keys, *FIGURES), "metrics": wide.select(*keys, F.inline("__metrics")),
            "score": wide.select(*keys, *_levels(total))}
