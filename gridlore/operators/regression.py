"""Regression modelling on pyspark.ml.

Boosted trees look at features only by the bins between their split candidates, 32 at most. Rows
that share all bins are therefore one row to them, with the mean target and their number as weight:
the squared error differs by what varies within such a cell, which no split can change. Trees are
grown on these cells, so a round costs as much as there are cells: with k features never more than
32 to the k, however many rows there are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, functions as F

from gridlore.functions.numeric import as_double, mean_of, number_from_text, rounded
from gridlore.functions.schema import columns_of
from gridlore.plans.position import with_position
from gridlore.plans.shape import measured_join, quoted
from gridlore.session import pin, shared_dir

# Fixed values of the models.
ROUNDS, RATE, DEPTH, SEED, BINS = 100, 0.1, 6, 42, 32
MIN_ROWS, MANY_ROWS = 3, 10
TEST_SHARE, TEST_SHARE_FEW = 0.3, 0.2
UNSEEN = -1.0
#: Features with about so many distinct values or fewer have them counted, others a sketch of
#: quantiles with that rank error; and the most bins Spark's square of bins can take.
COUNTED, SKETCH_ACCURACY, MOST_BINS = 1000, 10000, 46340


@dataclass
class Prepared:
    """Encoded rows and what is needed to encode others the same way."""

    rows: DataFrame
    features: list[str]
    labels: dict[str, DataFrame] = field(default_factory=dict)


def label_table(df: DataFrame, col: str) -> DataFrame:
    """(value, code): distinct texts numbered alphabetically. A table, not a list on the
    driver, so the number of texts does not matter."""
    values = df.where(quoted(col).isNotNull()).select(quoted(col).alias("value")).distinct()
    return with_position(values, ["value"], name="code")


def encode(df: DataFrame, features: Sequence[str], labels: dict[str, DataFrame]) -> DataFrame:
    """Adds f_0, f_1, ...: numbers as they are, texts as their code, unseen ones as -1."""
    out = df
    for i, c in enumerate(features):
        name = f"f_{i}"
        if c in labels:
            codes = labels[c].select(F.col("value").alias(c), F.col("code").cast("double").alias(name))
            out = measured_join(out, codes, [c], "left")
            out = out.withColumn(name, F.coalesce(name, F.lit(UNSEEN)))
        else:
            out = out.withColumn(name, as_double(quoted(c)))
    return out


def prepare_features(df: DataFrame, target: str, features: Sequence[str] | None = None) -> Prepared:
    """Rows with all features and a numeric target present; by default all numeric columns
    but the target are features."""
    features = list(features or [c for c in columns_of(df, "numeric") if c != target])
    goal = number_from_text(quoted(target)) if target in columns_of(df, "text") else as_double(quoted(target))
    numeric = set(columns_of(df, "numeric"))
    rows = df.withColumn("__target", goal)
    for c in features:
        rows = rows.where(as_double(quoted(c)).isNotNull() if c in numeric else quoted(c).isNotNull())
    rows = rows.where("__target is not null")
    labels = {c: label_table(rows, c) for c in features if c not in numeric}
    return Prepared(encode(rows, features, labels), features, labels)


def split_column(key: Sequence[str]):
    """A number in [0, 1) that depends on the key columns only."""
    text = F.concat_ws("|", *[quoted(c).cast("string") for c in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def train_test_split(df: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(train, test): 30 % test from 10 rows on, else 20 %; needs 3 rows. A row's side follows
    from its key, however the table is partitioned or read again."""
    n = df.limit(MANY_ROWS).count()
    if n < MIN_ROWS:
        raise ValueError("at least 3 rows are needed")
    share = TEST_SHARE if n >= MANY_ROWS else TEST_SHARE_FEW
    marked = df.withColumn("__draw", split_column(key))
    return (marked.where(F.col("__draw") >= share).drop("__draw"),
            marked.where(F.col("__draw") < share).drop("__draw"))


@dataclass
class Regression:
    """A fitted model."""

    kind: str
    target: str
    features: list[str]
    labels: dict[str, DataFrame]
    fitted: PipelineModel
    test: DataFrame

    def transform(self, encoded: DataFrame) -> DataFrame:
        return self.fitted.transform(encoded).drop("features", *_bins(len(self.features)))


def _bins(n: int) -> list[str]:
    return [f"__bin{i}" for i in range(n)]


def _between(counts: list[tuple[float, int]]) -> list[float]:
    """Split candidates of a feature from its ascending values and their rows, by the rule of Spark's
    trees: between all values if they are few, else where even shares of the rows end."""
    middles = [(a + b) / 2 for (a, _), (b, _) in zip(counts, counts[1:])]
    if len(middles) < BINS:
        return middles
    share = sum(n for _, n in counts) / BINS
    out, goal, so_far = [], share, 0
    for (_, n), (_, more), middle in zip(counts, counts[1:], middles):
        so_far += n
        if abs(so_far - goal) < abs(so_far + more - goal):
            out.append(middle)
            goal += share
    return out


def split_candidates(rows: DataFrame, names: Sequence[str]) -> list[list[float]]:
    """At most 31 ascending candidates for each numeric column, from all rows."""
    shares = [i / BINS for i in range(1, BINS)]
    seen = rows.agg(*[c for n in names for c in (
        F.approx_count_distinct(n, 0.02).alias(f"{n}_d"), F.percentile_approx(n, shares, SKETCH_ACCURACY).alias(f"{n}_q"))]).first()
    few = [n for n in names if seen[f"{n}_d"] <= COUNTED]
    values: dict[str, list] = {n: [] for n in few}
    if few:
        cells = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("v")) for n in few])).alias("c"))
        for r in cells.groupBy("c.name", "c.v").agg(F.count("*").alias("n")).collect():
            values[r["name"]].append((r["v"], r["n"]))
    found = [_between(sorted(values[n])) if n in values else sorted(set(seen[f"{n}_q"])) for n in names]
    return [[x for x in edges if math.isfinite(x)] for edges in found]


def _cells(rows: DataFrame, names: Sequence[str]) -> tuple[Bucketizer, DataFrame]:
    """The bins of the columns, and one row per set of bins: mean target and number of rows."""
    ends = [[-math.inf, *(edges or [0.0]), math.inf] for edges in split_candidates(rows, names)]
    bins = _bins(len(names))
    binned = Bucketizer(splitsArray=ends, inputCols=list(names), outputCols=bins, handleInvalid="keep")
    # a sum drops the mark of a category, which Bucketizer puts on its columns: bins are ordered
    ordered = [(F.col(b) + F.lit(0.0)).alias(b) for b in bins]
    cells = binned.transform(rows).groupBy(*ordered).agg(F.avg("__target").alias("__target"), F.count("*").cast("double").alias("__weight"))
    return binned, pin(cells)


def train(df: DataFrame, target: str, features: Sequence[str] | None = None, model: str = "gbt",
          key: Sequence[str] | None = None, rounds: int = ROUNDS) -> Regression:
    """Fits boosted trees (``gbt``) or least squares (``linear``) on the training split.

    ``key`` names the columns that decide the split, by default features and target.
    """
    if model not in ("gbt", "linear"):
        raise ValueError("model must be gbt or linear")
    ready = prepare_features(df, target, features)
    train_rows, test_rows = train_test_split(ready.rows, key or [*ready.features, target])
    names = [f"f_{i}" for i in range(len(ready.features))]
    if model == "gbt":
        sc = df.sparkSession.sparkContext
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(shared_dir(df.sparkSession))
        binned, cells = _cells(train_rows.select(*names, "__target"), names)
        # Spark draws a sample to look for candidates unless it may have as many as the square of
        # the bins; every feature has 32 values or fewer here, so it takes them all.
        width = min(MOST_BINS, max(BINS, math.isqrt(cells.count()) + 1))
        learner = GBTRegressor(featuresCol="features", labelCol="__target", predictionCol="predicted", weightCol="__weight", maxBins=width,
                               maxIter=rounds, stepSize=RATE, maxDepth=DEPTH, seed=SEED, checkpointInterval=10)
        fitted = Pipeline(stages=[VectorAssembler(inputCols=_bins(len(names)), outputCol="features"), learner]).fit(cells)
        fitted = PipelineModel([binned, *fitted.stages])
    else:
        learner = LinearRegression(featuresCol="features", labelCol="__target", predictionCol="predicted",
                                   regParam=0.0, solver="normal")
        assembler = VectorAssembler(inputCols=names, outputCol="features")
        fitted = Pipeline(stages=[assembler, learner]).fit(train_rows.select(*names, "__target"))
    return Regression(model, target, ready.features, ready.labels, fitted, test_rows)


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: n, mae, rmse, r2 over rows with both values."""
    y, p = as_double(quoted(actual)), as_double(quoted(predicted))
    rows = df.select(y.alias("y"), (y - p).alias("e")).where("e is not null")
    out = rows.agg(F.count("*").alias("n"), mean_of(F.abs("e")).alias("mae"), F.sum(F.col("e") * F.col("e")).alias("sse"),
                   F.var_pop("y").alias("v"))
    r2 = F.when(F.col("v") > 0, 1 - F.col("sse") / (F.col("v") * F.col("n")))
    return out.select("n", rounded(F.col("mae"), 4).alias("mae"),
                      rounded(F.sqrt(F.try_divide("sse", F.col("n").cast("double"))), 4).alias("rmse"),
                      rounded(r2, 4).alias("r2"))


def model_metrics(model: Regression) -> DataFrame:
    """``regression_metrics`` on the test split."""
    return regression_metrics(actual_vs_predicted(model), "actual", "predicted")


def actual_vs_predicted(model: Regression) -> DataFrame:
    """(actual, predicted) of the test split."""
    scored = model.transform(model.test)
    return scored.select(F.col("__target").alias("actual"), rounded(F.col("predicted"), 4).alias("predicted"))


def coefficients(model: Regression) -> DataFrame:
    """(term, value) of a linear model, the intercept last."""
    fit = model.fitted.stages[-1]
    rows = [*zip(model.features, map(float, fit.coefficients)), ("intercept", float(fit.intercept))]
    return model.test.sparkSession.createDataFrame(rows, "term string, value double")


def feature_importance(model: Regression) -> DataFrame:
    """(feature, importance): shares in %, largest first; for a linear model shares of the
    absolute coefficients."""
    fit = model.fitted.stages[-1]
    weights = [abs(float(w)) for w in (fit.coefficients if model.kind == "linear" else fit.featureImportances.toArray())]
    total = sum(weights)
    rows = [(f, w / total * 100 if total else 0.0) for f, w in zip(model.features, weights)]
    frame = model.test.sparkSession.createDataFrame(rows, "feature string, importance double")
    return frame.select("feature", rounded(F.col("importance"), 2).alias("importance")).orderBy(
        F.desc("importance"), "feature")


def predict(model: Regression, df: DataFrame) -> DataFrame:
    """The table plus ``predicted``; unseen texts count as -1 and missing numbers as 0."""
    encoded = encode(df, model.features, model.labels)
    names = [f"f_{i}" for i in range(len(model.features))]
    encoded = encoded.withColumns({n: F.coalesce(n, F.lit(0.0)) for n in names})
    return model.transform(encoded).drop(*names).withColumn("predicted", rounded(F.col("predicted"), 4))
