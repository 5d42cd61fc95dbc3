"""Mixing sources to target weights by Poisson replication; DataFrame functions only.

A source's mean repetition rate is its target share of the output over its size. Each
document draws its number of copies by inverting the Poisson distribution of that rate at
a number hashed from seed and doc_id, is exploded by it, and all copies are sorted by a
hash of (doc_id, copy). Nothing depends on partitions, so lost tasks repeat exactly.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from gridlore.llm.store import free

#: A Poisson number of a larger mean is drawn as a sum of equal parts of at most this mean.
PART_MEAN = 32.0


def uniform(*parts: str | Column, seed: int) -> Column:
    """52 bits of the MD5 of the parts (null: empty), as a bigint."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(p).cast("string") if isinstance(p, str)
                                                            else p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, flatten: float = 0.5,
                 total: int | None = None, source: str = "source") -> DataFrame:
    """(source, n, rate): mean copies of each document of a source.

    With ``weights`` a source's share of the output is its weight over all weights (a
    source not listed has none and goes); else shares follow size ** ``flatten`` (1 keeps
    the mix, 0 makes all sources equal). ``total`` documents are aimed at, by default as
    many as there are. Null is a source of its own.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        share = F.pow(F.col("n").cast("double"), F.lit(float(flatten)))
    else:
        listed = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else None
        share = F.coalesce(listed[F.col("source")].cast("double"), F.lit(0.0)) if weights else F.lit(0.0)
    sizes = sizes.withColumn("share", share)
    whole, rows = sizes.agg(F.sum("share"), F.sum("n")).first()
    aim = float(rows if total is None else total) if rows else 0.0
    rate = F.col("share") / F.lit(whole) * F.lit(aim) / F.col("n") if whole else F.lit(0.0)
    return sizes.select("source", "n", rate.alias("rate"))


def _distribution(rates: DataFrame) -> DataFrame:
    """Adds parts and cdf: chances of at most 0, 1, 2, ... copies in one part."""
    parts = F.greatest(F.ceil(F.col("rate") / PART_MEAN), F.lit(1)).cast("int")
    mean = F.col("rate") / F.col("parts")
    # beyond this count the remaining chance is below 2**-52, the grain of the hashed number
    last = F.ceil(mean + 9 * F.sqrt(mean) + 40).cast("int")
    start = F.struct(F.array(F.exp(-mean)).alias("cdf"), F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"))

    def add(state, k):
        p = state["p"] * mean / k
        return F.struct(F.array_append(state["cdf"], state["sum"] + p).alias("cdf"), p.alias("p"), (state["sum"] + p).alias("sum"))

    cdf = F.aggregate(F.sequence(F.lit(1), last), start, add, lambda s: s["cdf"])
    return rates.withColumn("parts", parts).withColumn("cdf", cdf)


def replicate(docs: DataFrame, rates: DataFrame, seed: int = 0, doc_id: str = "doc_id",
              source: str = "source") -> DataFrame:
    """Every document as often as its draw says, with ``copy`` (from 0) and ``shuffle_key``,
    sorted by (shuffle_key, doc_id, copy) over the whole cluster.

    Rows with equal doc_id get equal counts and keys; a null doc_id counts as the empty
    text. Null texts and empty tables pass through. All columns are kept; columns called
    copy or shuffle_key are replaced. ``rates`` has a row per source; sources without one
    go. The hot source is never grouped: it is joined to its one row of rates.
    """
    docs = docs.drop("copy", "shuffle_key")
    of, rate, places = free(docs, "__of", "__rate", "__n")
    table = _distribution(rates.where(F.col("rate") > 0)).select(
        F.struct(F.col("source")).alias(of), F.struct("parts", "cdf").alias(rate))
    few = table.limit(10_001).count() <= 10_000  # else both sides are shuffled and AQE splits hot sources
    joined = docs.join(F.broadcast(table) if few else table, F.col(f"{of}.source").eqNullSafe(F.col(source)))
    grain = float(2 ** 52)

    def draw(part: Column) -> Column:
        u = (uniform(doc_id, part, F.lit("copies"), seed=seed).cast("double") + 0.5) / grain
        return F.size(F.filter(f"{rate}.cdf", lambda c: c <= u))

    one = draw(F.lit(0))
    many = F.aggregate(F.transform(F.sequence(F.lit(0), F.col(f"{rate}.parts") - 1), draw), F.lit(0), lambda a, b: a + b)
    count = F.when(F.col(f"{rate}.parts") == 1, one).otherwise(many)
    counted = joined.withColumn(places, count).where(F.col(places) > 0)
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(places) - 1))).drop(of, rate, places)
    keyed = copies.withColumn("shuffle_key", uniform(doc_id, "copy", F.lit("order"), seed=seed))
    # the key is uniform, so equal parts of its range are equal shares of the rows: nothing is sampled
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.least(F.floor(F.col("shuffle_key") / grain * parts), F.lit(parts - 1)).cast("int")
    return keyed.repartitionById(parts, part).sortWithinPartitions("shuffle_key", doc_id, "copy")


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, flatten: float = 0.5, total: int | None = None,
        seed: int = 0, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """``replicate`` with the rates of ``source_rates``."""
    return replicate(docs, source_rates(docs, weights, flatten, total, source), seed, doc_id, source)
