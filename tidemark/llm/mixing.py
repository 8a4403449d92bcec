"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise

#: Rows of rates up to which they are sent to all executors: 100,000 names of sources, some megabytes.
BROADCAST_ROWS = 100_000


def unit_hash(*parts: Column) -> Column:
    """A number in (0, 1) from the md5 of the parts joined by `:`; the same in any engine."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def tempered_weights(docs: DataFrame, source: str = "source", power: float = 0.5) -> DataFrame:
    """source, weight: the share of each source raised to `power`; 1 keeps the natural mix, 0 levels all sources."""
    return docs.groupBy(F.col(source).alias("source")).agg(F.pow(F.count("*").cast("double"), F.lit(power)).alias("weight"))


def repetition_rates(docs: DataFrame, weights: DataFrame, source: str = "source", total: int | None = None) -> DataFrame:
    """source, rate: the mean number of times a document of the source is to appear, so that the expected rows are
    shared by weight and add up to `total` (all rows of `docs` when not given). A source without documents gets no row,
    and its weight no share."""
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    held = sizes.join(weights.select(F.col("source").alias("w_source"), "weight"), F.col("source").eqNullSafe(F.col("w_source")), "left")
    held = held.select("source", "n", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"))
    sums = held.agg(F.sum("weight").alias("w"), F.sum("n").alias("n")).first()  # two numbers
    if not sums.w:
        return held.select("source", F.lit(0.0).alias("rate"))
    return held.select("source", (F.col("weight") / F.lit(sums.w) * F.lit(float(sums.n if total is None else total)) / F.col("n")).alias("rate"))


def poisson_count(u: Column, rate: Column) -> Column:
    """The smallest k whose distribution function reaches `u`: inversion, summed from logarithms so that a large rate
    does not underflow. 8 standard deviations past the mean suffice for a `u` of 48 bits."""
    last = F.ceil(rate + 8 * F.sqrt(rate) + 24).cast("int")
    step = lambda acc, k: F.struct(
        (acc["log"] + F.log(rate / k)).alias("log"),
        (acc["sum"] + F.exp(acc["log"] + F.log(rate / k))).alias("sum"),
        (acc["n"] + F.when(acc["sum"] < u, 1).otherwise(0)).alias("n"))
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.lit(0).alias("n"))
    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["n"])).otherwise(0)


def mix_sources(docs: DataFrame, weights: DataFrame, seed: int = 42, source: str = "source", key: str = "doc_id", total: int | None = None) -> DataFrame:
    """Each document repeated a Poisson number of times with its source's mean rate, in a globally shuffled order.
    Returns the columns of `docs` with `replica` (from 0), `rate` and `order_key`.

    The count is the Poisson quantile of a hash of seed and key, so it needs no state and a lost task repeats it; rows
    with equal keys get equal counts. A row without a key is keyed by the hash of its columns. The rows are dealt out by a hash of seed, key and replica and sorted by it
    within each part: the order in a part is random, and so is the part. A source that `weights` lacks or gives no
    more than 0 disappears. Null sources are one source; null and empty texts are documents like others; an empty table
    gives no rows. Columns named `replica`, `rate` or `order_key` are replaced.

    The rates are one row per source. Up to BROADCAST_ROWS they are sent to all executors, so the texts are shuffled once
    only; beyond that both sides are shuffled by source and adaptive execution splits those with very many rows."""
    rates = materialise(repetition_rates(docs, weights, source, total).withColumnRenamed("source", "_source"), "rates")
    rates = F.broadcast(rates) if rates.count() <= BROADCAST_ROWS else rates
    rest = docs.drop("replica", "rate", "order_key")
    own = F.coalesce(F.col(key).cast("string"), F.md5(F.to_json(F.struct(*rest.columns)).cast("binary")))
    rated = rest.withColumn("_key", own).join(rates, rest[source].eqNullSafe(rates["_source"])).drop("_source")
    count = poisson_count(unit_hash(F.lit(seed), F.col("_key")), F.col("rate"))
    spread = rated.withColumn("_n", count).where("_n > 0").withColumn("replica", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    keyed = spread.withColumn("order_key", unit_hash(F.lit(seed), F.col("_key"), F.col("replica"))).drop("_key")
    return keyed.repartition("order_key").sortWithinPartitions("order_key", key, "replica")


