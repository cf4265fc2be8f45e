"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from prismata.llm.scratch import Scratch

HEX = 13  # hex digits of the hash that make a uniform number: 52 bits
PARTITION_BYTES = 64 << 20
PARTITIONS = 100_000  # beyond which partitions grow instead of their number


def unit_hash(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) from the MD5 of the seed and the columns; nulls count as the word null."""
    parts = [F.coalesce(c.cast("string"), F.lit("null")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts)), 1, HEX), 16, 10).cast("double") / F.lit(float(16**HEX))


def poisson_cdf(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... as an array that runs past the last value a 52-bit uniform number can reach."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    start = F.struct((-mean).alias("lp"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        lp = acc["lp"] + F.log(mean) - F.log(k.cast("double"))
        c = acc["c"] + F.exp(lp)
        return F.struct(lp.alias("lp"), c.alias("c"), F.concat(acc["all"], F.array(c)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["all"]


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = "mix", exponent: float = 0.7, epochs: float = 1.0, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Repeat each document by a Poisson count and put all copies in a random global order.

    A source of size s (bytes of text, one a document at least) whose share of the total target
    weight is w gets the mean repetition rate w * total * epochs / s, total being the size of all such sources. ``weights(source, weight)``
    names the targets; without it a source's weight is its size to the power ``exponent``. A document's
    count inverts the Poisson distribution at a hash of seed and id, so a rerun or a lost executor
    gives the same copies. No source is capped: its expected share is its weight.

    Returns the columns of ``docs`` plus copy_no (from 1), n_copies and shuffle_key, dealt to
    partitions by that key and sorted by it within each. Input columns of those names are replaced.

    A null source is a source of its own, a null text has size one. Sources that ``weights`` doesn't
    name, or gives no positive weight, are left out. Rows that repeat an id get the same count each.
    A null id hashes as the word null. Empty input gives no rows.
    """
    spark = docs.sparkSession
    size = F.greatest(F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(1)), F.lit(1)).cast("long")
    own = [c for c in docs.columns if c.lower() not in ("copy_no", "n_copies", "shuffle_key")]
    sizes = Scratch(spark, "mixing").write(docs.groupBy(F.col(source_col).alias("__source")).agg(F.sum(size).alias("__size")), "sizes")  # a row for each source, read several times
    if weights is None:
        rates = sizes.withColumn("__weight", F.pow(F.col("__size").cast("double"), F.lit(exponent)))
    else:
        named = weights.select(F.col(weights.columns[0]).alias("__name"), F.col(weights.columns[1]).cast("double").alias("__weight")).where("__weight > 0")
        named = named.groupBy("__name").agg(F.sum("__weight").alias("__weight"))
        rates = sizes.join(named, F.col("__source").eqNullSafe(F.col("__name"))).drop("__name")
    all_size, all_weight = rates.agg(F.sum("__size"), F.sum("__weight")).first()
    total, all_weight = float(all_size or 0), float(all_weight or 1)
    mean = F.col("__weight") / F.lit(all_weight) * F.lit(total * epochs) / F.col("__size")
    steps = rates.agg(F.coalesce(F.sum(F.lit(64) + mean + 12 * F.sqrt(mean) + F.octet_length(F.col("__source").cast("string"))), F.lit(0))).first()[0]
    rates = rates.select("__source", poisson_cdf(mean).alias("__cdf"))
    few = 8 * steps <= broadcast_bytes  # beyond that the join shuffles and adaptive execution splits hot sources
    rows = docs.select(*own).withColumn("__u", unit_hash(seed, F.col(id_col)))
    joined = rows.join(F.broadcast(rates) if few else rates, F.col(source_col).eqNullSafe(F.col("__source")))
    counted = joined.withColumn("n_copies", F.size(F.filter("__cdf", lambda c: c <= F.col("__u")))).drop("__cdf", "__source", "__u")
    copies = counted.where("n_copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col("copy_no").cast("string")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(int(total * epochs) // PARTITION_BYTES, PARTITIONS))
    return copies.withColumn("shuffle_key", key).repartition(parts, "shuffle_key").sortWithinPartitions("shuffle_key")
