"""Sharding by a permutation-filled lookup table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

HEX = 12  # hex digits taken of a hash: 48 bits


def hash_number(*parts: Column) -> Column:
    """A 48-bit number from the MD5 of the parts joined by colons; nulls count as the word null."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])), 1, HEX), 16, 10).cast("long")


def _number(text: str) -> int:
    import hashlib

    return int(hashlib.md5(text.encode()).hexdigest()[:HEX], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], size: int) -> list[int]:
    """The shard index of every slot. Shards take turns; each claims the next free slot of its own permutation.

    The permutation of a shard is offset + k * skip modulo the prime size, offset and skip from hashes of its name.
    """
    if not is_prime(size) or size < len(shards) or len(set(shards)) != len(shards) or not shards:
        raise ValueError("the table needs distinct shards and a prime size that is not below their number")
    at = [_number(f"offset:{s}") % size for s in shards]
    skip = [_number(f"skip:{s}") % (size - 1) + 1 for s in shards]
    table, filled = [-1] * size, 0
    while True:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            table[at[k]] = k
            filled += 1
            if filled == size:
                return table


def lookup_table(spark: SparkSession, shards: list[str], size: int) -> DataFrame:
    """(slot, shard): the filled table. Its size is a parameter, so it is bounded whatever the data."""
    names = F.array(*[F.lit(s) for s in shards])
    filled = F.split(F.lit(",".join(map(str, fill_table(shards, size)))), ",")
    slots = spark.range(1).select(F.posexplode(filled).alias("slot", "k"))
    return slots.select("slot", F.element_at(names, F.col("k").cast("int") + 1).alias("shard"))


def assign_shards(docs: DataFrame, shards: list[str], size: int = 2039, id_col: str = "doc_id") -> DataFrame:
    """Place each row: its id's hash modulo the table size is its slot, the slot names its shard.

    Returns the columns of ``docs`` plus slot and shard; input columns of those names are replaced.
    No shuffle: the table is broadcast and each row needs one lookup. Adding or losing a shard moves
    few slots besides its own. Loads differ by at most one slot a shard, so hot sources don't matter.

    A null id hashes as the word null; repeated ids share a shard. Empty input gives no rows.
    """
    own = [c for c in docs.columns if c.lower() not in ("slot", "shard")]
    placed = docs.select(*own).withColumn("slot", F.pmod(hash_number(F.lit("key"), F.col(id_col)), F.lit(size)).cast("int"))
    return placed.join(F.broadcast(lookup_table(docs.sparkSession, shards, size)), "slot", "left").select(*own, "slot", "shard")


def write_shards(placed: DataFrame, path: str) -> None:
    """Write rows placed by ``assign_shards`` as one folder a shard."""
    placed.write.partitionBy("shard").parquet(path)
