"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from prismata.llm.scratch import Scratch

HOT = 1000  # a group with more than one in so many of the rows is hot; there are fewer than this many


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Group rows of equal text; of each group the row with the largest id stays.

    Returns per row: ``id_col`` (cast to long), keep_id (id of the row that stays), group_size, kept, text_sha256.
    Each refinement hashes only rows that the one before left in a group of two or more, and moves
    keys, never texts. The groups are sums built before any shuffle. They return to the rows by broadcast where
    their checked size allows; beyond that hot groups do, of which there are fewer than ``HOT``, and the others by a
    shuffle in which no key has more than one in ``HOT`` of the rows.

    A null text is the empty text. A null id loses to any other; where all ids of a group are null,
    keep_id is null and all its rows stay. Rows that repeat id and text cannot be told apart and all
    of them stay. Texts of any length are hashed whole. Other columns are not read. Empty input gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"))
    length, head = F.octet_length("t").alias("len"), F.xxhash64(F.substring("t", 1, prefix)).alias("head")

    def small(df: DataFrame, row_bytes: int) -> bool:
        return df.count() * row_bytes <= broadcast_bytes

    def repeated(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        found = scratch.write(df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys), name)
        return F.broadcast(found) if small(found, 16) else found

    lengths = repeated(rows.select(length), ["len"], "lengths")
    prefixes = repeated(rows.select(length, head).join(lengths, "len", "left_semi"), ["len", "head"], "prefixes")
    left = rows.select("id", "t", length, head).join(prefixes, ["len", "head"], "left_semi")
    groups = left.select("id", F.sha2("t", 256).alias("sha")).groupBy("sha").agg(F.max("id").alias("keep_id"), F.count("*").alias("n")).where("n > 1")
    groups = scratch.write(groups, "groups")
    digests = rows.select("id", F.sha2("t", 256).alias("sha"))
    if small(groups, 96):
        out = digests.join(F.broadcast(groups), "sha", "left")
    else:
        total = docs.count()
        hot, rest = (groups.where(F.col("n") * HOT > total), groups.where(F.col("n") * HOT <= total))
        out = digests.join(F.broadcast(hot), "sha").unionByName(digests.join(F.broadcast(hot), "sha", "left_anti").join(rest, "sha", "left"))
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("id")).alias("kept"), F.col("sha").alias("text_sha256"))
