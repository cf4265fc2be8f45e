"""Connected components over an edge table, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prismata.llm.kernels import local_components
from prismata.llm.scratch import Scratch


SALTS = 8
ALONE = 2_000_000  # edges that one task joins
ROWS = 100_000  # rows of a batch that it returns


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of all edges, in one task."""
    held = [[np.asarray(batch.column(x)) for x in ("a", "b")] for batch in batches]
    if held:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = names[local_components(ends[: len(a)], ends[len(a) :], len(names))]
        for x in range(0, len(names), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(names[x : x + ROWS]), pa.array(root[x : x + ROWS])], names=["id", "root"])


def _salted(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Edges with the ``low`` of their ``a``. Those of a hub meet it in ``SALTS`` partitions, which adaptive execution splits further."""
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    copies = low.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(copies, ["a", "salt"]).drop("salt")


def _stars(edges: DataFrame) -> bool:
    """Whether each node either hangs under one smaller node that hangs under none, or has nodes hanging under it."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(id, root): for every node of ``edges(a, b)`` the smallest node it is connected to.

    Up to ``ALONE`` edges are joined in one task, as the plans of a round weigh on the driver whatever its data.
    Beyond that every round hangs each node's neighbours under the smallest of them, once for the larger
    neighbours and once for the smaller, and writes the edges to the shared folder, until all that is
    left are stars, or few enough for one task. The number of rounds grows with the logarithm of the longest chain;
    edges that are stars already take none. No edges give no rows. Nulls are not nodes.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, step = scratch.write(edges, f"{label}-0"), 0
    while (many := edges.count() > ALONE) and not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = _salted(both.where("b > a"), low).select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = _salted(large, low)
        small = small.select("a", F.col("low").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("low").alias("b")))
        step += 1
        edges = scratch.write(small.where("a <> b").distinct(), f"{label}-{step}")
        scratch.drop(f"{label}-{step - 1}")
    if not many:
        found = scratch.write(edges.coalesce(1).mapInArrow(_alone, "id long, root long"), f"{label}-roots")
        scratch.drop(f"{label}-{step}")
        return found
    roots = edges.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots)
