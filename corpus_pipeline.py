"""The corpus pipeline: documents through five stages, each written and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from prismata.llm import decontamination, language_model, mixing, ngram_join, queries, sharding, toxicity
from prismata.llm.scratch import Scratch, passing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ROW = "__row"
BROADCAST_BYTES = 16 << 20


def filter_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored 0.3 or more go, each by its own text; the index learns from the labelled rows that aren't held out.

    Null and empty texts get the score of texts without words. Null and repeated ids decide nothing: of rows that share
    an id each stays or goes by itself. Without labels, and from an empty table, nothing goes. Other columns than those
    of documents are left out.
    """
    docs = docs.select(*COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    index = toxicity.train(docs.where(~language_model.held_out(4)), labels)
    return toxicity.drop_toxic(docs, index)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked at a Jaccard similarity of 0.8 one stays: that of the smallest id, null ids last; of equal ids any one.

    Each row has a key of its own, given when the stage's input is written, so that null and repeated ids are told
    apart. Null, empty and blank texts are linked with nothing and stay. An empty table stays empty.
    """
    scratch = Scratch(spark, "join-near-copies")
    docs = scratch.write(docs.select(*COLUMNS).withColumn(ROW, F.monotonically_increasing_id()), "keyed")
    linked = ngram_join.ngram_jaccard_join(docs, ROW).where("n_links > 0").select(ROW, "component_id")
    linked = scratch.write(linked.join(docs.select(ROW, "doc_id"), ROW), "linked")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW))[ROW].alias("__first")
    kept = linked.groupBy("component_id").agg(first)
    gone = scratch.write(linked.join(kept, F.col(ROW) == F.col("__first"), "left_anti").select(F.col(ROW).alias("__gone")), "gone")
    small = gone.count() * 8 <= BROADCAST_BYTES  # keys of eight bytes
    return docs.join(F.broadcast(gone) if small else gone, F.col(ROW) == F.col("__gone"), "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text holds a copy of a benchmark item go. Null and empty texts stay, ids decide nothing; without items nothing goes."""
    return decontamination.drop_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated by Poisson counts towards the source weights and put in random order.

    A null source is a source of its own, a null text has size one; rows that repeat an id get the same count each.
    """
    return mixing.mix_sources(docs).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy gets the shard that the lookup table gives its id; null ids share one, as equal ids do."""
    return sharding.assign_shards(docs, queries.SHARDS, queries.TABLE_SIZE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", filter_toxic),
    ("jaccard_join", join_near_copies),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

ORACLE_SQL: str | None = None  # nearest-neighbour votes and alignments have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a Parquet table in the shared folder that the next stage reads."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with passing():  # the tables of a stage's own go when its result is written, and then its input
            docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
