"""Tables written to the folder that the cluster shares, to cut lineage and to feed several readers."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_made: list[Scratch] = []
BATCH_BYTES = 8 << 20
BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Let the session cut Arrow batches at ``BATCH_BYTES``, as both sides of a Python worker hold several; a setting other than the default stays."""
    if spark.conf.get(BATCHES) in ("64MB", "67108864", "67108864b"):
        spark.conf.set(BATCHES, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset and all runs on this machine (tests), one temporary folder of this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="shared-"))
    return _own[0]


class Scratch:
    """Named Parquet tables of one run in a folder of its own below the shared one."""

    def __init__(self, spark: SparkSession, label: str):
        small_batches(spark)
        _made.append(self)
        self.spark, self.top = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.top}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.top}/{name}")

    def drop(self, name: str = "") -> None:
        """Delete a table that no later step reads, or all of the run."""
        jvm, path = self.spark._jvm, f"{self.top}/{name}".rstrip("/")
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def passing() -> Iterator[None]:
    """Delete at the end what was written inside: for steps whose results have been written elsewhere by then."""
    before = len(_made)
    yield
    for s in _made[before:]:
        s.drop()
    del _made[before:]
