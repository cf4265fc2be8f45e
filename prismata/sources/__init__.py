"""Readers of model tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from prismata.model import TYPES, Model, ModelError, Relationship, Table

CATALOG = "table:"  # a source that begins so is a table of the session's catalog, not a file


def physical(table: str, column: str) -> str:
    """The name of a model column inside plans: no brackets, unique across tables."""
    return re.sub(r"\W", "_", table).lower() + "__" + re.sub(r"\W", "_", column).lower()


def read_table(spark: SparkSession, folder: str, table: Table) -> DataFrame:
    """The declared columns of a table's Parquet file or catalog table, cast to their model types and renamed.

    A folder is any URI that Spark reads. A declared column that the file lacks is an error; columns
    that are not declared are not read. Projection and filters reach the scan.
    """
    df = spark.table(table.source.removeprefix(CATALOG)) if table.source.startswith(CATALOG) else spark.read.parquet(f"{folder}/{table.source}")
    have = {c.lower(): c for c in df.columns}
    missing = [c.name for c in table.columns if (c.source or c.name).lower() not in have]
    if missing:
        raise ModelError(f"table {table.name} lacks the columns {', '.join(missing)}")
    kinds = dict(df.dtypes)
    cols = []
    for c in table.columns:
        name, want = have[(c.source or c.name).lower()], TYPES[c.data_type]
        col = F.col(f"`{name}`")
        cols.append((col if kinds[name] == want else col.cast(want)).alias(physical(table.name, c.name)))
    return df.select(*cols)


def read_model(spark: SparkSession, path: str) -> Model:
    """A model from a JSON file at any URI that Spark reads."""
    return Model.from_json("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def co_locate(spark: SparkSession, model: Model, folder: str, relationship: Relationship, target: str, buckets: int) -> Model:
    """Write both tables of a relationship in buckets of its key below ``target``, and the model that reads them there.

    Joins over the relationship then move neither table, which pays where the one side is too large to broadcast.
    Columns are written in their model types, since a cast key has no buckets.
    """
    for name, key in ((relationship.from_table, relationship.from_column), (relationship.to_table, relationship.to_column)):
        t = model.table(name)
        df = read_table(spark, folder, t).toDF(*[c.name for c in t.columns])
        named = f"co_located_{re.sub(r'[^a-z0-9]', '_', name.lower())}"
        df.write.bucketBy(buckets, key).sortBy(key).option("path", f"{target}/{named}").mode("overwrite").saveAsTable(named)
        model = model.apply([{"command": "setTableSource", "name": t.name, "source": CATALOG + named}])
    return model
