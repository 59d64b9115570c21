"""Tables that are replaced or added to as a whole.

A replaced table is a folder of versions beside a small pointer file that names the one
that counts. A load writes a new version first and moves the pointer last, so a load that
fails, or a driver that dies, leaves the table as it was. The version before is kept for
readers that have opened it; older ones, and those no pointer ever named, are removed.

An added load is a partition of its own, named by its load id. Writing it again replaces
it, so a repeated append does not double rows.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from opsight.sources import files

POINTER = "_current"
#: Column of the load id in a table that is added to.
LOAD = "load_id"


def _pointer(spark: SparkSession, path: str) -> list[str]:
    text = files.read_text(spark, f"{path}/{POINTER}")
    return json.loads(text) if text else []


def replace_load(df: DataFrame, path: str, partition_by=()) -> DataFrame:
    """Put the rows of df in the place of the table's, whole or not at all.

    df may read the table it replaces. Returns the table as loaded. Loads of one table
    follow one another: the last to end counts.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(f"{path}/{version}")
    kept = [version, *_pointer(spark, path)[:1]]
    files.put_text(spark, f"{path}/{POINTER}", json.dumps(kept))
    for name in files.names(spark, path):
        if name.startswith("v-") and name not in kept:
            files.delete(spark, f"{path}/{name}")
    return current(spark, path)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last load that ended."""
    versions = _pointer(spark, path)
    if not versions:
        raise FileNotFoundError(f"{path} has not been loaded")
    return spark.read.parquet(f"{path}/{versions[0]}")


def append_load(df: DataFrame, path: str, load_id: str, partition_by=()) -> DataFrame:
    """Add the rows of df as load `load_id`, in the place of what that load wrote before.

    Other loads are not touched, and a load that fails leaves what was there. A load of
    no rows empties its partition. Returns the table of all loads, without the load id.
    """
    spark = df.sparkSession
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", load_id):
        raise ValueError("a load id is made of letters, digits and _ . -")
    if LOAD in df.columns:
        raise ValueError(f"column {LOAD} holds the load id")
    seen = Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("n")).withColumn(LOAD, F.lit(load_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(LOAD, *partition_by).parquet(path)
    if not seen.get["n"]:
        files.delete(spark, f"{path}/{LOAD}={load_id}")
    return loads(spark, path, df)


def loads(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The rows of all loads, with the columns of `like`."""
    schema = like.schema.add(LOAD, "string")
    return spark.read.schema(schema).parquet(path).drop(LOAD)


def materialize(df: DataFrame, path: str, load_id: str | None = None, partition_by=()) -> DataFrame:
    """Write rows and continue from what is written: a snapshot that replaces the one
    before, or with a load id a part of the table that can be repeated."""
    return replace_load(df, path, partition_by) if load_id is None else append_load(df, path, load_id, partition_by)
