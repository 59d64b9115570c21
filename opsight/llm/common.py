"""Helpers of this subpackage: tables, tables written for later reads, text batches."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsight.session import DROP_SHUFFLES, delete_on_exit, written  # noqa: F401


#: Bytes of rows that a Python worker gets at once.
BATCH_BYTES = "8m"
#: The folder that holds the package.
ROOT = str(Path(__file__).resolve().parents[2])


def ready(spark: SparkSession, batch: str = BATCH_BYTES) -> SparkSession:
    """Let Python workers find the package where it lies on the driver's path alone, and bound their batches.

    A cluster whose nodes lack that folder gets the package with --py-files.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch)
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, known)))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str, batch: str = BATCH_BYTES) -> DataFrame:
    return ready(spark, batch).read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, taken: Sequence[str]) -> str:
    """A column name of this kind that is not taken, whatever the case of its letters."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name += "_"
    return name


def give_back() -> None:
    """Return the memory that a Python worker has freed to the machine: idle workers stay alive beside busy ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; elsewhere there is no need
    if trim is not None:
        trim(0)


def share(key: Column, limit: int, total: int) -> Column:
    """Pick about `limit` of `total` rows, the same ones on every run, by a hash of key."""
    if total <= limit:
        return F.lit(True)
    steps = 1 << 30
    return F.pmod(F.xxhash64(key), F.lit(steps)) < F.lit(int(steps * limit / total))
