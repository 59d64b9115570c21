"""State per key for micro-batches, as a table in the shared folder.

State rows are filed in buckets by a hash of their key. A batch reads and rewrites the
buckets of its own keys only; a bucket keeps the version (batch number) that wrote it
last, and a small manifest per batch maps buckets to versions. Work per batch therefore
follows the keys of the batch, not the keys ever seen, up to the size of a bucket; give
`buckets` so that a bucket of the keys alive at a time fits a task.

The manifest is written last. It commits state and outputs together: outputs of a batch
without a manifest are not read. A batch that is repeated after a failure starts from the
manifest before it and writes the same folders again. Versions that neither the last two
manifests name are removed.

Each batch also visits some buckets in turn, so that keys which are silent for good are
seen by the step, and can leave, within `SWEEP` batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsight.session import shared_dir
from opsight.sources import files

#: Batches after which every bucket has been visited.
SWEEP = 16



class Marks(NamedTuple):
    """What is known of a batch before its step: the latest time seen, in microseconds, by earlier
    batches and with this one (None before any), and the most rows of it that one bucket, and so
    one key, can have."""

    before: int | None
    after: int | None
    largest: int


#: step(batch, state rows or None, marks) gives outputs by name and the next state rows
Step = Callable[[DataFrame, DataFrame | None, Marks], tuple[dict[str, DataFrame], DataFrame]]


@dataclass(frozen=True)
class Manifest:
    """Version of each bucket that has rows, and the latest time seen, in microseconds."""

    versions: dict[int, int]
    mark: int | None = None


@dataclass(frozen=True)
class KeyedState:
    """Where the state of `keys` lies. `ts` names the column whose largest value is the time mark."""

    folder: str
    keys: tuple[str, ...]
    ts: str | None = None
    buckets: int = 64

    def _manifest(self, batch_id: int) -> str:
        return f"{self.folder}/manifests/{batch_id}"

    def manifest(self, spark: SparkSession, batch_id: int) -> Manifest:
        text = files.read_text(spark, self._manifest(batch_id))
        if text is None:
            if batch_id >= 0:
                raise FileNotFoundError(f"no manifest of batch {batch_id} in {self.folder}")
            return Manifest({})
        raw = json.loads(text)
        return Manifest({int(b): v for b, v in raw["versions"].items()}, raw["mark"])

    def last_batch(self, spark: SparkSession) -> int:
        """The last batch whose manifest is there; -1 before the first."""
        return max((int(n) for n in files.names(spark, f"{self.folder}/manifests") if n.isdigit()), default=-1)

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int") if self.keys else F.lit(0)

    def rows(self, spark: SparkSession, manifest: Manifest, wanted: Sequence[int] | None = None) -> DataFrame | None:
        """State rows of the wanted buckets (all by default), None if these have none."""
        chosen = [b for b in (manifest.versions if wanted is None else wanted) if b in manifest.versions]
        paths = [f"{self.folder}/state/v{manifest.versions[b]}/_b={b}" for b in chosen]
        return spark.read.parquet(*paths) if paths else None

    def current(self, spark: SparkSession) -> DataFrame | None:
        """All state rows after the last batch."""
        return self.rows(spark, self.manifest(spark, self.last_batch(spark)))

    def write(self, spark: SparkSession, following: DataFrame, batch_id: int, before: Manifest, visited: Sequence[int], mark: int | None) -> None:
        """Write the visited buckets as version batch_id, then the manifest; drop what nobody can ask for."""
        path = f"{self.folder}/state/v{batch_id}"
        filed = following.withColumn("_b", self.bucket()).repartition("_b")
        filed.write.mode("overwrite").partitionBy("_b").parquet(path)
        there = {int(n[3:]) for n in files.names(spark, path) if n.startswith("_b=")}
        versions = {b: v for b, v in before.versions.items() if b not in set(visited)} | {b: batch_id for b in there}
        files.put_text(spark, self._manifest(batch_id), json.dumps({"versions": versions, "mark": mark}))
        old = self._manifest(batch_id - 2)
        if files.exists(spark, old):
            gone = self.manifest(spark, batch_id - 2).versions.items() - before.versions.items()
            for b, v in gone:
                files.delete(spark, f"{self.folder}/state/v{v}/_b={b}")
            files.delete(spark, old)

    def seed(self, rows: DataFrame) -> None:
        """State rows to begin with. Does nothing once a batch has run or a seed was written."""
        spark = rows.sparkSession
        if not files.names(spark, f"{self.folder}/manifests"):
            self.write(spark, rows, -1, Manifest({}), range(self.buckets), None)


def batch_function(step: Step, state: KeyedState) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls: run the step over the state of the batch's keys and commit."""

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = state.manifest(spark, batch_id - 1)
        batch = batch.persist()
        try:
            latest = F.max(F.unix_micros(F.col(state.ts).cast("timestamp"))) if state.ts else F.lit(None).cast("long")
            # one row per bucket
            found = batch.groupBy(state.bucket().alias("b")).agg(latest.alias("t"), F.count(F.lit(1)).alias("n")).collect()
            marks = [r["t"] for r in found if r["t"] is not None] + ([] if before.mark is None else [before.mark])
            mark = max(marks, default=None)
            visited = sorted({r["b"] for r in found} | {b for b in before.versions if b % SWEEP == batch_id % SWEEP})
            outputs, following = step(batch, state.rows(spark, before, visited), Marks(before.mark, mark, max((r["n"] for r in found), default=0)))
            for name, out in outputs.items():
                out.write.mode("overwrite").parquet(f"{state.folder}/{name}/batch={batch_id}")
            state.write(spark, following, batch_id, before, visited, mark)
        finally:
            batch.unpersist()

    return process


def run_keyed(stream: DataFrame, step: Step, state: KeyedState, available_now: bool = True):
    """Run `step` on every micro-batch; outputs land below the state's folder, see `output`."""
    shared_dir(stream.sparkSession)
    writer = stream.writeStream.foreachBatch(batch_function(step, state)).option("checkpointLocation", f"{state.folder}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def output(spark: SparkSession, state: KeyedState, name: str) -> DataFrame:
    """Rows of a named output of all batches that were committed."""
    last = state.last_batch(spark)
    ids = [n for n in files.names(spark, f"{state.folder}/{name}") if n.startswith("batch=") and int(n[6:]) <= last]
    if not ids:
        raise FileNotFoundError(f"no output {name} in {state.folder}")
    return spark.read.parquet(*[f"{state.folder}/{name}/{n}" for n in ids])
