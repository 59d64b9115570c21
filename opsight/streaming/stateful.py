"""Streaming forms of the event operators.

Stateless operators (`archive_on_delete`, `enrich_*`, `trace_rules`, `labels_at`) take
a streaming DataFrame as it is. Aggregations use Spark's own state with a watermark.
Operators that look at earlier rows of a key are steps for `keyed.run_keyed`: the state
rows of the batch's keys are put in front of the new ones and the batch operator does
the rest, so a busy key is cut into chunks here as well. A repeated batch starts from
the same state and overwrites its own output. Keys leave the state when they end, or
when they have been silent for too long; those go to `expired`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsight.operators.scan import group_row_limit, lag, ordered_scan, row_number, null_safe
from opsight.session import shared_dir
from opsight.streaming import events
from opsight.streaming.keyed import Marks, Step

#: How a partial aggregate of a window is made and how two of them become one.
PARTIALS = {"count": (F.count, F.sum), "sum": (F.sum, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _late(batch: DataFrame, state: DataFrame | None, keys, ts, tie=()):
    """(rows in time, rows that stand, by time and tie, before what their key has already shown)."""
    if state is None:
        return batch, batch.where(F.lit(False))
    seen = state.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(
        F.max(F.struct(ts, *tie)).alias("_seen")
    )
    place = F.struct(batch[ts], *[batch[c] for c in tie])
    cond = null_safe(batch, seen, [(k, f"_k_{k}") for k in keys]) & (place < seen["_seen"])
    return batch.join(seen, cond, "left_anti"), batch.join(seen, cond, "left_semi")


def _leaving(
    state: DataFrame, outputs: dict[str, DataFrame], ts: str, marks: Marks,
    ended: Column | None, max_idle_seconds: int | None,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Outputs and what stays in the state: ended keys leave, those silent for too long go to `expired`."""
    if ended is not None:
        state = state.where(~F.coalesce(ended, F.lit(False)))
    if max_idle_seconds is None:
        return outputs, state
    bound = None if marks.after is None else marks.after - max_idle_seconds * 1_000_000
    idle = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")) < F.lit(bound), F.lit(False))
    return {**outputs, "expired": state.where(idle)}, state.where(~idle)


def _last_rows(rows: DataFrame, keys, order, columns) -> DataFrame:
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r"))
    return last.select("_r.*")


def _fits(batch: DataFrame, marks: Marks, max_group_rows: int | None) -> bool:
    """Whether no key of the batch, with a row of state in front, is above the limit of a scan."""
    return marks.largest + 1 <= group_row_limit(batch.sparkSession, max_group_rows)


def previous_value_step(
    keys: Sequence[str], ts: str, tie: Sequence[str], value: str, old: str,
    finish: Callable[[DataFrame], DataFrame], max_group_rows: int | None = None,
    ended: Column | None = None, max_idle_seconds: int | None = None,
) -> Step:
    """E1, E7, E9 on a history of values: the state is the last row of each key; rows
    older than it go to `late`. `finish` turns change rows into the result. A key leaves
    when `ended` holds for its last row, or after max_idle_seconds of event time without
    a row; a key that has left begins anew, without an old value."""

    def step(batch, state, marks):
        fresh, late = _late(batch, state, keys, ts, tie)
        rows = fresh.withColumn("_old_row", F.lit(False))
        if state is not None:
            rows = state.withColumn("_old_row", F.lit(True)).unionByName(rows)
        fits = _fits(batch, marks, max_group_rows)
        changes = ordered_scan(rows, keys, [ts, *tie], [lag(old, value)], max_group_rows, fits)
        result = finish(changes.where(~F.col("_old_row")).drop("_old_row"))
        last = _last_rows(rows.drop("_old_row"), keys, [ts, *tie], batch.columns)
        return _leaving(last, {"result": result, "late": late}, ts, marks, ended, max_idle_seconds)

    return step


def pair_snapshots_step(
    keys: Sequence[str], ts: str, phase: str, values: Sequence[str], tie: Sequence[str] = (),
    max_age_seconds: int | None = None, max_group_rows: int | None = None,
) -> Step:
    """The state is the open Start of each key, which its End removes. A Start that
    stays open longer than max_age_seconds of event time goes to `expired`."""

    def step(batch, state, marks):
        rows = batch if state is None else state.unionByName(batch)
        fits = _fits(batch, marks, max_group_rows)
        paired = events.pair_snapshots(rows, keys, ts, phase, values, tie, None, max_group_rows, fits)
        last = _last_rows(rows, keys, [ts, *tie], batch.columns)
        return _leaving(last, {"result": paired}, ts, marks, F.col(phase) != "Start", max_age_seconds)

    return step


def progress_step(
    instance: str, order: Sequence[str], max_group_rows: int | None = None, ts: str | None = None,
    ended: Column | None = None, max_idle_seconds: int | None = None,
) -> Step:
    """The state is the number of updates seen per process and the time `ts` of the
    last. A process leaves once a row of it fulfils `ended`, or after max_idle_seconds."""
    if max_idle_seconds is not None and ts is None:
        raise ValueError("max_idle_seconds needs ts")

    def step(batch, state, marks):
        fits = _fits(batch, marks, max_group_rows)
        numbered = ordered_scan(batch, [instance], order, [row_number("_n")], max_group_rows, fits)
        done = F.lit(False) if ended is None else F.coalesce(ended, F.lit(False))
        last = F.max(ts) if ts else F.lit(None).cast("timestamp")
        counts = batch.groupBy(instance).agg(F.count(F.lit(1)).alias("_seen"), last.alias("_last"), F.max(done).alias("_done"))
        before = batch.sparkSession.createDataFrame([], counts.schema) if state is None else state
        known = before.select(F.col(instance).alias("_i"), F.col("_seen"))
        joined = numbered.join(known, numbered[instance].eqNullSafe(known["_i"]), "left")
        result = joined.select(*batch.columns, (F.col("_n") - 1 + F.coalesce("_seen", F.lit(0))).alias("sofar"))
        total = before.unionByName(counts).groupBy(instance).agg(
            F.sum("_seen").alias("_seen"), F.max("_last").alias("_last"), F.max("_done").alias("_done"))
        return _leaving(total, {"result": result}, "_last", marks, F.col("_done"), max_idle_seconds)

    return step


def append_messages_step(
    order: Sequence[str], instance: str = "process_instance", text: str = "message",
    severity: str = "severity", max_group_rows: int | None = None, max_parts: int | None = None,
) -> Step:
    """Headers and text pieces of new messages, numbered on from the largest number
    of their process. The state is that number per process; seed it with
    `events.used_sequences` of messages that were there before. A repeated batch gives
    its messages the same numbers. Within a batch messages are numbered by `order`."""

    def step(batch, state, marks):
        valid = events.valid_messages(batch, instance, text)
        used = None if state is None else state
        fits = _fits(batch, marks, max_group_rows)
        numbered = events.number_on(valid, used, instance, order, "message_seq", max_group_rows, fits)
        header, pieces = events.message_rows(numbered, instance, text, severity, max_parts)
        top = numbered.groupBy(instance).agg(F.max("message_seq").alias("_max"))
        if used is not None:
            top = used.unionByName(top).groupBy(instance).agg(F.max("_max").alias("_max"))
        return {"header": header, "pieces": pieces}, top

    return step


def archive_step(
    keys: Sequence[str], columns: Sequence[str], order: Sequence[str], op: str = "op",
) -> Step:
    """The state is the live table. Inserts and updates (any op but 'D') put a row in
    it, deletes take theirs out and put it into the output `archive`, in one commit: a
    row is in one of the two whatever is repeated. Changes of a key count by `order`."""

    def step(batch, state, marks):
        archived = events.archive_on_delete(batch, columns, op)
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(op, *columns), F.struct(*order)).alias("_r"))
        live = last.select("_r.*").where(F.col(op) != "D").select(*columns)
        if state is not None:
            changed = batch.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()
            same = null_safe(state, changed, [(k, f"_k_{k}") for k in keys])
            live = live.unionByName(state.join(changed, same, "left_anti").select(*columns))
        return {"archive": archived}, live

    return step


def split_late(rows: DataFrame, window_end: Column, mark: int | None, delay_seconds: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose window is open, rows whose window ended at or before mark less delay).

    mark is the latest time of earlier batches, in microseconds: the rule, and the
    watermark, by which Spark's windowed aggregations drop rows."""
    if mark is None:
        return rows, rows.where(F.lit(False))
    behind = F.coalesce(F.unix_micros(window_end) <= F.lit(mark - delay_seconds * 1_000_000), F.lit(False))
    return rows.where(~behind), rows.where(behind)


def windowed_step(
    ts: str, keys: Sequence[str], step_seconds: int, delay_seconds: int,
    aggregates: Mapping[str, tuple[str, str | None]] | None = None,
) -> Step:
    """T5 per micro-batch, with an output for late rows.

    aggregates: name -> (count, sum, min or max; column). A window goes to `result` once
    it ends at or before the latest time seen less the delay; a row of a window that was
    over before its batch goes to `late`, as it came. The state is the open windows, so
    it needs no key: run it on KeyedState(folder, (), ts, buckets=1)."""
    if 86400 % step_seconds:
        raise ValueError("step must divide a day")
    aggregates = aggregates or {"num_rows": ("count", None)}

    def step(batch, state, marks):
        seconds = F.unix_seconds(F.col(ts).cast("timestamp"))
        bucket = F.timestamp_seconds(F.floor(seconds / step_seconds) * step_seconds)
        end = lambda c: F.timestamp_seconds(F.unix_seconds(c) + step_seconds)
        rows, late = split_late(batch.withColumn("bucket", bucket), end(F.col("bucket")), marks.before, delay_seconds)
        made = [PARTIALS[kind][0](F.lit(1) if c is None else F.col(c)).alias(n) for n, (kind, c) in aggregates.items()]
        windows = rows.groupBy("bucket", *keys).agg(*made)
        if state is not None:
            merged = [PARTIALS[kind][1](n).alias(n) for n, (kind, _) in aggregates.items()]
            windows = windows.unionByName(state).groupBy("bucket", *keys).agg(*merged)
        still, over = split_late(windows, end(F.col("bucket")), marks.after, delay_seconds)
        return {"result": over, "late": late.drop("bucket")}, still

    return step


def running_stats_stream(stream: DataFrame, ts: str = "execdttm") -> DataFrame:
    """Statistics per user and query, for an update-mode sink. Spark combines each micro-batch per task before it touches the state."""
    return stream.groupBy("oprid", "qryname").agg(
        F.count(F.lit(1)).alias("execcount"), F.avg("exectime").alias("avgexectime"),
        F.avg("fetchtime").alias("avgfetchtime"), F.avg("numrows").alias("avgnumrows"),
        F.max(ts).alias("lastexecdttm"),
        F.sum(F.when(F.col("killedreason") == " ", 0).otherwise(1)).alias("numkills"),
    )


def windowed_counts_stream(
    stream: DataFrame, ts: str, keys: Sequence[str], step_seconds: int, delay: str,
) -> DataFrame:
    """T5 on a stream: rows per bucket of a step that divides a day, so Spark's
    epoch-anchored window equals the midnight-anchored grid. Rows later than
    `delay` are dropped by the watermark; `windowed_step` keeps them."""
    if 86400 % step_seconds:
        raise ValueError("step must divide a day")
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.window(ts, f"{step_seconds} seconds"), *keys)
        .agg(F.count(F.lit(1)).alias("num_rows"))
        .select(F.col("window.start").alias("bucket"), *keys, "num_rows")
    )


def run_to_table(stream: DataFrame, folder: str, mode: str = "append"):
    """Run a stateless or append-mode stream to parquet until the input is used up."""
    shared_dir(stream.sparkSession)
    return (
        stream.writeStream.outputMode(mode).format("parquet")
        .option("path", f"{folder}/result").option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start()
    )


def run_updates(stream: DataFrame, folder: str):
    """Run an aggregating stream in update mode: each micro-batch writes the
    keys it changed. `read_latest` gives the current value of every key."""

    def process(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result/batch={batch_id}")

    shared_dir(stream.sparkSession)
    return (
        stream.writeStream.outputMode("update").foreachBatch(process)
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )


def read_latest(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """The last written row of each key."""
    rows = spark.read.parquet(f"{folder}/result")
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(
        F.max_by(F.struct(*values), "batch").alias("_r")
    ).select(*keys, "_r.*")
