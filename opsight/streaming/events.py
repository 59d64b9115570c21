"""Event-driven operators (E1-E9) over rows of changes. Each takes and returns
DataFrames and works on a batch; those without state work on streams as well,
the others have a streaming form in `opsight.streaming.stateful`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsight.functions.text import (
    DOMAIN_RULES, action_tag, classified, fingerprint, percent_decoded, session_tag,
    status_comment, text_chunks,
)
from opsight.operators.intervals import Validity
from opsight.operators.joins import effective_dated_lookup
from opsight.operators.scan import (
    lag, null_safe, ordered_scan, row_number,
)

PROCESSING = 7  # run status of a process at work: fixed value
JOB_TYPE = "PSJob"  # process type of containers, which do no work: fixed value
LABELLED_STATUSES = (3, 7, 8, 9, 10)  # fixed values
LEFT_STATUSES = (7, 8)  # fixed values


def with_old_value(
    history: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, old: str,
    max_group_rows: int | None = None,
) -> DataFrame:
    """Turn a history of values into change rows by adding the previous value."""
    return ordered_scan(history, keys, order, [lag(old, value)], max_group_rows)


def status_transitions(
    changes: DataFrame, status: str = "runstatus", old: str = "old_runstatus",
    working=PROCESSING, run_control_like: str | None = None,
) -> DataFrame:
    """Start when the status becomes `working`, End when it leaves it.

    Adds phase and the snapshot comment. With run_control_like only matching
    run controls count and a snapshot level is added: 5 at Start, 6 at End.
    Needs old and new value only, so it runs on streams of changes unchanged.
    """
    becomes = (F.col(status) == working) & (F.col(old) != working)
    leaves = (F.col(status) != working) & (F.col(old) == working)
    out = changes.where(becomes | leaves)
    if run_control_like is not None:
        out = out.where(F.col("runcntlid").like(run_control_like))
    out = out.withColumn("phase", F.when(F.col(status) == working, "Start").otherwise("End"))
    out = out.withColumn(
        "comment", status_comment("prcstype", "prcsname", "prcsinstance", "phase", "oprid")
    )
    if run_control_like is not None:
        out = out.withColumn("snap_level", F.when(F.col("phase") == "Start", 5).otherwise(6))
    return out


def pair_snapshots(
    snapshots: DataFrame, keys: Sequence[str] = ("prcsinstance", "statistic"),
    ts: str = "dttm", phase: str = "phase", values: Sequence[str] = ("db_value", "my_value"),
    tie: Sequence[str] = (), run_control_like: str | None = None,
    max_group_rows: int | None = None, known_bounded: bool = False,
) -> DataFrame:
    """Each End snapshot with the Start before it: <value>_before,
    <value>_after, begindttm, enddttm. An End with no open Start gives nothing."""
    if run_control_like is not None:
        snapshots = snapshots.where(F.col("runcntlid").like(run_control_like))
    scanned = ordered_scan(
        snapshots, keys, [ts, *tie], [lag("_prev", F.struct(phase, ts, *values))], max_group_rows, known_bounded,
    )
    paired = scanned.where((F.col(phase) == "End") & (F.col(f"_prev.{phase}") == "Start"))
    return paired.select(
        *keys,
        *[F.col(f"_prev.{v}").alias(f"{v}_before") for v in values],
        F.col(f"_prev.{ts}").alias("begindttm"),
        *[F.col(v).alias(f"{v}_after") for v in values],
        F.col(ts).alias("enddttm"),
    )


def archive_on_delete(changes: DataFrame, columns: Sequence[str], op: str = "op") -> DataFrame:
    """Every deleted row, with the table's own columns. Works on streams."""
    return changes.where(F.col(op) == "D").select(*columns)


def live_rows(table: DataFrame, archived: DataFrame, key: Sequence[str]) -> DataFrame:
    """What is left of the table after the deletes."""
    return table.join(archived.select(*key).distinct(), list(key), "left_anti")


def archive_counts(table: DataFrame, archived: DataFrame, live: DataFrame) -> DataFrame:
    """E4 check: rows before, archived and left; `balanced` says they add up."""
    def count(df, name):
        return F.broadcast(df.agg(F.count(F.lit(1)).alias(name)))

    return count(table, "rows_before").crossJoin(count(archived, "rows_archived")).crossJoin(
        count(live, "rows_live")
    ).withColumn(
        "balanced", F.col("rows_before") == F.col("rows_archived") + F.col("rows_live")
    )


def enrich_access(rows: DataFrame, slots: int = 8, rules=DOMAIN_RULES) -> DataFrame:
    """E5: decoded query strings and the domain, as rows arrive."""
    decoded = {f"query_string{i}": percent_decoded(f"query_string{i}") for i in range(1, slots + 1)}
    return rows.withColumns({**decoded, "domain": classified("url", rules)})


def enrich_sql_trace(rows: DataFrame) -> DataFrame:
    """E5: the statement's fingerprint beside its text, as rows arrive."""
    return rows.withColumn("fingerprint", fingerprint("operation"))


def progress(
    updates: DataFrame, totals: DataFrame, instance: str = "prcsinstance",
    order: Sequence[str] = ("gp_calc_ts",), employee: str = "emplid",
    max_group_rows: int | None = None,
) -> DataFrame:
    """Work done so far (0, 1, 2 ...) and in total per process, with the
    action text naming the current employee. totals: instance, total_work; a
    process without one has 0."""
    running = updates.where(F.col(instance) > 0)
    numbered = ordered_scan(
        running, [instance], [*order, employee], [row_number("_n")], max_group_rows
    )
    sizes = totals.select(F.col(instance).alias("_i"), "total_work")
    return numbered.join(sizes, numbered[instance] == sizes["_i"], "left").select(
        *updates.columns, (F.col("_n") - 1).alias("sofar"),
        F.coalesce("total_work", F.lit(0).cast("long")).alias("totalwork"),
        action_tag(instance, F.concat(F.lit("EMPLID="), F.col(employee).cast("string"))).alias(
            "action"),
    )


def trace_rules(
    changes: DataFrame, status: str = "runstatus", old: str = "old_runstatus",
    engine_type: str = "Application Engine", working=PROCESSING,
) -> DataFrame:
    """What tracing a starting process should get: enable (with or without
    binds), disable for processes of the engine type, or none. A decision only;
    no session is touched. Works on streams."""
    starts = changes.where(
        (F.col(status) == working) & (F.col(old) != working) & (F.col("prcstype") != JOB_TYPE)
    )
    wanted = F.coalesce(F.col("runcntlid").like("TRACE%"), F.lit(False))
    return starts.select(
        "*",
        F.when(wanted, "enable").when(F.col("prcstype") == engine_type, "disable")
        .otherwise("none").alias("decision"),
        (wanted & F.col("runcntlid").like("TRACE%BIND%")).alias("binds"),
        F.when(wanted, session_tag("prcstype", "prcsname", "prcsinstance", "servernamerun"))
        .alias("trace_tag"),
        action_tag("prcsinstance", F.lit("Processing")).alias("action"),
    )


MESSAGE_SET, MESSAGE_NUMBER = 65, 30  # the generic message with 9 parameters: fixed values


def next_sequence(
    rows: DataFrame, existing: DataFrame, key: str, order: Sequence[str], seq: str,
    max_group_rows: int | None = None,
) -> DataFrame:
    """Number new rows of a key on from its largest used number. As in the
    message log, a key whose number 1 is missing starts again at 1."""
    return number_on(rows, used_sequences(existing, key, seq), key, order, seq, max_group_rows)


def used_sequences(existing: DataFrame, key: str, seq: str) -> DataFrame:
    """Key and _max, the number after which new rows of the key go on; keys without number 1 have none."""
    return existing.groupBy(key).agg(
        F.when(F.max(F.col(seq) == 1), F.max(seq)).cast("long").alias("_max")
    )


def number_on(
    rows: DataFrame, used: DataFrame | None, key: str, order: Sequence[str], seq: str,
    max_group_rows: int | None = None, known_bounded: bool = False,
) -> DataFrame:
    """Rows numbered by `order` after _max of their key in `used`."""
    numbered = ordered_scan(rows, [key], order, [row_number("_n")], max_group_rows, known_bounded)
    if used is None:
        return numbered.select(*rows.columns, F.col("_n").alias(seq))
    known = used.select(F.col(key).alias("_k"), "_max")
    return numbered.join(known, null_safe(numbered, known, [(key, "_k")]), "left").select(
        *rows.columns, (F.col("_n") + F.coalesce("_max", F.lit(0))).alias(seq)
    )


def valid_messages(messages: DataFrame, instance: str, text: str) -> DataFrame:
    """Messages with a process and a text."""
    return messages.where((F.col(instance) > 0) & F.col(text).isNotNull() & (F.col(text) != ""))


def append_messages(
    messages: DataFrame, existing: DataFrame, order: Sequence[str],
    instance: str = "process_instance", text: str = "message", severity: str = "severity",
    max_group_rows: int | None = None, max_parts: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Message headers and their text pieces, numbered per process after
    the messages it already has. Messages without a process or text are ignored.
    max_parts keeps the first pieces of a text only; by default it is stored whole."""
    valid = valid_messages(messages, instance, text)
    numbered = next_sequence(valid, existing, instance, order, "message_seq", max_group_rows)
    return message_rows(numbered, instance, text, severity, max_parts)


def message_rows(
    numbered: DataFrame, instance: str, text: str, severity: str, max_parts: int | None,
) -> tuple[DataFrame, DataFrame]:
    """Headers and text pieces of messages that have their message_seq."""
    header = numbered.select(
        instance, "message_seq", F.lit(MESSAGE_SET).alias("message_set_nbr"),
        F.lit(MESSAGE_NUMBER).alias("message_nbr"),
        F.coalesce(F.col(severity), F.lit(0)).alias("message_severity"),
    )
    pieces = numbered.select(
        instance, "message_seq", F.posexplode(text_chunks(text, max_parts=max_parts)).alias("_p", "message_parm")
    ).select(instance, "message_seq", (F.col("_p") + 1).alias("parm_seq"), "message_parm")
    return header, pieces


def status_labels(
    changes: DataFrame, dated: DataFrame, as_of, status: str = "runstatus",
    old: str = "old_runstatus", instance: str = "prcsinstance",
) -> DataFrame:
    """Action text with the status label, for statuses of interest or
    processes leaving work. On a stream `dated` is the static side; for labels
    by a time column of a stream see `status_labels_at`."""
    labelled = effective_dated_lookup(_of_interest(changes, status, old), dated, status, as_of, name="status_label")
    return labelled.withColumn("action", action_tag(instance, F.col("status_label")))


def _of_interest(changes: DataFrame, status: str, old: str) -> DataFrame:
    return changes.where(
        (F.col(status).isin(list(LABELLED_STATUSES)) | F.col(old).isin(list(LEFT_STATUSES)))
        & (F.col("prcstype") != JOB_TYPE)
    )


def status_labels_at(
    changes: DataFrame, validity: Validity, ts: str, status: str = "runstatus",
    old: str = "old_runstatus", instance: str = "prcsinstance",
) -> DataFrame:
    """E9 with the label that was valid at each row's own time. Stateless: `changes` may be a stream."""
    found = validity.at(_of_interest(changes, status, old), status, ts, "status_label")
    missing = F.concat(F.lit("Status:"), F.col(status).cast("string"))
    labelled = found.withColumn("status_label", F.coalesce("status_label", missing))
    return labelled.withColumn("action", action_tag(instance, F.col("status_label")))
