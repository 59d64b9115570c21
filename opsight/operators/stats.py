"""Grouped statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsight.functions.text import strip_instance_suffix
from opsight.functions.timegrid import elapsed_seconds, within_days
from opsight.operators.joins import range_assign
from opsight.operators.scan import null_safe

SUCCESS = (9, 11, 14)  # run statuses of finished, successful processes: fixed values


def service_summary(df: DataFrame, queue: str = "queue", service: str = "service",
                    ts: str = "stimestamp") -> DataFrame:
    """A1: first and last time and requests per queue and service."""
    return df.groupBy(queue, service).agg(
        F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"), F.count(F.lit(1)).alias("requests")
    )


def process_durations(
    df: DataFrame, by: Sequence[str] = ("prcstype", "prcsname"), as_of=None, days: int = 30,
    begin: str = "begindttm", end: str = "enddttm", status: str = "runstatus",
    statuses: Sequence[int] = SUCCESS,
) -> DataFrame:
    """A2: runs and their total and mean seconds, of finished successful runs
    begun in the last `days` days."""
    done = df.where(
        F.col(begin).isNotNull() & F.col(end).isNotNull() & F.col(status).isin(list(statuses))
    )
    if as_of is not None:
        done = done.where(within_days(begin, as_of, days))
    secs = elapsed_seconds(begin, end)
    return done.groupBy(*by).agg(
        F.count(F.lit(1)).alias("freq"), F.sum(secs).alias("dur"), F.avg(secs).alias("avg_dur")
    )


LOG_FILE_TYPES = ("LOG", "AET", "TRC")  # fixed values


def query_stats(
    processes: DataFrame, files: DataFrame, process: str = "PSQUERY", status: int = 9,
    skip: Sequence[str] = LOG_FILE_TYPES,
) -> DataFrame:
    """A3: mean, total and number of run seconds per query; the query is the
    output file's name without its instance suffix."""
    runs = processes.where((F.col("prcsname") == process) & (F.col("runstatus") == status))
    outputs = files.where(~F.col("cdm_file_type").isin(list(skip)))
    secs = elapsed_seconds("begindttm", "enddttm")
    return (
        runs.join(outputs, "prcsinstance")
        .select(strip_instance_suffix("filename", "prcsinstance").alias("qryname"),
                secs.alias("_secs"))
        .groupBy("qryname")
        .agg(F.avg("_secs").alias("avg_secs"), F.sum("_secs").alias("sum_secs"),
             F.count(F.lit(1)).alias("num_execs"))
    )


def weighted_total(df: DataFrame, by: Sequence[str], count: str, mean: str) -> DataFrame:
    """A4: sum of counts and of count x mean."""
    return df.groupBy(*by).agg(
        F.sum(count).alias("num_execs"), F.sum(F.col(count) * F.col(mean)).alias("total_time")
    )


def count_distinct(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """A5: exact count of distinct values in two steps - distinct pairs spread
    by (group, value), then counted - so a large group is not one task's work."""
    pairs = df.where(F.col(value).isNotNull()).select(*by, value).distinct()
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def statement_times(
    df: DataFrame, program: str = "bat_program_name", detail: str = "detail_id",
    executions: bool = True,
) -> DataFrame:
    """Executions and times in seconds per program and statement.

    The sums combine to one row per statement and task before their shuffle.
    Executions are distinct processes; they are counted apart, since counting
    them along would carry all sums through a shuffle by process.
    """
    ms = ["execute_time", "compile_time", "fetch_time", "retrieve_time"]
    sql = sum((F.col(c) for c in ms[1:]), F.col(ms[0]))

    def seconds(value) -> Column:
        return F.sum(value) / 1000

    times = df.groupBy(program, detail).agg(
        seconds("execute_time").alias("execute_time"),
        F.sum("execute_count").alias("execute_count"),
        seconds("peoplecodesqltime").alias("pc_sqltime"),
        seconds("peoplecodetime").alias("pc_time"), F.sum("peoplecodecount").alias("pc_count"),
        seconds(sql).alias("ae_sqltime"),
        seconds(sql + F.col("peoplecodesqltime")).alias("sqltime"),
        seconds(sql + F.col("peoplecodesqltime") + F.col("peoplecodetime")).alias("total_time"),
    )
    name = F.concat(F.coalesce(F.col(program), F.lit("")), F.lit("."),
                    F.coalesce(F.col(detail), F.lit("")))
    values = times.columns[2:]
    if not executions:
        return times.select(name.alias("detail_id"), *values)
    runs = count_distinct(df, [program, detail], "process_instance", "executions").select(
        F.col(program).alias("_p"), F.col(detail).alias("_d"), "executions"
    )
    joined = times.join(runs, null_safe(times, runs, [(program, "_p"), (detail, "_d")]), "left")
    return joined.select(
        name.alias("detail_id"),
        F.coalesce("executions", F.lit(0).cast("long")).alias("executions"), *values,
    )


def sampled_time(df: DataFrame, by: Sequence[str], seconds_per_sample: int = 10) -> DataFrame:
    """A10: each sample stands for a fixed number of seconds."""
    return df.groupBy(*by).agg((F.count(F.lit(1)) * seconds_per_sample).alias("ash_secs"))


def report_total(df: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Group lines and one grand total, marked by is_total."""
    grouped = df.groupBy(*by).agg(*[F.sum(m).alias(m) for m in measures])
    line = grouped.agg(*[F.sum(m).alias(m) for m in measures])
    line = line.select(
        *[F.lit(None).cast(grouped.schema[b].dataType).alias(b) for b in by], *measures,
        F.lit(1).alias("is_total"),
    )
    return grouped.withColumn("is_total", F.lit(0)).unionByName(line)


def column_counts(df: DataFrame, by: Sequence[str], name: str = "num_columns") -> DataFrame:
    """Columns per table or index."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


RUN_STAT_COLUMNS = ("execcount", "avgexectime", "avgfetchtime", "avgnumrows", "lastexecdttm",
                    "numkills")


def execution_stats(log: DataFrame) -> DataFrame:
    """The statistics a set of executions adds up to, per user and query."""
    return log.groupBy("oprid", "qryname").agg(
        F.count(F.lit(1)).alias("execcount"), F.avg("exectime").alias("avgexectime"),
        F.avg("fetchtime").alias("avgfetchtime"), F.avg("numrows").alias("avgnumrows"),
        F.when(F.count("execdttm") == F.count(F.lit(1)), F.max("execdttm")).alias("lastexecdttm"),
        F.sum(F.when(F.col("killedreason") == " ", 0).otherwise(1)).alias("numkills"),
    )


def running_stats_upsert(stats: DataFrame, log: DataFrame) -> DataFrame:
    """Statistics after all executions in the log: means merged by their
    counts, the latest time, kills added; new keys inserted.

    GREATEST with a NULL is NULL in the source database: one NULL time makes the
    latest time NULL for good. The log is aggregated before it meets the statistics.
    """
    key = ["oprid", "qryname"]
    old = stats.select(*key, *[F.col(c).alias(f"_o_{c}") for c in RUN_STAT_COLUMNS])
    merged = old.join(execution_stats(log), key, "full")
    known, fresh = F.col("_o_execcount").isNotNull(), F.col("execcount").isNotNull()

    def mean(column):
        total = F.col("_o_execcount") + F.col("execcount")
        both = (F.col(f"_o_{column}") * F.col("_o_execcount")
                + F.col(column) * F.col("execcount")) / total
        return F.when(known & fresh, both).when(known, F.col(f"_o_{column}")).otherwise(F.col(column))

    latest = F.when(
        known & fresh,
        F.when(F.col("_o_lastexecdttm").isNotNull() & F.col("lastexecdttm").isNotNull(),
               F.greatest("_o_lastexecdttm", "lastexecdttm")),
    ).when(known, F.col("_o_lastexecdttm")).otherwise(F.col("lastexecdttm"))
    zero = F.lit(0)
    return merged.select(
        *key, (F.coalesce("_o_execcount", zero) + F.coalesce("execcount", zero)).alias("execcount"),
        mean("avgexectime").alias("avgexectime"), mean("avgfetchtime").alias("avgfetchtime"),
        mean("avgnumrows").alias("avgnumrows"), latest.alias("lastexecdttm"),
        (F.coalesce("_o_numkills", zero) + F.coalesce("numkills", zero)).alias("numkills"),
    )


def snapshot_delta(
    before: DataFrame, after: DataFrame, keys: Sequence[str], values: Mapping[str, str] | Sequence[str],
) -> DataFrame:
    """After - before per key, where something changed."""
    names = list(values)
    b = before.select(*keys, *[F.col(v).alias(f"_b_{v}") for v in names])
    joined = after.join(b, list(keys))
    changed = F.lit(False)
    for v in names:
        changed = changed | (F.col(v) != F.col(f"_b_{v}"))
    return joined.where(changed).select(
        *keys, *[(F.col(v) - F.col(f"_b_{v}")).alias(f"{v}_delta") for v in names]
    )


def scenario_span(df: DataFrame, scenario: str = "scenario", ts: str = "timestamp") -> DataFrame:
    """First and last time and minutes between them per test scenario > 0."""
    return df.where(F.col(scenario) > 0).groupBy(scenario).agg(
        F.min(ts).alias("min_timestamp"), F.max(ts).alias("max_timestamp"),
        (elapsed_seconds(F.min(ts), F.max(ts)) / 60).alias("minutes"),
    )


def duplicate_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keys that break a unique index. An all-NULL key is not indexed and
    never conflicts; a partly NULL key does."""
    return df.where(F.coalesce(*[F.col(c).cast("string") for c in cols]).isNotNull()).groupBy(
        *cols
    ).agg(F.count(F.lit(1)).alias("num_rows")).where(F.col("num_rows") > 1)


def indexed_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows a unique index would hold - those with a non-NULL key part."""
    return df.agg(
        F.count(F.lit(1)).alias("table_rows"),
        F.count_if(F.coalesce(*[F.col(c).cast("string") for c in cols]).isNotNull()).alias(
            "indexed_rows"),
    )


def total_work_by_stream(
    segments: DataFrame, streams: DataFrame, value: str = "emplid", low: str = "emplid_from",
    high: str = "emplid_to", stream: str = "strm_num",
) -> DataFrame:
    """Segments per stream, by id range."""
    return range_assign(segments, streams, value, low, high).groupBy(stream).agg(
        F.count(F.lit(1)).alias("total_work")
    )


def total_work_by_group_list(
    segments: DataFrame, lists: DataFrame, value: str = "emplid", group: str = "group_list_id",
) -> DataFrame:
    """Segments per group list, by membership."""
    return segments.join(lists.select(group, value), value).groupBy(group).agg(
        F.count(F.lit(1)).alias("total_work")
    )
