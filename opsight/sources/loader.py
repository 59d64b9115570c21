"""Loading logs (S1-S7, S9): routing of lines, load accounting, per-file output. S8 and S10 are in `versions`."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsight.functions.rules import failed_rules
from opsight.sources.formats import (
    LogFormat, message_log, parsed, pipe_access_log, service_trace, sql_trace, w3c_access_log,
)

ACCEPTED, REJECTED, DISCARDED = "accepted", "rejected", "discarded"


@dataclass(frozen=True)
class LoadResult:
    """Lines with their route; the three outcomes are filters over one plan."""

    routed: DataFrame
    line: str = "value"

    @property
    def accepted(self) -> DataFrame:
        rows = self.routed.where(F.col("_route") == ACCEPTED)
        return rows.drop(self.line, "_raw", "_route", "_reasons")

    @property
    def rejected(self) -> DataFrame:
        rows = self.routed.where(F.col("_route") == REJECTED)
        return rows.select(self.line, F.col("_reasons").alias("reasons"))

    @property
    def discarded(self) -> DataFrame:
        return self.routed.where(F.col("_route") == DISCARDED).select(self.line)


def load_with_rejects(lines: DataFrame, fmt: LogFormat, line: str = "value") -> LoadResult:
    """Discard lines the format's filter drops, reject those that fail a
    conversion or rule, accept the rest. All columns come from a single
    projection, so batch and streaming inputs take the same path."""
    rows = parsed(lines, fmt, line)
    fields = fmt.fields(F.col("_cut"))
    rules = {f"{c} not convertible": ~(F.col(f"_raw.{c}").isNotNull() & F.col(c).isNull())
             for c, (raw, _) in fields.items() if raw is not None}
    rules.update(fmt.rules)
    kept = fmt.keep(F.col(line))
    routed = rows.withColumn("_reasons", F.when(kept, failed_rules(rules)))
    routed = routed.withColumn(
        "_route",
        F.when(~kept, DISCARDED).when(F.size("_reasons") > 0, REJECTED).otherwise(ACCEPTED),
    )
    return LoadResult(routed, line)


def load_report(result: LoadResult) -> DataFrame:
    """Lines read, loaded, rejected and discarded, in one pass."""
    route = F.col("_route")
    return result.routed.agg(
        F.count(F.lit(1)).alias("read"),
        F.count_if(route == ACCEPTED).alias("loaded"),
        F.count_if(route == REJECTED).alias("rejected"),
        F.count_if(route == DISCARDED).alias("discarded"),
    )


def within_error_limit(report: DataFrame, errors: int = 999999) -> DataFrame:
    """Whether the load stayed within the allowed number of rejects."""
    return report.withColumn("within_limit", F.col("rejected") <= errors)


def read_log_set(spark: SparkSession, glob: str, file: Column | None = None) -> DataFrame:
    """The lines of a set of files, with the file (by default its name) and their position.

    (file, block, seq) is the line order: a file is split into byte blocks, and
    seq grows along the lines of a block. See `line_numbers`.
    """
    return spark.read.text(glob).select(
        "value", (F.col("_metadata.file_name") if file is None else file).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    )


LINE_ORDER = ("block", "seq")


def line_numbers(lines: DataFrame, name: str = "line") -> DataFrame:
    """The lines of `read_log_set` with their number in their file, from 1.

    Blocks count their own lines; one row per block then says how many lines of its
    file come before it. No file is brought into one task.
    """
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"), F.min("seq").alias("_first"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        F.col("file").alias("_f"), F.col("block").alias("_b"), "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = (lines["file"] == starts["_f"]) & (lines["block"] == starts["_b"])
    return lines.join(starts, same).select(
        *lines.columns, (F.col("_before") + F.col("seq") - F.col("_first") + 1).alias(name))


def write_per_file_csv(df: DataFrame, path: str, file: str = "file", order: Sequence[str] = LINE_ORDER) -> None:
    """One folder of CSV with header per input file, in the given order.

    Rows are dealt by ranges of (file, *order), so a large input file becomes several
    parts, and the names of its parts rise with the order. Columns of LINE_ORDER, where
    they are the order, are not written.
    """
    out = df.repartitionByRange(F.col(file), *order).sortWithinPartitions(F.col(file), *order)
    if tuple(order) == LINE_ORDER:
        out = out.drop(*LINE_ORDER)
    out.write.mode("overwrite").partitionBy(file).option("header", True).csv(path)


def read_per_file_csv(spark: SparkSession, path: str, columns: str, file: str = "file") -> DataFrame:
    """The rows of `write_per_file_csv` with their place (part, seq) among those of their file."""
    schema = T.StructType.fromDDL(columns)
    rows = spark.read.option("header", True).option("basePath", path).schema(schema.add(file, "string")).csv(path)
    return rows.select("*", F.col("_metadata.file_name").alias("part"), F.monotonically_increasing_id().alias("seq"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def stream_lines(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Lines of files as they arrive in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


def ingest_pipe_access_log(spark, path: str, drop_first: bool = True) -> LoadResult:
    """S1."""
    return load_with_rejects(read_lines(spark, path), pipe_access_log(drop_first))


def ingest_w3c_access_log(spark, path: str, drop_first: bool = True) -> LoadResult:
    """S2."""
    return load_with_rejects(read_lines(spark, path), w3c_access_log(drop_first))


def ingest_service_trace(spark, path: str, queue: str, tz_shift_hours: int = 1) -> LoadResult:
    """S3."""
    return load_with_rejects(read_lines(spark, path), service_trace(queue, tz_shift_hours))


def ingest_sql_trace(spark, path: str, log_date: str, has_program: bool = True) -> LoadResult:
    """S4."""
    return load_with_rejects(read_lines(spark, path), sql_trace(log_date, has_program))


def ingest_message_log(spark, path: str, log_date: str) -> LoadResult:
    """S5."""
    return load_with_rejects(read_lines(spark, path), message_log(log_date))
