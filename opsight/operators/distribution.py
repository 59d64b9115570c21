"""Size and time distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsight.operators.ranking import cumulative_by_value, share
from opsight.operators.scan import (
    last_before, null_safe, ordered_scan, row_number, running_sum,
)


def value_histogram(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows and volume per distinct value."""
    return df.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("num_messages"), F.sum(value).alias("volume")
    )


def message_size_cdf(
    df: DataFrame, value: str, keys: Sequence[str] = (), max_group_rows: int | None = None
) -> DataFrame:
    """Per distinct size, its share and the running share of messages and volume."""
    shares = share(
        value_histogram(df, value, keys),
        {"pct_messages": "num_messages", "pct_volume": "volume"}, keys,
    )
    outs = [running_sum("cum_messages", "pct_messages"), running_sum("cum_volume", "pct_volume")]
    return ordered_scan(shares, keys, [value], outs, max_group_rows)


def message_log_cdf(df: DataFrame, size: str, max_group_rows: int | None = None) -> DataFrame:
    """For every message the fraction of messages, and of traffic, in
    messages not larger than it.

    The scan runs over distinct sizes; rows get the result by a join, never by
    a sort of all rows in one task.
    """
    numbered = df.withColumn("_one", F.lit(1.0))
    shares = share(numbered, {"_rn": "_one", "_rb": size})
    table = cumulative_by_value(
        shares, size, {"prop_msg": "_rn", "prop_bndw": "_rb"}, (), max_group_rows
    ).withColumnRenamed(size, "_size")
    return df.join(table, df[size].eqNullSafe(table["_size"])).drop("_size")


def service_time_cdf(
    df: DataFrame, ts: str, service: str, start: str | Column, end: str | Column,
    digits: int = 2, max_group_rows: int | None = None,
) -> DataFrame:
    """Per day and service, running requests, time and their shares by
    service time. Zero-length requests are left out."""
    begin = F.col(start) if isinstance(start, str) else start
    finish = F.col(end) if isinstance(end, str) else end
    hist = (
        df.where(finish > begin)
        .select(F.date_trunc("DAY", F.col(ts)).alias("day"), F.col(service).alias("service"),
                F.round(finish - begin, digits).alias("svc_time"))
        .groupBy("day", "service", "svc_time")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_t", F.col("svc_time") * F.col("_n"))
    )
    keys = ["day", "service"]
    shares = share(hist, {"_pn": "_n", "_pt": "_t"}, keys)
    outs = [
        running_sum("num_requests", "_n"), running_sum("cum_svc_time", "_t"),
        running_sum("pct_request", "_pn"), running_sum("pct_cum_svc_time", "_pt"),
    ]
    return ordered_scan(shares, keys, ["svc_time"], outs, max_group_rows).select(
        *keys, "svc_time", "num_requests", "cum_svc_time", "pct_request", "pct_cum_svc_time"
    )


def rowwise_cdf(
    df: DataFrame, file: str, size: str, tie: Sequence[str], max_group_rows: int | None = None
) -> DataFrame:
    """Per file, messages by size with line / lines and running bytes / bytes.
    Empty messages count but are not shown. `tie` makes the row order total."""
    scanned = ordered_scan(
        df, [file], [size, *tie],
        [row_number("_line"), running_sum("_bytes", size)], max_group_rows,
    )
    totals = df.groupBy(F.col(file).alias("_file")).agg(
        F.count(F.lit(1)).alias("_lines"), F.sum(size).alias("_total")
    )
    return (
        scanned.join(totals, null_safe(scanned, totals, [(file, "_file")]))
        .where(F.col(size) > 0)
        .select(*df.columns, (F.col("_line") / F.col("_lines")).alias("prop_messages"),
                (F.col("_bytes") / F.col("_total")).alias("prop_traffic"))
    )


def carry_forward(
    df: DataFrame, value: str | Column, order: Sequence[str], keys: Sequence[str] = (),
    name: str = "carried", max_group_rows: int | None = None,
) -> DataFrame:
    """The last non-null value seen before a row, in line order.

    Without keys values cross processes, as the line-by-line script's do; give
    the process id as key for the evident intent.
    """
    return ordered_scan(df, keys, order, [last_before(name, value)], max_group_rows)
