"""Time series of monitoring samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsight.functions.text import host_of, port_of
from opsight.functions.timegrid import linear, time_ceil, time_floor, to_seconds
from opsight.operators.scan import (
    lag, lead, null_safe, ordered_scan, running_sum,
)

COUNTER = "1"  # metric type of counters; '2' is a gauge, '3' an identifier


def counter_delta(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], metrics: Mapping[str, str],
    max_group_rows: int | None = None, suffix: str = "",
) -> DataFrame:
    """Counters become differences; metrics maps value column to the column
    holding its type.

    A counter below its predecessor was reset: its value stands. The first
    sample of a counter is NULL. Other types pass through. With a suffix the
    result is added beside the raw value, without one it replaces it.
    """
    names = list(metrics)
    scanned = ordered_scan(
        df, keys, order, [lag("_prev", F.struct(*names))], max_group_rows
    )
    out = {}
    for value, kind in metrics.items():
        prev = F.col(f"_prev.{value}")
        is_counter = F.col(kind) == COUNTER
        out[value + suffix] = (
            F.when(is_counter & (F.col(value) < prev), F.col(value))
            .when(is_counter, F.col(value) - prev)
            .otherwise(F.col(value))
        )
    return scanned.withColumns(out).drop("_prev")


def with_lookback(
    df: DataFrame, ts: str, wide_from, narrow_from, to, compute, raw_positive: str | None = None
) -> DataFrame:
    """Run `compute` on [wide_from, to] so that the first kept row has a
    predecessor, then keep [narrow_from, to]. raw_positive names a column whose
    value before differencing must be above zero."""
    bound = [F.lit(x).cast("timestamp") for x in (wide_from, narrow_from, to)]
    wide = df.where(F.col(ts).between(bound[0], bound[2]))
    if raw_positive:
        wide = wide.withColumn("_raw", F.col(raw_positive))
    result = compute(wide).where(F.col(ts).between(bound[1], bound[2]))
    return result.where(F.col("_raw") > 0).drop("_raw") if raw_positive else result


def lead_pair(
    df: DataFrame, keys: Sequence[str], ts: str, metrics: Sequence[str],
    tie: Sequence[str] = (), max_group_rows: int | None = None,
) -> DataFrame:
    """Next time and next metric values as next_<column>."""
    scanned = ordered_scan(
        df, keys, [ts, *tie], [lead("_next", F.struct(ts, *metrics))], max_group_rows
    )
    return scanned.select(
        *df.columns, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in (ts, *metrics)]
    )


def resample_linear(
    df: DataFrame, keys: Sequence[str], ts: str, metrics: Sequence[str], step: int | str,
    tie: Sequence[str] = (), every_grid_point: bool = False, max_group_rows: int | None = None,
) -> DataFrame:
    """Metrics interpolated onto the grid.

    Each pair of neighbours closer than two steps gives at most one grid point,
    the first at or after the earlier sample, if it lies before the later one.
    `every_grid_point` gives all points between them instead. `step` is seconds
    or a column holding them.
    """
    pairs = lead_pair(df, keys, ts, metrics, tie, max_group_rows)
    secs = (F.lit(step) if isinstance(step, int) else F.col(step)).cast("long")
    gap = F.unix_micros(F.col(f"next_{ts}").cast("timestamp")) - F.unix_micros(
        F.col(ts).cast("timestamp")
    )
    close = pairs.where(F.col(f"next_{ts}").isNotNull() & (gap < secs * 2_000_000))
    return _interpolate(close, ts, metrics, secs, every_grid_point)


def _interpolate(close, ts, metrics, secs, every_grid_point):
    if every_grid_point:
        first = to_seconds(time_ceil(ts, secs))
        last = to_seconds(f"next_{ts}")
        points = F.when(first <= last, F.sequence(first, last, secs))
        close = close.withColumn("_at", F.explode(points)).withColumn(
            "adj_ts", F.timestamp_seconds("_at")
        ).drop("_at")
    else:
        close = close.withColumn("adj_ts", time_ceil(ts, secs))
    # the ceiling works on whole seconds, so a sample with a fraction may lie after it
    close = close.where(
        (F.col("adj_ts") >= F.col(ts).cast("timestamp"))
        & (F.col("adj_ts") < F.col(f"next_{ts}").cast("timestamp"))
    )
    return close.withColumns(
        {f"comp_{m}": linear(ts, m, f"next_{ts}", f"next_{m}", "adj_ts") for m in metrics}
    )


def resample_linear_by_server(
    df: DataFrame, keys: Sequence[str], identity: Sequence[str], ts: str,
    metrics: Sequence[str], step: int | str, tie: Sequence[str] = (),
    max_group_rows: int | None = None,
) -> DataFrame:
    """T4: T3 for samples of several servers: identity columns (server number,
    process) belong to the key and are not interpolated."""
    return resample_linear(
        df, [*keys, *identity], ts, metrics, step, tie, max_group_rows=max_group_rows
    )


def active_servers(
    samples: DataFrame, agents: DataFrame, systems: DataFrame, event_set: int = 1,
    event_id: int = 302, process_like: str = "PS%", domain_type: str = "01",
) -> DataFrame:
    """T5: distinct server processes per sampling bucket of active agents.

    Agents and systems are filtered and joined first; samples meet one small
    table, which Spark broadcasts when its size allows.
    """
    live = agents.where(
        (F.col("pm_agent_inactive") == "N") & (F.col("pm_domain_type") == domain_type)
    ).join(systems, "pm_systemid")
    picked = samples.where(
        (F.col("pm_event_defn_set") == event_set)
        & (F.col("pm_event_defn_id") == event_id)
        & F.col("pm_metric_value7").like(process_like)
    )
    joined = picked.join(live, "pm_agentid")
    return joined.select(
        "dbname", host_of("pm_host_port").alias("pm_host"),
        port_of("pm_host_port").alias("pm_port"), "pm_domain_name",
        time_floor("pm_agent_dttm", F.col("pm_sample_int")).alias("pm_agent_dttm"),
        "pm_instance", F.col("pm_metric_value1").alias("server_instance"),
        F.col("pm_metric_value7").alias("process"), F.col("pm_addtnl_descr").alias("service"),
    ).distinct()


def align_metrics(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Samples of two kinds with the same agent and time."""
    return left.join(right, list(on))


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, name: str,
    max_group_rows: int | None = None,
) -> DataFrame:
    """Median per group from counts per distinct value: running counts locate
    the middle, so no group's values are held in memory."""
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_n")
    )
    scanned = ordered_scan(hist, keys, [value], [running_sum("_upto", "_n")], max_group_rows)
    totals = hist.groupBy(*[F.col(k).alias(f"_b_{k}") for k in keys]).agg(
        F.sum("_n").alias("_total")
    )
    joined = scanned.join(totals, null_safe(scanned, totals, [(k, f"_b_{k}") for k in keys]))
    low = F.floor((F.col("_total") + 1) / 2)
    high = F.ceil((F.col("_total") + 1) / 2)
    before = F.col("_upto") - F.col("_n")

    def holds(position: Column) -> Column:
        return (before < position) & (position <= F.col("_upto"))

    return joined.groupBy(*keys).agg(
        ((F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))) / 2)
        .alias(name)
    )


def group_spread(
    df: DataFrame, level: str, values: Sequence[str], max_group_rows: int | None = None
) -> DataFrame:
    """Median, mean, standard deviation and count per level. One sample has
    deviation 0, as in the source database."""
    aggs = []
    for v in values:
        deviation = F.when(F.count(v) == 1, F.lit(0.0)).otherwise(F.stddev_samp(v))
        aggs += [F.avg(v).alias(f"avg_{v}"), deviation.alias(f"std_{v}")]
    out = df.groupBy(level).agg(*aggs, F.count(F.lit(1)).alias("num"))
    for v in values:
        med = exact_median(df, [level], v, f"med_{v}", max_group_rows)
        med = med.withColumnRenamed(level, "_level")
        out = out.join(med, out[level].eqNullSafe(med["_level"]), "left").drop("_level")
    return out


def linear_trend(df: DataFrame, x: str, ys: Sequence[str]) -> DataFrame:
    """One row with slope and intercept of each y over x."""
    return df.agg(
        *[f(F.col(y), F.col(x)).alias(f"{y}_{n}") for y in ys
          for n, f in (("m", F.regr_slope), ("c", F.regr_intercept))]
    )


def regression_over_all(df: DataFrame, x: str, ys: Sequence[str]) -> DataFrame:
    """Every row with the trend of all rows beside it."""
    return df.crossJoin(F.broadcast(linear_trend(df, x, ys)))


def load_vs_cpu(
    pairs: DataFrame, level: str, values: Sequence[str], max_group_rows: int | None = None
) -> DataFrame:
    """Spread per load level with the value predicted by the trend."""
    spread = group_spread(pairs, level, values, max_group_rows)
    with_trend = spread.crossJoin(F.broadcast(linear_trend(pairs, level, values)))
    return with_trend.withColumns(
        {f"{v}_y": F.col(level) * F.col(f"{v}_m") + F.col(f"{v}_c") for v in values}
    )


def busy_servers(
    samples: DataFrame, process: str, event_id: int = 302, idle: str = "(idle)"
) -> DataFrame:
    """T6 input: servers at work per agent and sample time."""
    return samples.where(
        (F.col("pm_event_defn_id") == event_id) & (F.col("pm_metric_value7") == process)
        & (F.col("pm_addtnl_descr") != idle)
    ).groupBy("pm_agentid", "pm_agent_dttm").agg(F.count(F.lit(1)).alias("num_active"))
