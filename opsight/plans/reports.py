"""Report compositions (R1-R10). Each aggregates first, writes the small
aggregate once where several steps read it, and ranks and shares that."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsight.functions.text import labelled_metric, nth_delimited_tail
from opsight.functions.timegrid import within_days
from opsight.operators import distribution, joins, ranking, series, stats
from opsight.session import stable

top_message_sizes = distribution.message_size_cdf  # R5
message_log = distribution.message_log_cdf  # R6
service_times = distribution.service_time_cdf  # R7
load_report = series.load_vs_cpu  # T6


def top_web_queries(
    access: DataFrame, n: int = 20, marker: str = "ICType=Query", slot1: str = "query_string1",
    slot2: str = "query_string2", duration: str = "duration",
) -> DataFrame:
    """The n queries with the largest total duration."""
    totals = stable(
        access.where((F.col(slot1) == marker) & F.col(slot2).isNotNull())
        .groupBy(slot2).agg(F.sum(duration).alias("duration"),
                            F.count(F.lit(1)).alias("executions"))
    )
    ranked = ranking.top_n_rank(totals, "duration", n, "durrank")
    return ranked.select(
        "durrank", nth_delimited_tail(slot2).alias("query_name"), "duration", "executions"
    ).orderBy("durrank", F.col("executions").desc())


def top_processes(
    requests: DataFrame, definitions: DataFrame, as_of=None, n: int = 5, days: int = 30,
    by: Sequence[str] = ("prcstype", "prcsname"), named_by: Sequence[str] | None = None,
) -> DataFrame:
    """R2: the n processes with the largest total run time, with definitions, which
    are found by all columns of `by` or those of named_by."""
    totals = stable(stats.process_durations(requests, by, as_of, days))
    top = ranking.top_n_rank(totals, "dur", n, "prcrnk")
    return joins.left_join_after_topn(top, definitions, named_by or by).orderBy("prcrnk", *by)


def ranked_shares(
    totals: DataFrame, n: int, rank_by: str, shares: dict[str, str], rank: str = "stmtrank"
) -> DataFrame:
    """Ranks at most n with shares over all groups and their running sums over
    the ranked ones. shares maps a prefix ('sqltime') to its column."""
    totals = stable(totals)
    with_shares = ranking.share(totals, {f"pct_{k}": v for k, v in shares.items()})
    top = ranking.top_n_rank(with_shares, rank_by, n, rank)
    top = top.withColumns({f"pct_{k}": F.col(f"pct_{k}") * 100 for k in shares})
    return ranking.cumulative(top, rank, {f"cum_{k}": f"pct_{k}" for k in shares})


def top_statements(timings: DataFrame, n: int = 20) -> DataFrame:
    """The n statements with the largest SQL time."""
    return ranked_shares(
        stats.statement_times(timings, executions=False), n, "sqltime",
        {"sqltime": "sqltime", "total_time": "total_time"},
    ).select(
        "stmtrank", "detail_id", "execute_count", "ae_sqltime", "pc_sqltime", "pc_time",
        "pct_sqltime", "cum_sqltime", "pct_total_time", "cum_total_time",
    )


def _top_by_time(totals: DataFrame, n: int) -> DataFrame:
    totals = stable(totals)
    shares = ranking.share(totals, {"_pct": "tottime"})
    return ranking.top_n_rank(shares, "tottime", n, "qryrank").withColumn(
        "pcttime", F.col("_pct") * 100
    ).drop("_pct")


def top_queries(query_stats: DataFrame, n: int = 10) -> DataFrame:
    """R4 from statistics: count x mean per user and query."""
    totals = stats.weighted_total(query_stats, ["oprid", "qryname"], "execcount", "avgexectime")
    return _top_by_time(
        totals.withColumnsRenamed({"num_execs": "totexec", "total_time": "tottime"}), n
    )


def top_logged_queries(log: DataFrame, as_of, n: int = 10, days: int = 7) -> DataFrame:
    """R4 from the execution log of the last days."""
    totals = log.where(within_days("execdttm", as_of, days)).groupBy("oprid", "qryname").agg(
        F.count(F.lit(1)).alias("totexec"), F.sum("exectime").alias("tottime")
    )
    return _top_by_time(totals, n)


def combined_message_sizes(df: DataFrame, sizes: Sequence[str], **options) -> DataFrame:
    """R5 over the union of several size columns (sent and received)."""
    stacked = df.select(F.explode(F.array(*[F.col(s) for s in sizes])).alias("jolt_bytes"))
    return distribution.message_size_cdf(stacked, "jolt_bytes", **options)


def event_catalogue(
    definitions: DataFrame, metrics: DataFrame, translate: DataFrame,
    key: Sequence[str] = ("pm_event_defn_set", "pm_event_defn_id"), prefix: str = "",
) -> DataFrame:
    """Definitions with 'n:id=label', type and type text of their metrics."""
    typed = joins.translate_labels(metrics, translate)
    attributes = ("pm_metriclabel", "pm_metrictype", "pm_metrictype_text")
    wide = joins.with_metric_labels(definitions, typed, list(key), attributes=attributes)
    shown = {
        f"metric{i}": F.concat(
            F.lit(f"{prefix}{i}:"), F.coalesce(F.col(f"pm_metricid_{i}").cast("string"), F.lit("")),
            F.lit("="), F.coalesce(F.col(f"pm_metriclabel{i}"), F.lit("")),
        ) for i in range(1, 8)
    }
    return wide.withColumns(shown)


def transaction_catalogue(
    definitions: DataFrame, metrics: DataFrame, translate: DataFrame, contexts: DataFrame,
    first_id_only: bool = True,
) -> DataFrame:
    """R8 for transactions, with three context labels. All three show the id of
    the first context; first_id_only=False shows each its own."""
    out = event_catalogue(
        definitions, metrics, translate, ("pm_trans_defn_set", "pm_trans_defn_id"), "M"
    )
    for i in (1, 2, 3):
        names = contexts.select(F.col("pm_contextid").alias(f"_c{i}"),
                                F.col("pm_contextlabel").alias(f"_l{i}"))
        out = out.join(names, F.col(f"pm_contextid_{i}") == F.col(f"_c{i}"), "left")
        shown = "pm_contextid_1" if first_id_only else f"pm_contextid_{i}"
        out = out.withColumn(
            f"context{i}",
            F.concat(F.lit(f"C{i}:"), F.coalesce(F.col(shown).cast("string"), F.lit("")),
                     F.lit("="), F.coalesce(F.col(f"_l{i}"), F.lit(""))),
        ).drop(f"_c{i}", f"_l{i}")
    return out


def event_report(
    samples: DataFrame, agents: DataFrame, systems: DataFrame, definitions: DataFrame,
    metrics: DataFrame, event_set: int | None = None, event_id: int | None = None,
    start=None, end=None, dbnames: Sequence[str] | None = None,
) -> DataFrame:
    """Samples with their labels and values as text. Labels are attached to
    the definitions, so a sample is joined twice, to two small tables."""
    if event_set is not None:
        samples = samples.where(F.col("pm_event_defn_set") == event_set)
    if event_id is not None:
        samples = samples.where(F.col("pm_event_defn_id") == event_id)
    if start is not None:
        samples = samples.where(F.col("pm_agent_dttm").between(
            F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    key = ["pm_event_defn_set", "pm_event_defn_id"]
    labelled = joins.with_metric_labels(
        definitions, metrics, key, attributes=("pm_metriclabel", "pm_metrictype")
    )
    out = joins.star_join(samples, agents, systems, labelled, dbnames)
    return out.withColumns({
        f"metric{i}": labelled_metric(i, f"pm_metriclabel{i}", f"pm_metric_value{i}")
        for i in range(1, 8)
    })


def event_delta_report(
    samples: DataFrame, agents: DataFrame, systems: DataFrame, definitions: DataFrame,
    metrics: DataFrame, event_set: int, event_id: int, wide_from, narrow_from, to,
    dbnames: Sequence[str] | None = None, max_group_rows: int | None = None,
) -> DataFrame:
    """R9 with counters as differences per agent and instance: rows from
    wide_from on are read so that the first row shown has a predecessor."""
    key = ["pm_event_defn_set", "pm_event_defn_id"]
    picked = samples.where(
        (F.col("pm_event_defn_set") == event_set) & (F.col("pm_event_defn_id") == event_id)
    )
    labelled = joins.with_metric_labels(
        definitions, metrics, key, attributes=("pm_metriclabel", "pm_metrictype")
    )

    def deltas(rows):
        joined = joins.star_join(rows, agents, systems, labelled, dbnames)
        types = {f"pm_metric_value{i}": f"pm_metrictype{i}" for i in range(1, 7)}
        named = joined.withColumns({
            f"pm_metriclabel{i}": F.coalesce(f"pm_metriclabel{i}", F.lit(f"{i}Unused"))
            for i in range(1, 8)
        })
        return series.counter_delta(
            named, ["pm_agentid", "pm_metric_value7"], ["pm_agent_dttm", "pm_instance_id"], types,
            max_group_rows,
        )

    return series.with_lookback(
        picked, "pm_agent_dttm", wide_from, narrow_from, to, deltas, "pm_metric_value1"
    )


def traced_statement_plans(
    log: DataFrame, detail: DataFrame, plans: DataFrame, trace_bit: int = 4096,
    process_instance=None,
) -> DataFrame:
    """Statements of traced processes with the root steps of plans whose id
    and remarks match their patterns; statements without a plan are kept."""
    from opsight.functions.rules import has_flag
    from opsight.functions.text import statement_type_from_ascii

    traced = log.where(has_flag("trace_level", trace_bit))
    if process_instance is not None:
        traced = traced.where(F.col("process_instance") == process_instance)
    stem = F.substr(F.col("detail_id"), F.lit(1), F.length("detail_id") - 1)
    statements = detail.join(traced, "process_instance").select(
        "process_instance",
        F.concat("process_name", F.lit("."), "detail_id").alias("statement"),
        F.concat("process_name", F.lit("."), stem, statement_type_from_ascii("detail_id"))
        .alias("id_pattern"),
        F.concat(F.col("process_instance").cast("string"), F.lit("-"), "run_cntl_id",
                 F.lit("(%)")).alias("remarks_pattern"),
        (F.col("execute_time") / 1000).alias("exec_secs"), "execute_count",
    )
    roots = plans.where(F.col("id") == 0).select("statement_id", "remarks")
    return joins.like_join(
        roots, statements, [("statement_id", "id_pattern"), ("remarks", "remarks_pattern")],
        how="left_patterns",
    ).select("process_instance", "statement", "remarks", "exec_secs", "execute_count")
