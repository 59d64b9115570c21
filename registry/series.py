"""Time series queries."""

from pyspark.sql import functions as F

from opsight.functions import timegrid
from opsight.operators import series
from registry.base import big, micros, query, rnd, secs

MIDNIGHT = "epoch(date_trunc('day', ts))"
SOD = "(floor(epoch(ts)) - epoch(date_trunc('day', ts)))"


@query("events", sql=f"""
SELECT event_id,
  CAST({MIDNIGHT} + floor({SOD} / 420) * 420 AS BIGINT) AS at_floor,
  CAST({MIDNIGHT} + ceil({SOD} / 420) * 420 AS BIGINT) AS at_ceil,
  CAST({MIDNIGHT} + round({SOD} / 420, 0) * 420 AS BIGINT) AS at_round FROM events""")
def time_grid(events):
    """T1 on a step that does not divide a day."""
    return events.select("event_id", *[
        F.unix_seconds(f("ts", 420)).alias(n) for n, f in (
            ("at_floor", timegrid.time_floor), ("at_ceil", timegrid.time_ceil),
            ("at_round", timegrid.time_round))])


TYPES = "CASE WHEN event_type IN ('click', 'view') THEN '1' ELSE '2' END"


@query("events", sql=f"""
WITH e AS (SELECT *, {TYPES} AS kind, round(value * 2, 2) AS v2, '1' AS kind2,
    lag(value) OVER w AS p1, lag(round(value * 2, 2)) OVER w AS p2 FROM events
  WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
SELECT event_id, round(CASE WHEN kind = '1' AND value < p1 THEN value WHEN kind = '1'
    THEN value - p1 ELSE value END, 4) AS value,
  round(CASE WHEN v2 < p2 THEN v2 ELSE v2 - p2 END, 4) AS v2 FROM e""")
def counter_delta(events):
    """Counters, resets and gauges."""
    e = events.withColumns({"kind": F.expr(TYPES), "v2": F.round(F.col("value") * 2, 2),
                            "kind2": F.lit("1")})
    out = series.counter_delta(e, ["user_id", "event_type"], ["ts", "event_id"],
                               {"value": "kind", "v2": "kind2"})
    return out.select("event_id", rnd("value", 4), rnd("v2", 4))


@query("events", sql="""
WITH w AS (SELECT *, value AS raw FROM events
           WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'),
d AS (SELECT *, CASE WHEN value < lag(value) OVER p THEN value ELSE value - lag(value) OVER p END
      AS delta FROM w WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round(delta, 4) AS value FROM d WHERE raw > 0
  AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'""")
def counter_delta_with_lookback(events):
    """A wide read, a narrow report, raw value above zero."""
    def deltas(rows):
        return series.counter_delta(rows.withColumn("kind", F.lit("1")), ["user_id"],
                                    ["ts", "event_id"], {"value": "kind"})

    out = series.with_lookback(events, "ts", "2024-01-05 00:00:00", "2024-01-10 00:00:00",
                               "2024-01-20 00:00:00", deltas, "value")
    return out.select("event_id", rnd("value", 4))


@query("events", sql="""
SELECT event_id, epoch_us(lead(ts) OVER w) AS next_ts, lead(value) OVER w AS next_value
FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)""")
def lead_pair(events):
    """W9."""
    out = series.lead_pair(events, ["user_id", "event_type"], "ts", ["value"], ["event_id"])
    return out.select("event_id", micros("next_ts"), "next_value")


PAIRS = """
p AS (SELECT {cols}, ts, value, lead(ts) OVER w AS nts, lead(value) OVER w AS nv, step FROM src
      WINDOW w AS (PARTITION BY {keys} ORDER BY ts, event_id)),
c AS (SELECT *, date_trunc('day', ts) + to_seconds(CAST(ceil((floor(epoch(ts))
        - epoch(date_trunc('day', ts))) / step) * step AS BIGINT)) AS adj
      FROM p WHERE nts IS NOT NULL AND epoch_us(nts) - epoch_us(ts) < step::BIGINT * 2000000)"""
LINE = "value + (epoch_us({x}) - epoch_us(ts)) * (nv - value) / (epoch_us(nts) - epoch_us(ts))"


@query("events", sql=f"""
WITH src AS (SELECT *, 21600 AS step FROM events), {PAIRS.format(cols="event_id", keys="user_id")}
SELECT event_id, CAST(epoch(adj) AS BIGINT) AS adj_ts, round({LINE.format(x="adj")}, 5) AS comp_value
FROM c WHERE adj >= ts AND adj < nts""")
def resample_linear(events):
    """T3 with W9, T1, T2: at most one grid point per pair."""
    out = series.resample_linear(events, ["user_id"], "ts", ["value"], 21600, ["event_id"])
    return out.select("event_id", secs("adj_ts"), rnd("comp_value", 5))


@query("events", sql=f"""
WITH src AS (SELECT *, 10800 AS step FROM events), {PAIRS.format(cols="event_id", keys="user_id")},
g AS (SELECT *, unnest(generate_series(adj, nts, INTERVAL 10800 SECOND)) AS x FROM c)
SELECT event_id, CAST(epoch(x) AS BIGINT) AS adj_ts, round({LINE.format(x="x")}, 5) AS comp_value
FROM g WHERE x >= ts AND x < nts""")
def resample_linear_every_point(events):
    """T3 with all grid points of a pair."""
    out = series.resample_linear(events, ["user_id"], "ts", ["value"], 10800, ["event_id"],
                                 every_grid_point=True)
    return out.select("event_id", secs("adj_ts"), rnd("comp_value", 5))


@query("mon_samples", "mon_agents", "mon_systems", sql=f"""
WITH src AS (SELECT s.pm_instance_id AS event_id, s.pm_agentid, s.pm_metric_value7,
    s.pm_agent_dttm AS ts, s.pm_metric_value2 AS value, y.pm_sample_int * 4 AS step
  FROM mon_samples s JOIN mon_agents a USING (pm_agentid) JOIN mon_systems y USING (pm_systemid)
  WHERE s.pm_event_defn_id = 302), {PAIRS.format(cols="event_id", keys="pm_agentid, pm_metric_value7")}
SELECT event_id, CAST(epoch(adj) AS BIGINT) AS adj_ts, round({LINE.format(x="adj")}, 5) AS comp_value
FROM c WHERE adj >= ts AND adj < nts""")
def resample_linear_by_server(samples, agents, systems):
    """T4: identity columns in the key, a step per system."""
    rows = samples.where(F.col("pm_event_defn_id") == 302).join(agents, "pm_agentid").join(
        systems, "pm_systemid").withColumn("step", F.col("pm_sample_int") * 4)
    out = series.resample_linear_by_server(
        rows, ["pm_agentid"], ["pm_metric_value7"], "pm_agent_dttm", ["pm_metric_value2"], "step",
        ["pm_instance_id"])
    return out.select(F.col("pm_instance_id").alias("event_id"), secs("adj_ts"),
                      F.round("comp_pm_metric_value2", 5).alias("comp_value"))


@query("mon_samples", "mon_agents", "mon_systems", sql="""
SELECT DISTINCT dbname,
  CASE WHEN strpos(pm_host_port, ':') > 1 THEN split_part(pm_host_port, ':', 1) END AS pm_host,
  substr(pm_host_port, strpos(pm_host_port, ':') + 1) AS pm_port, pm_domain_name,
  CAST(epoch(date_trunc('day', pm_agent_dttm)) + floor((floor(epoch(pm_agent_dttm))
    - epoch(date_trunc('day', pm_agent_dttm))) / pm_sample_int) * pm_sample_int AS BIGINT)
    AS pm_agent_dttm, pm_instance, pm_metric_value1 AS server_instance,
  pm_metric_value7 AS process, pm_addtnl_descr AS service
FROM mon_samples JOIN mon_agents USING (pm_agentid) JOIN mon_systems USING (pm_systemid)
WHERE pm_agent_inactive = 'N' AND pm_domain_type = '01' AND pm_event_defn_set = 1
  AND pm_event_defn_id = 302 AND pm_metric_value7 LIKE 'PS%'""")
def active_servers(samples, agents, systems):
    """T5 with J1, T1, P10, P15, O5."""
    out = series.active_servers(samples, agents, systems)
    return out.withColumn("pm_agent_dttm", F.unix_seconds("pm_agent_dttm"))


SPREAD = """
s AS (SELECT level, count(*) AS num, median(cpu) AS med_cpu, avg(cpu) AS avg_cpu,
        CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(cpu) END AS std_cpu FROM pairs
      GROUP BY level)"""


@query("lineitem", sql=f"""
WITH pairs AS (SELECT l_quantity AS level, l_extendedprice AS cpu FROM lineitem), {SPREAD}
SELECT level, num, round(med_cpu, 4) AS med_cpu, round(avg_cpu, 4) AS avg_cpu,
  round(std_cpu, 4) AS std_cpu FROM s""")
def group_spread(lineitem):
    """Median, mean, deviation per level."""
    pairs = lineitem.select(F.col("l_quantity").alias("level"),
                            F.col("l_extendedprice").alias("cpu"))
    return series.group_spread(pairs, "level", ["cpu"]).select(
        "level", big("num"), rnd("med_cpu", 4), rnd("avg_cpu", 4), rnd("std_cpu", 4))


DAILY = """
e302 AS (SELECT user_id, date_trunc('day', ts) AS h, count(*) AS level FROM events
         WHERE event_type = 'view' GROUP BY 1, 2),
e300 AS (SELECT user_id, date_trunc('day', ts) AS h, value AS cpu FROM events
         WHERE event_type = 'click'),
pairs AS (SELECT level, cpu, e300.user_id FROM e302 JOIN e300 USING (user_id, h))"""


def _load_pairs(events):
    day = F.date_trunc("day", F.col("ts")).alias("h")
    e302 = events.where(F.col("event_type") == "view").groupBy("user_id", day).agg(
        F.count(F.lit(1)).alias("level"))
    e300 = events.where(F.col("event_type") == "click").select(
        "user_id", day, F.col("value").alias("cpu"))
    return series.align_metrics(e302, e300, ["user_id", "h"])


@query("events", sql=f"""
WITH {DAILY}, {SPREAD},
t AS (SELECT regr_slope(cpu, level) AS m, regr_intercept(cpu, level) AS c FROM pairs)
SELECT level, num, round(med_cpu, 4) AS med_cpu, round(std_cpu, 4) AS std_cpu,
  round(level * m + c, 4) AS cpu_y FROM s CROSS JOIN t""")
def load_vs_cpu(events):
    """T6 with J12, A8, A9."""
    return series.load_vs_cpu(_load_pairs(events), "level", ["cpu"]).select(
        big("level"), big("num"), rnd("med_cpu", 4), rnd("std_cpu", 4), rnd("cpu_y", 4))


@query("events", sql=f"""
WITH {DAILY}
SELECT user_id, level, cpu, round(m, 6) AS cpu_m, round(c, 6) AS cpu_c FROM pairs
CROSS JOIN (SELECT regr_slope(cpu, level) AS m, regr_intercept(cpu, level) AS c FROM pairs)""")
def regression_over_all(events):
    """W13 with A9: each pair with the trend of all."""
    return series.regression_over_all(_load_pairs(events), "level", ["cpu"]).select(
        "user_id", big("level"), "cpu", rnd("cpu_m"), rnd("cpu_c"))


@query("mon_samples", sql="""
SELECT pm_agentid, CAST(epoch(pm_agent_dttm) AS BIGINT) AS pm_agent_dttm, count(*) AS num_active
FROM (SELECT * REPLACE (date_trunc('day', pm_agent_dttm) AS pm_agent_dttm) FROM mon_samples)
WHERE pm_event_defn_id = 302 AND pm_metric_value7 = 'PSAPPSRV' AND pm_addtnl_descr <> '(idle)'
GROUP BY 1, 2""")
def busy_servers(samples):
    """T6 input: servers at work."""
    days = samples.withColumn("pm_agent_dttm", F.date_trunc("day", F.col("pm_agent_dttm")))
    return series.busy_servers(days, "PSAPPSRV").withColumn(
        "pm_agent_dttm", F.unix_seconds(F.col("pm_agent_dttm").cast("timestamp")))
