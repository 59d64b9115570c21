"""Grouped statistics queries."""

from pyspark.sql import functions as F

from opsight.operators import stats
from registry.base import big, micros, query, rnd


@query("svc_requests", sql="""
SELECT queue, service, epoch_us(min(stimestamp)) AS min_ts, epoch_us(max(stimestamp)) AS max_ts,
  count(*) AS requests FROM svc_requests GROUP BY 1, 2""")
def service_summary(requests):
    """A1."""
    return stats.service_summary(requests).select(
        "queue", "service", micros("min_ts"), micros("max_ts"), "requests")


@query("prc_requests", sql="""
SELECT concat(prcsname, '_RPT') AS qryname, round(avg(epoch(enddttm) - epoch(begindttm)), 4) AS avg_secs,
  CAST(sum(epoch(enddttm) - epoch(begindttm)) AS BIGINT) AS sum_secs, count(*) AS num_execs
FROM prc_requests WHERE runstatus = 9 AND servernamerun <> 'SRV MACHINERY-1' GROUP BY 1""")
def query_stats(requests):
    """A3 with P11: query names cut from output file names."""
    files = requests.select(
        "prcsinstance", F.concat("prcsname", F.lit("_RPT-"), F.col("prcsinstance").cast("string"),
                                 F.lit(".pdf")).alias("filename"),
        F.when(F.col("servernamerun") == "SRV MACHINERY-1", "LOG").otherwise("PDF").alias(
            "cdm_file_type"))
    runs = requests.withColumn("prcsname", F.lit("PSQUERY"))
    return stats.query_stats(runs, files).select(
        "qryname", rnd("avg_secs", 4), big("sum_secs"), big("num_execs"))


@query("lineitem", sql="""
SELECT l_returnflag, count(*) AS num_rows, count(DISTINCT l_extendedprice) AS num_values
FROM lineitem GROUP BY 1""")
def count_and_count_distinct(lineitem):
    """A5."""
    rows = lineitem.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("num_rows"))
    values = stats.count_distinct(lineitem, ["l_returnflag"], "l_extendedprice", "num_values")
    return rows.join(values, "l_returnflag")


@query("cat_fields", sql="SELECT recname, count(*) AS num_columns FROM cat_fields GROUP BY 1")
def column_counts(fields):
    """A12."""
    return stats.column_counts(fields, ["recname"])


UPSERT = """
n AS (SELECT oprid, qryname, count(*) AS c, avg(exectime) AS e, avg(fetchtime) AS f, avg(numrows) AS r,
        max(execdttm) AS l, sum(CASE WHEN killedreason = ' ' THEN 0 ELSE 1 END) AS k
      FROM qry_log GROUP BY 1, 2)"""


@query("qry_stats", "qry_log", sql=f"""
WITH {UPSERT}
SELECT oprid, qryname, CAST(coalesce(execcount, 0) + coalesce(c, 0) AS BIGINT) AS execcount,
  round(CASE WHEN c IS NULL THEN avgexectime WHEN execcount IS NULL THEN e
    ELSE (avgexectime * execcount + e * c) / (execcount + c) END, 5) AS avgexectime,
  round(CASE WHEN c IS NULL THEN avgnumrows WHEN execcount IS NULL THEN r
    ELSE (avgnumrows * execcount + r * c) / (execcount + c) END, 5) AS avgnumrows,
  epoch_us(CASE WHEN c IS NULL THEN lastexecdttm WHEN execcount IS NULL THEN l
    ELSE greatest(lastexecdttm, l) END) AS lastexecdttm,
  CAST(coalesce(numkills, 0) + coalesce(k, 0) AS BIGINT) AS numkills
FROM qry_stats FULL JOIN n USING (oprid, qryname)""")
def running_stats_upsert(query_stats, log):
    """A13 / E3 as a batch."""
    log = log.withColumn("execdttm", F.col("execdttm").cast("timestamp"))
    return stats.running_stats_upsert(query_stats, log).select(
        "oprid", "qryname", big("execcount"), rnd("avgexectime", 5), rnd("avgnumrows", 5),
        micros("lastexecdttm"), big("numkills"))


@query("events", sql="""
WITH d AS (SELECT user_id, event_type, arg_min(value, ts) AS b, arg_max(value, ts) AS a FROM events
           GROUP BY 1, 2)
SELECT user_id, event_type, round(a - b, 4) AS value_delta FROM d WHERE a <> b""")
def snapshot_delta(events):
    """First and last counter per user and statistic, where changed."""
    key = ["user_id", "event_type"]
    before = events.groupBy(*key).agg(F.min_by("value", "ts").alias("value"))
    after = events.groupBy(*key).agg(F.max_by("value", "ts").alias("value"))
    return stats.snapshot_delta(before, after, key, ["value"]).select(*key, rnd("value_delta", 4))


@query("events", sql="""
SELECT user_id AS scenario, epoch_us(min(ts)) AS min_timestamp, epoch_us(max(ts)) AS max_timestamp,
  round((floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 60, 5) AS minutes
FROM events WHERE user_id > 0 GROUP BY 1""")
def scenario_span(events):
    """A15."""
    rows = events.select(F.col("user_id").alias("scenario"), "ts")
    return stats.scenario_span(rows, ts="ts").select(
        "scenario", micros("min_timestamp"), micros("max_timestamp"), rnd("minutes", 5))


KEYS = """
k AS (SELECT nullif(l_returnflag, 'R') AS a, nullif(l_linestatus, 'O') AS b,
        nullif(l_quantity, 50) AS c, l_shipdate AS d FROM lineitem)"""


def _keys(lineitem):
    return lineitem.select(
        F.nullif(F.col("l_returnflag"), F.lit("R")).alias("a"),
        F.nullif(F.col("l_linestatus"), F.lit("O")).alias("b"),
        F.nullif(F.col("l_quantity"), F.lit(50.0)).alias("c"))


@query("lineitem", sql=f"""
WITH {KEYS} SELECT a, b, c, count(*) AS num_rows FROM k
WHERE a IS NOT NULL OR b IS NOT NULL OR c IS NOT NULL GROUP BY a, b, c HAVING count(*) > 1""")
def duplicate_keys(lineitem):
    """Partly NULL keys conflict, all-NULL keys do not."""
    return stats.duplicate_keys(_keys(lineitem), ["a", "b", "c"])


@query("lineitem", sql=f"""
WITH {KEYS} SELECT count(*) AS table_rows, count(*) FILTER (WHERE a IS NOT NULL OR b IS NOT NULL
  OR c IS NOT NULL) AS indexed_rows FROM k""")
def indexed_rows(lineitem):
    """Rows an index would hold."""
    return stats.indexed_rows(_keys(lineitem), ["a", "b", "c"])


@query("orders", "supplier", sql="""
SELECT s_suppkey AS strm_num, count(*) AS total_work FROM orders JOIN supplier
ON o_custkey BETWEEN s_suppkey * 15 AND s_suppkey * 15 + 9 GROUP BY 1""")
def total_work_by_stream(orders, supplier):
    """A17 with J13."""
    streams = supplier.select(
        F.col("s_suppkey").alias("strm_num"), (F.col("s_suppkey") * 15).alias("emplid_from"),
        (F.col("s_suppkey") * 15 + 9).alias("emplid_to"))
    return stats.total_work_by_stream(orders.select(F.col("o_custkey").alias("emplid")), streams)


@query("orders", "customer", sql="""
SELECT c_mktsegment AS group_list_id, count(*) AS total_work FROM orders
JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def total_work_by_group_list(orders, customer):
    """A17 by group list."""
    lists = customer.select(F.col("c_mktsegment").alias("group_list_id"),
                            F.col("c_custkey").alias("emplid"))
    return stats.total_work_by_group_list(orders.select(F.col("o_custkey").alias("emplid")), lists)
