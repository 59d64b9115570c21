"""Ranked, shared and cumulative reports."""

from pyspark.sql import functions as F

from opsight.operators import distribution, ranking, stats
from opsight.plans import reports
from registry.base import big, query, rnd

STATEMENTS = """
g AS (SELECT concat(bat_program_name, '.', detail_id) AS detail_id,
        count(DISTINCT process_instance) AS executions,
        sum(execute_time) / 1000 AS execute_time, sum(execute_count) AS execute_count,
        sum(peoplecodesqltime) / 1000 AS pc_sqltime, sum(peoplecodetime) / 1000 AS pc_time,
        sum(peoplecodecount) AS pc_count,
        sum(execute_time + compile_time + fetch_time + retrieve_time) / 1000 AS ae_sqltime,
        sum(execute_time + compile_time + fetch_time + retrieve_time + peoplecodesqltime) / 1000
            AS sqltime,
        sum(execute_time + compile_time + fetch_time + retrieve_time + peoplecodesqltime
            + peoplecodetime) / 1000 AS total_time
      FROM stm_timings GROUP BY bat_program_name, detail_id)"""


@query("stm_timings", sql=f"""
WITH {STATEMENTS},
r AS (SELECT *, rank() OVER (ORDER BY sqltime DESC) AS stmtrank,
        100 * sqltime / sum(sqltime) OVER () AS pct_sqltime,
        100 * total_time / sum(total_time) OVER () AS pct_total_time FROM g)
SELECT stmtrank, detail_id, CAST(execute_count AS BIGINT) AS execute_count,
  round(ae_sqltime, 6) AS ae_sqltime, round(pc_sqltime, 6) AS pc_sqltime,
  round(pc_time, 6) AS pc_time, round(pct_sqltime, 6) AS pct_sqltime,
  round(sum(pct_sqltime) OVER w, 6) AS cum_sqltime, round(pct_total_time, 6) AS pct_total_time,
  round(sum(pct_total_time) OVER w, 6) AS cum_total_time
FROM r WHERE stmtrank <= 20
WINDOW w AS (ORDER BY stmtrank RANGE UNBOUNDED PRECEDING)""")
def top_statements(timings):
    """R3 with A6, W1, W2, W3."""
    out = reports.top_statements(timings)
    return out.select(big("stmtrank"), "detail_id", big("execute_count"),
                      *[rnd(c) for c in out.columns[3:]])


@query("stm_timings", sql=f"""
WITH {STATEMENTS}
SELECT detail_id, executions, CAST(execute_count AS BIGINT) AS execute_count,
  CAST(pc_count AS BIGINT) AS pc_count, round(execute_time, 6) AS execute_time,
  round(sqltime, 6) AS sqltime, round(total_time, 6) AS total_time FROM g""")
def statement_times(timings):
    """A6 with A5."""
    return stats.statement_times(timings).select(
        "detail_id", big("executions"), big("execute_count"), big("pc_count"),
        rnd("execute_time"), rnd("sqltime"), rnd("total_time"))


@query("prc_requests", "nation", sql="""
WITH g AS (SELECT prcstype, prcsname, count(*) AS freq,
    sum(epoch(enddttm) - epoch(begindttm)) AS dur, avg(epoch(enddttm) - epoch(begindttm)) AS avg_dur
  FROM prc_requests WHERE begindttm IS NOT NULL AND enddttm IS NOT NULL
    AND runstatus IN (9, 11, 14) AND begindttm > TIMESTAMP '1996-01-31' - INTERVAL 30 DAY
  GROUP BY prcstype, prcsname),
r AS (SELECT *, rank() OVER (ORDER BY dur DESC) AS prcrnk FROM g)
SELECT r.prcstype, r.prcsname, freq, CAST(dur AS BIGINT) AS dur, round(avg_dur, 4) AS avg_dur,
  prcrnk, n_name AS descr
FROM r LEFT JOIN nation ON r.prcsname = concat('PRC', n_nationkey) WHERE prcrnk <= 5""")
def top_processes(requests, nation):
    """R2 with A2, P14, W1, J11."""
    definitions = nation.select(
        F.concat(F.lit("PRC"), F.col("n_nationkey").cast("string")).alias("prcsname"),
        F.col("n_name").alias("descr"))
    out = reports.top_processes(requests, definitions, "1996-01-31 00:00:00", named_by=["prcsname"])
    return out.select("prcstype", "prcsname", big("freq"), big("dur"),
                      F.round("avg_dur", 4).alias("avg_dur"), big("prcrnk"), "descr")


@query("qry_stats", sql="""
WITH g AS (SELECT oprid, qryname, sum(execcount) AS totexec, sum(execcount * avgexectime) AS tottime
           FROM qry_stats GROUP BY oprid, qryname),
r AS (SELECT *, rank() OVER (ORDER BY tottime DESC) AS qryrank,
        100 * tottime / sum(tottime) OVER () AS pcttime FROM g)
SELECT qryrank, oprid, qryname, CAST(totexec AS BIGINT) AS totexec, round(tottime, 4) AS tottime,
  round(pcttime, 6) AS pcttime FROM r WHERE qryrank <= 10""")
def top_queries(query_stats):
    """R4 with A4, W1, W2."""
    return reports.top_queries(query_stats).select(
        big("qryrank"), "oprid", "qryname", big("totexec"), rnd("tottime", 4), rnd("pcttime"))


@query("qry_log", sql="""
WITH g AS (SELECT oprid, qryname, count(*) AS totexec, sum(exectime) AS tottime FROM qry_log
           WHERE execdttm > TIMESTAMP '2024-01-20' - INTERVAL 7 DAY GROUP BY oprid, qryname),
r AS (SELECT *, rank() OVER (ORDER BY tottime DESC) AS qryrank,
        100 * tottime / sum(tottime) OVER () AS pcttime FROM g)
SELECT qryrank, oprid, qryname, totexec, round(tottime, 4) AS tottime,
  round(pcttime, 6) AS pcttime FROM r WHERE qryrank <= 10""")
def top_logged_queries(log):
    """R4 from the execution log, P14."""
    return reports.top_logged_queries(log, "2024-01-20 00:00:00").select(
        big("qryrank"), "oprid", "qryname", big("totexec"), rnd("tottime", 4), rnd("pcttime"))


@query("events", sql="""
WITH g AS (SELECT user_id, sum(value) AS duration, count(*) AS executions FROM events
           WHERE event_type IN ('click', 'view') AND user_id IS NOT NULL GROUP BY user_id),
r AS (SELECT *, rank() OVER (ORDER BY duration DESC) AS durrank FROM g)
SELECT durrank, concat('Q', user_id) AS query_name, round(duration, 4) AS duration, executions
FROM r WHERE durrank <= 20""")
def top_web_queries(events):
    """R1 with P9."""
    access = events.select(
        F.when(F.col("event_type").isin("click", "view"), "ICType=Query").otherwise("ICType=Panel")
        .alias("query_string1"),
        F.concat(F.lit("ICQryName=PUBLIC=Q"), F.col("user_id").cast("string")).alias(
            "query_string2"),
        F.col("value").alias("duration"))
    return reports.top_web_queries(access).select(
        big("durrank"), "query_name", rnd("duration", 4), big("executions"))


@query("lineitem", sql="""
WITH u AS (SELECT l_quantity AS v FROM lineitem UNION ALL
           SELECT CAST(l_linenumber AS DOUBLE) FROM lineitem),
h AS (SELECT v, count(*) AS n, sum(v) AS vol FROM u GROUP BY v),
s AS (SELECT *, n / sum(n) OVER () AS pn, vol / sum(vol) OVER () AS pv FROM h)
SELECT v AS jolt_bytes, n AS num_messages, round(vol, 4) AS volume, round(pn, 8) AS pct_messages,
  round(pv, 8) AS pct_volume, round(sum(pn) OVER (ORDER BY v), 8) AS cum_messages,
  round(sum(pv) OVER (ORDER BY v), 8) AS cum_volume FROM s""")
def message_size_cdf(lineitem):
    """R5 with O4, A7, W2, W3 over two size columns."""
    sizes = lineitem.select("l_quantity", F.col("l_linenumber").cast("double").alias("n"))
    out = reports.combined_message_sizes(sizes, ["l_quantity", "n"])
    return out.select("jolt_bytes", big("num_messages"), rnd("volume", 4), *[
        rnd(c, 8) for c in ("pct_messages", "pct_volume", "cum_messages", "cum_volume")])


@query("lineitem", sql="""
WITH h AS (SELECT l_returnflag, l_quantity, count(*) AS n, sum(l_quantity) AS vol FROM lineitem
           GROUP BY l_returnflag, l_quantity),
s AS (SELECT *, n / sum(n) OVER p AS pn, vol / sum(vol) OVER p AS pv FROM h
      WINDOW p AS (PARTITION BY l_returnflag))
SELECT l_returnflag, l_quantity, n AS num_messages,
  round(sum(pn) OVER w, 8) AS cum_messages, round(sum(pv) OVER w, 8) AS cum_volume
FROM s WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity)""")
def message_size_cdf_by_direction(lineitem):
    """R5 per direction (send, receive)."""
    out = distribution.message_size_cdf(lineitem, "l_quantity", ["l_returnflag"])
    return out.select("l_returnflag", "l_quantity", big("num_messages"),
                      rnd("cum_messages", 8), rnd("cum_volume", 8))


@query("events", sql="""
WITH m AS (SELECT event_id, round(value, 0) AS msg_size FROM events),
s AS (SELECT *, 1.0::DOUBLE / count(*) OVER () AS rn, msg_size / sum(msg_size) OVER () AS rb FROM m)
SELECT event_id, msg_size, round(sum(rn) OVER w, 7) AS prop_msg,
  round(sum(rb) OVER w, 7) AS prop_bndw FROM s
WINDOW w AS (ORDER BY msg_size RANGE UNBOUNDED PRECEDING)""")
def message_log_cdf(events):
    """Row-level shares, running with peers."""
    m = events.select("event_id", F.round("value", 0).alias("msg_size"))
    return distribution.message_log_cdf(m, "msg_size").select(
        "event_id", "msg_size", rnd("prop_msg", 7), rnd("prop_bndw", 7))


@query("svc_requests", sql="""
WITH h AS (SELECT date_trunc('day', stimestamp) AS day, queue AS service,
             round(value, 0) AS svc_time, count(*) AS n FROM svc_requests WHERE value > 0
           GROUP BY 1, 2, 3),
t AS (SELECT *, svc_time * n AS tm FROM h),
s AS (SELECT *, n / sum(n) OVER p AS pn, tm / sum(tm) OVER p AS pt FROM t
      WINDOW p AS (PARTITION BY day, service))
SELECT CAST(epoch(day) AS BIGINT) AS day, service, svc_time,
  CAST(sum(n) OVER w AS BIGINT) AS num_requests,
  round(sum(tm) OVER w, 4) AS cum_svc_time, round(sum(pn) OVER w, 8) AS pct_request,
  round(sum(pt) OVER w, 8) AS pct_cum_svc_time
FROM s WINDOW w AS (PARTITION BY day, service ORDER BY svc_time)""")
def service_time_cdf(requests):
    """R7 with W4, A7."""
    out = distribution.service_time_cdf(
        requests, "stimestamp", "queue", F.lit(0.0), F.col("value"), digits=0)
    return out.select(
        F.unix_seconds(F.col("day").cast("timestamp")).alias("day"), "service", "svc_time",
        big("num_requests"), rnd("cum_svc_time", 4), rnd("pct_request", 8),
        rnd("pct_cum_svc_time", 8))


@query("events", sql="""
WITH m AS (SELECT event_id, event_type AS file, CAST(floor(value / 25) AS BIGINT) AS size FROM events),
s AS (SELECT *, row_number() OVER w AS line, sum(size) OVER w AS bytes,
        count(*) OVER p AS lines, sum(size) OVER p AS total FROM m
      WINDOW w AS (PARTITION BY file ORDER BY size, event_id ROWS UNBOUNDED PRECEDING),
             p AS (PARTITION BY file))
SELECT event_id, file, size, round(line / lines, 8) AS prop_messages,
  round(bytes / total, 8) AS prop_traffic FROM s WHERE size > 0""")
def rowwise_cdf(events):
    """Line and byte proportions per file."""
    m = events.select("event_id", F.col("event_type").alias("file"),
                      F.floor(F.col("value") / 25).alias("size"))
    return distribution.rowwise_cdf(m, "file", "size", ["event_id"]).select(
        "event_id", "file", "size", rnd("prop_messages", 8), rnd("prop_traffic", 8))


CARRY = """
SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (
  {by} ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried
FROM events"""


@query("events", sql=CARRY.format(by="PARTITION BY user_id"))
def carry_forward(events):
    """W6 with the process as key."""
    value = F.when(F.col("event_type") == "click", F.col("event_id"))
    return distribution.carry_forward(events, value, ["ts", "event_id"], ["user_id"]).select(
        "event_id", "carried")


@query("events", sql=CARRY.format(by=""))
def carry_forward_across_processes(events):
    """W6 as the script does it, in file order without keys."""
    value = F.when(F.col("event_type") == "click", F.col("event_id"))
    return distribution.carry_forward(events, value, ["ts", "event_id"]).select(
        "event_id", "carried")


@query("lineitem", sql="""
SELECT l_shipdate::DATE::VARCHAR AS day, l_returnflag, l_quantity, count(*) AS num_messages,
  round(sum(l_quantity), 4) AS volume FROM lineitem GROUP BY 1, 2, 3""")
def value_histogram(lineitem):
    """A7 per day and flag."""
    days = lineitem.select(F.col("l_shipdate").cast("date").cast("string").alias("day"),
                           "l_returnflag", "l_quantity")
    return distribution.value_histogram(days, "l_quantity", ["day", "l_returnflag"]).select(
        "day", "l_returnflag", "l_quantity", big("num_messages"), rnd("volume", 4))


@query("lineitem", sql="""
WITH g AS (SELECT l_partkey, l_returnflag, sum(l_extendedprice) AS revenue FROM lineitem
           GROUP BY l_partkey, l_returnflag)
SELECT l_partkey, l_returnflag, round(revenue, 2) AS revenue,
  round(revenue / sum(revenue) OVER (), 10) AS share_all,
  round(revenue / sum(revenue) OVER (PARTITION BY l_returnflag), 8) AS share_flag FROM g""")
def share_of_total(lineitem):
    """W2, whole and per group."""
    g = lineitem.groupBy("l_partkey", "l_returnflag").agg(F.sum("l_extendedprice").alias("revenue"))
    out = ranking.share(ranking.share(g, {"share_all": "revenue"}), {"share_flag": "revenue"},
                        ["l_returnflag"])
    return out.select("l_partkey", "l_returnflag", rnd("revenue", 2), rnd("share_all", 10),
                      rnd("share_flag", 8))


@query("lineitem", sql="""
WITH g AS (SELECT l_returnflag, l_partkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, qty / sum(qty) OVER (PARTITION BY l_returnflag) AS sh FROM g)
SELECT l_returnflag, l_partkey, qty, round(sum(sh) OVER (
  PARTITION BY l_returnflag ORDER BY qty RANGE UNBOUNDED PRECEDING), 8) AS cum_share FROM s""")
def cumulative_share(lineitem):
    """Peers share the running value."""
    g = lineitem.groupBy("l_returnflag", "l_partkey").agg(F.sum("l_quantity").alias("qty"))
    return ranking.cumulative_share(g, "qty", {"cum_share": "qty"}, ["l_returnflag"]).select(
        "l_returnflag", "l_partkey", "qty", rnd("cum_share", 8))


@query("lineitem", sql="""
WITH g AS (SELECT l_returnflag, l_suppkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY qty DESC) AS rnk FROM g)
SELECT * FROM r WHERE rnk <= 7""")
def top_n_by_group(lineitem):
    """W1 per group."""
    g = lineitem.groupBy("l_returnflag", "l_suppkey").agg(F.sum("l_quantity").alias("qty"))
    return ranking.top_n_by_group(g, ["l_returnflag"], "qty", 7)


@query("lineitem", sql="""
WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity,
    rank() OVER (ORDER BY l_quantity DESC) AS rnk FROM lineitem)
SELECT * FROM r WHERE rnk <= 100""")
def top_n_with_ties(lineitem):
    """W1 where the ties outnumber n: all of them stay."""
    rows = lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    return ranking.top_n_rank(rows, "l_quantity", 100)


@query("supplier", "nation", sql="""
SELECT n_name, round(sum(s_acctbal), 4) AS bytes, CAST(sum(s_nationkey) AS BIGINT) AS blocks,
  CAST(grouping(n_name) AS BIGINT) AS is_total
FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ROLLUP (n_name)""")
def report_total(supplier, nation):
    """Report lines and their grand total."""
    rows = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "n_name", F.col("s_acctbal").alias("bytes"), F.col("s_nationkey").alias("blocks"))
    return stats.report_total(rows, ["n_name"], ["bytes", "blocks"]).select(
        "n_name", rnd("bytes", 4), big("blocks"), big("is_total"))


@query("orders", "customer", "lineitem", sql="""
SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'
EXCEPT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R'""")
def minus_chain(orders, customer, lineitem):
    """O3: three-way distinct difference."""
    return ranking.minus(
        customer.select("c_custkey"),
        orders.where(F.col("o_orderstatus") == "F").select("o_custkey"),
        lineitem.where(F.col("l_returnflag") == "R").select("l_suppkey"))


@query("orders", sql="""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey
LIMIT 25""")
def first_rows(orders):
    """O1, O2: the first rows in a stated order."""
    return ranking.first_rows(
        orders.select("o_orderkey", "o_totalprice"), 25,
        [ranking.sort_key("o_totalprice"), F.col("o_orderkey")])
