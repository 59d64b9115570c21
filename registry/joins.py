"""Join queries."""

from pyspark.sql import functions as F

from opsight.operators import joins
from opsight.plans import reports
from registry.base import big, micros, query, rnd, secs

LABELS = """
d AS (SELECT d.*, {cols} FROM mon_definitions d {joins})""".format(
    cols=", ".join(f"m{i}.pm_metriclabel AS l{i}, m{i}.pm_metrictype AS t{i}" for i in range(1, 8)),
    joins=" ".join(f"LEFT JOIN mon_metrics m{i} ON m{i}.pm_metricid = d.pm_metricid_{i}"
                   for i in range(1, 8)),
)


@query("mon_samples", "mon_agents", "mon_systems", "mon_definitions", "mon_metrics", sql=f"""
WITH {LABELS}
SELECT pm_instance_id, dbname, pm_event_defn_id, descr60,
  {", ".join(f"concat('Metric{i}:', l{i}, '=', pm_metric_value{i}) AS metric{i}" for i in (1, 4, 7))}
FROM mon_samples JOIN mon_agents USING (pm_agentid) JOIN mon_systems USING (pm_systemid)
JOIN d USING (pm_event_defn_set, pm_event_defn_id)
WHERE dbname IN ('NATION_1', 'NATION_3', 'NATION_7', 'NATION_11', 'NATION_19')
  AND pm_agent_dttm BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'""")
def event_report(samples, agents, systems, definitions, metrics):
    """R9 with J1, J2, P13, P14."""
    out = reports.event_report(
        samples, agents, systems, definitions, metrics, start="2024-01-05 00:00:00",
        end="2024-01-25 00:00:00",
        dbnames=["NATION_1", "NATION_3", "NATION_7", "NATION_11", "NATION_19"])
    return out.select("pm_instance_id", "dbname", big("pm_event_defn_id"), "descr60", "metric1",
                      "metric4", "metric7")


@query("mon_samples", "mon_agents", "mon_systems", "mon_definitions", "mon_metrics", sql=f"""
WITH {LABELS},
w AS (SELECT *, pm_metric_value1 AS raw, {", ".join(
    f"lag(pm_metric_value{i}) OVER p AS p{i}" for i in (1, 2, 3, 4))}
  FROM mon_samples JOIN mon_agents USING (pm_agentid) JOIN mon_systems USING (pm_systemid)
  JOIN d USING (pm_event_defn_set, pm_event_defn_id)
  WHERE pm_event_defn_id = 153
    AND pm_agent_dttm BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-28'
  WINDOW p AS (PARTITION BY pm_agentid, pm_metric_value7 ORDER BY pm_agent_dttm, pm_instance_id))
SELECT pm_instance_id, dbname, coalesce(l1, '1Unused') AS pm_metriclabel1,
  coalesce(l7, '7Unused') AS pm_metriclabel7, {", ".join(
    f"round(CASE WHEN t{i} = '1' AND pm_metric_value{i} < p{i} THEN pm_metric_value{i} "
    f"WHEN t{i} = '1' THEN pm_metric_value{i} - p{i} ELSE pm_metric_value{i} END, 4) AS "
    f"pm_metric_value{i}" for i in (1, 2, 3, 4))}
FROM w WHERE raw > 0 AND pm_agent_dttm BETWEEN TIMESTAMP '2024-01-04' AND TIMESTAMP '2024-01-28'""")
def event_delta_report(samples, agents, systems, definitions, metrics):
    """R9 with W7, W8."""
    out = reports.event_delta_report(
        samples, agents, systems, definitions, metrics, 1, 153, "2024-01-02 00:00:00",
        "2024-01-04 00:00:00", "2024-01-28 00:00:00")
    return out.select("pm_instance_id", "dbname", "pm_metriclabel1", "pm_metriclabel7",
                      *[rnd(f"pm_metric_value{i}", 4) for i in (1, 2, 3, 4)])


CATALOGUE = """
SELECT {key}, descr60, {cols} FROM mon_definitions d {joins}""".format(
    key="{key}",
    cols=", ".join(
        f"concat('{{p}}{i}:', d.pm_metricid_{i}, '=', m{i}.pm_metriclabel) AS metric{i}, "
        f"x{i}.xlatlongname AS text{i}" for i in (1, 2, 7)),
    joins=" ".join(
        f"LEFT JOIN mon_metrics m{i} ON m{i}.pm_metricid = d.pm_metricid_{i} "
        f"LEFT JOIN mon_translate x{i} ON x{i}.fieldname = 'PM_METRICTYPE' "
        f"AND x{i}.fieldvalue = m{i}.pm_metrictype" for i in (1, 2, 7)),
)


@query("mon_definitions", "mon_metrics", "mon_translate",
       sql=CATALOGUE.format(key="CAST(pm_event_defn_id AS BIGINT) AS pm_event_defn_id", p=""))
def event_catalogue(definitions, metrics, translate):
    """R8 with J3."""
    return reports.event_catalogue(definitions, metrics, translate).select(
        big("pm_event_defn_id"), "descr60", *[c for i in (1, 2, 7) for c in (
            f"metric{i}", F.col(f"pm_metrictype_text{i}").alias(f"text{i}"))])


@query("mon_definitions", "mon_metrics", "mon_translate", "nation", sql="""
SELECT CAST(pm_event_defn_id AS BIGINT) AS pm_trans_defn_id,
  concat('C1:', pm_metricid_1, '=', n1.n_name) AS context1,
  concat('C2:', pm_metricid_1, '=', n2.n_name) AS context2,
  concat('C3:', pm_metricid_1, '=', n3.n_name) AS context3,
  concat('M1:', pm_metricid_1, '=', m1.pm_metriclabel) AS metric1
FROM mon_definitions LEFT JOIN mon_metrics m1 ON m1.pm_metricid = pm_metricid_1
LEFT JOIN nation n1 ON n1.n_nationkey = pm_metricid_1
LEFT JOIN nation n2 ON n2.n_nationkey = pm_metricid_2
LEFT JOIN nation n3 ON n3.n_nationkey = pm_metricid_7""")
def transaction_catalogue(definitions, metrics, translate, nation):
    """R8 for transactions: all contexts show the first id."""
    trans = definitions.withColumnsRenamed(
        {"pm_event_defn_set": "pm_trans_defn_set", "pm_event_defn_id": "pm_trans_defn_id"}
    ).withColumns({"pm_contextid_1": F.col("pm_metricid_1"), "pm_contextid_2": F.col(
        "pm_metricid_2"), "pm_contextid_3": F.col("pm_metricid_7")})
    contexts = nation.select(F.col("n_nationkey").alias("pm_contextid"),
                             F.col("n_name").alias("pm_contextlabel"))
    return reports.transaction_catalogue(trans, metrics, translate, contexts).select(
        big("pm_trans_defn_id"), "context1", "context2", "context3", "metric1")


@query("mon_samples", "mon_agents", "mon_systems", "mon_definitions", "mon_metrics", "nation", sql=f"""
WITH {LABELS}
SELECT pm_instance_id, dbname, l1 AS pm_metriclabel1, n1.n_name AS pm_contextlabel1,
  n2.n_name AS pm_contextlabel2, n3.n_name AS pm_contextlabel3
FROM mon_samples s JOIN mon_agents a USING (pm_agentid) JOIN mon_systems USING (pm_systemid)
JOIN d USING (pm_event_defn_set, pm_event_defn_id)
LEFT JOIN nation n1 ON n1.n_nationkey = pm_agentid
LEFT JOIN nation n2 ON n2.n_nationkey = a.pm_systemid
LEFT JOIN nation n3 ON n3.n_nationkey = s.pm_event_defn_id""")
def transaction_detail(samples, agents, systems, definitions, metrics, nation):
    """J4 with J1, J2 and three context look-ups."""
    rename = {"pm_event_defn_set": "pm_trans_defn_set", "pm_event_defn_id": "pm_trans_defn_id"}
    host = agents.select(F.col("pm_agentid").alias("_a"), F.col("pm_systemid").alias("_s"))
    trans = samples.withColumnsRenamed(rename).join(host, F.col("pm_agentid") == F.col("_a"), "left")
    trans = trans.withColumns({
        "pm_contextid_1": F.col("pm_agentid"), "pm_contextid_2": F.col("_s"),
        "pm_contextid_3": F.col("pm_trans_defn_id")}).drop("_a", "_s")
    contexts = nation.select(F.col("n_nationkey").alias("pm_contextid"),
                             F.col("n_name").alias("pm_contextlabel"))
    out = joins.transaction_detail(trans, agents, systems, definitions.withColumnsRenamed(rename),
                                   metrics, contexts)
    return out.select("pm_instance_id", "dbname", "pm_metriclabel1", "pm_contextlabel1",
                      "pm_contextlabel2", "pm_contextlabel3")


@query("lineitem", "part", sql="""
WITH m AS (SELECT l_orderkey, p_type, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT DISTINCT a.l_orderkey FROM m a JOIN m b USING (l_orderkey) JOIN m c USING (l_orderkey)
WHERE a.p_type = 'ECONOMY' AND a.l_returnflag = 'A' AND b.p_type = 'PROMO'
  AND b.l_returnflag = 'N' AND c.p_type = 'LARGE' AND c.l_returnflag = 'R'""")
def find_groups_with_members(lineitem, part):
    """Orders that hold three given kinds of lines."""
    m = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joins.find_groups_with_members(m, ["l_orderkey"], [
        {"p_type": "ECONOMY", "l_returnflag": "A"}, {"p_type": "PROMO", "l_returnflag": "N"},
        {"p_type": "LARGE", "l_returnflag": "R"}])


@query("orders", "lineitem", sql="""
SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem
  WHERE l_orderkey = o_orderkey AND l_suppkey = o_custkey)""")
def semi_join_on_tuple(orders, lineitem):
    """J15."""
    keys = lineitem.select(F.col("l_orderkey").alias("o_orderkey"),
                           F.col("l_suppkey").alias("o_custkey"))
    return joins.semi_join(orders.select("o_orderkey", "o_custkey"), keys,
                           ["o_orderkey", "o_custkey"])


@query("customer", "orders", sql="""
SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey
  AND o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1998-01-01')""")
def anti_join(customer, orders):
    """J16."""
    f = orders.where((F.col("o_orderstatus") == "F") & (
        F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))).select(
        F.col("o_custkey").alias("c_custkey"))
    return joins.anti_join(customer.select("c_custkey"), f, ["c_custkey"])


@query("part", "cat_settings", sql="""
SELECT p_partkey, toolsrel, CAST(p_size + temptblinstances AS BIGINT) AS total
FROM part CROSS JOIN cat_settings""")
def scalar_cross(part, settings):
    """J17."""
    return joins.scalar_cross(part, settings).select(
        "p_partkey", "toolsrel", big(F.col("p_size") + F.col("temptblinstances")).alias("total"))


SAMPLES = """
proc AS (SELECT event_id AS prcsinstance, event_type AS prcsname, ts AS begindttm,
           CASE WHEN value > 480 THEN NULL ELSE ts + to_seconds(CAST(floor(value * 60) AS BIGINT)) END
             AS enddttm FROM events WHERE event_type IN ('purchase', 'signup')),
snap AS (SELECT DISTINCT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS snap_id FROM events),
samp AS (SELECT event_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS snap_id, ts,
           CASE WHEN value < 250 THEN 'purchase' ELSE 'signup' END AS module,
           concat('PI=', user_id) AS action, event_type AS sql_id FROM events)"""


def _session_samples(events):
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    processes = events.where(F.col("event_type").isin("purchase", "signup")).select(
        F.col("event_id").alias("prcsinstance"), F.col("event_type").alias("prcsname"),
        F.col("ts").cast("timestamp").alias("begindttm"),
        F.when(F.col("value") <= 480, F.timestamp_micros(
            F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * 60) * 1000000))
        .alias("enddttm"))
    snapshots = events.select(hour.alias("snap_id")).distinct().select(
        "snap_id", F.lit(1).alias("dbid"), F.lit(1).alias("instance_number"),
        F.timestamp_seconds(F.col("snap_id") * 3600).alias("begin_interval_time"),
        F.timestamp_seconds((F.col("snap_id") + 1) * 3600).alias("end_interval_time"))
    samples = events.select(
        "event_id", hour.alias("snap_id"), F.lit(1).alias("dbid"),
        F.lit(1).alias("instance_number"), F.col("ts").cast("timestamp").alias("sample_time"),
        F.when(F.col("value") < 250, "purchase").otherwise("signup").alias("module"),
        F.concat(F.lit("PI="), F.col("user_id").cast("string")).alias("action"),
        F.col("event_type").alias("sql_id"))
    return samples, snapshots, processes


TAGGED = """
SELECT sql_id, prcsinstance, CAST(count(*) * 10 AS BIGINT) AS ash_secs
FROM samp JOIN snap USING (snap_id) JOIN proc ON module = prcsname
 AND ts BETWEEN begindttm AND coalesce(enddttm, TIMESTAMP '2024-01-30')
 AND to_timestamp((snap_id + 1) * 3600)::TIMESTAMP >= begindttm
 AND to_timestamp(snap_id * 3600)::TIMESTAMP <= coalesce(enddttm, TIMESTAMP '2024-01-30')
WHERE {tag} GROUP BY 1, 2"""


@query("events", sql=f"WITH {SAMPLES}" + TAGGED.format(
    tag="starts_with(action, concat('PI=', prcsinstance))"))
def sampled_time_of_processes(events):
    """J6 with J19, A10: the instance tag as a prefix."""
    hits = joins.sample_interval_join(*_session_samples(events), "2024-01-30 00:00:00")
    from opsight.operators.stats import sampled_time
    return sampled_time(hits, ["sql_id", "prcsinstance"]).withColumn("ash_secs", big("ash_secs"))


@query("events", sql=f"WITH {SAMPLES}" + TAGGED.format(
    tag="action = concat('PI=', prcsinstance)"))
def sampled_time_of_exact_tags(events):
    """J6 with the instance number itself."""
    hits = joins.sample_interval_join(*_session_samples(events), "2024-01-30 00:00:00",
                                      exact_tag=True)
    from opsight.operators.stats import sampled_time
    return sampled_time(hits, ["sql_id", "prcsinstance"]).withColumn("ash_secs", big("ash_secs"))


@query("events", sql="""
WITH proc AS (SELECT event_id AS prcsinstance, user_id, ts AS b,
    ts + to_seconds(CAST(floor(value * 60) AS BIGINT)) AS e FROM events WHERE event_type = 'purchase')
SELECT event_id, prcsinstance FROM events JOIN proc USING (user_id) WHERE ts BETWEEN b AND e""")
def interval_join(events):
    """The events of a user inside the intervals of that user."""
    times = events.withColumn("ts", F.col("ts").cast("timestamp"))
    intervals = times.where(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("prcsinstance"), F.col("user_id").alias("owner"),
        F.col("ts").alias("b"), F.timestamp_micros(
            F.unix_micros("ts") + F.floor(F.col("value") * 60) * 1000000).alias("e"))
    return joins.interval_join(
        times.select("event_id", "user_id", "ts"), intervals, [("user_id", "owner")], "ts", "b", "e",
    ).select("event_id", "prcsinstance")


@query("events", sql=f"""
WITH {SAMPLES}
SELECT module, action, CAST(count(*) * 10 AS BIGINT) AS ash_secs FROM samp JOIN snap USING (snap_id)
WHERE to_timestamp((snap_id + 1) * 3600)::TIMESTAMP >= TIMESTAMP '2024-01-20'
  AND ts >= TIMESTAMP '2024-01-20' AND upper(sql_id) LIKE 'C%' GROUP BY 1, 2""")
def sampled_time(events):
    """A10 with J19, P14, P15: samples of the last days by module and action."""
    from opsight.operators.stats import sampled_time as by
    samples, snapshots, _ = _session_samples(events)
    since = F.lit("2024-01-20 00:00:00").cast("timestamp")
    joined = joins.session_sample_snapshot_join(samples, snapshots).where(
        (F.col("end_interval_time") >= since) & (F.col("sample_time") >= since)
        & F.upper("sql_id").like("C%"))
    return by(joined, ["module", "action"]).withColumn("ash_secs", big("ash_secs"))


@query("part", "nation", sql="""
WITH pat AS (SELECT n_nationkey, CASE WHEN n_nationkey <= 4 THEN concat('%', n_nationkey, '%')
    WHEN n_nationkey <= 12 THEN concat('Brand#', n_nationkey, '%')
    ELSE concat('Brand#', substr(CAST(n_nationkey AS VARCHAR), 1, 1), '_x') END AS pattern
  FROM nation)
SELECT n_nationkey, pattern, p_partkey FROM pat LEFT JOIN part ON p_brand LIKE pattern""")
def like_join(part, nation):
    """Patterns with and without literal prefix; patterns without match stay."""
    n = F.col("n_nationkey").cast("string")
    pattern = F.when(F.col("n_nationkey") <= 4, F.concat(F.lit("%"), n, F.lit("%"))).when(
        F.col("n_nationkey") <= 12, F.concat(F.lit("Brand#"), n, F.lit("%"))
    ).otherwise(F.concat(F.lit("Brand#"), F.substring(n, 1, 1), F.lit("_x")))
    pats = nation.select("n_nationkey", pattern.alias("pattern"))
    return joins.like_join(part.select("p_partkey", "p_brand"), pats, [("p_brand", "pattern")],
                           how="left_patterns").select("n_nationkey", "pattern", "p_partkey")


@query("part", sql="""
WITH plan AS (SELECT DISTINCT concat(p_brand, '.', p_type, CASE WHEN p_size <= 25 THEN 'D' ELSE 'S' END)
    AS statement_id, concat(p_size, '-run(a)') AS remarks FROM part),
log AS (SELECT DISTINCT size AS process_instance, brand AS process_name, 'run' AS run_cntl_id
        FROM (SELECT p_size AS size, p_brand AS brand FROM part WHERE p_size > 8)),
det AS (SELECT p_size AS process_instance, concat(p_type, chr(2)) AS detail_id,
          sum(p_retailprice) AS execute_time, count(*) AS execute_count FROM part
        GROUP BY p_size, p_type),
x AS (SELECT process_instance, concat(process_name, '.', detail_id) AS statement,
        concat(process_name, '.', substr(detail_id, 1, length(detail_id) - 1), 'D') AS ip,
        concat(process_instance, '-', run_cntl_id, '(%)') AS rp, execute_time / 1000 AS exec_secs,
        execute_count FROM log JOIN det USING (process_instance))
SELECT CAST(process_instance AS BIGINT) AS process_instance, statement, remarks,
  round(exec_secs, 6) AS exec_secs, execute_count
FROM x LEFT JOIN plan ON statement_id LIKE ip AND remarks LIKE rp""")
def traced_statement_plans(part):
    """R10 with J7, P7, P12; plans have steps below the root."""
    plans = part.select(
        F.concat("p_brand", F.lit("."), "p_type",
                 F.when(F.col("p_size") <= 25, "D").otherwise("S")).alias("statement_id"),
        F.concat(F.col("p_size").cast("string"), F.lit("-run(a)")).alias("remarks"),
    ).distinct().withColumn("id", F.explode(F.array(F.lit(0), F.lit(1))))
    log = part.select(
        F.col("p_size").alias("process_instance"), F.col("p_brand").alias("process_name"),
        F.lit("run").alias("run_cntl_id"),
        F.when(F.col("p_size") > 8, 4096 + 128).otherwise(128).alias("trace_level")).distinct()
    detail = part.groupBy(F.col("p_size").alias("process_instance"),
                          F.concat("p_type", F.char(F.lit(2))).alias("detail_id")).agg(
        F.sum("p_retailprice").alias("execute_time"), F.count(F.lit(1)).alias("execute_count"))
    return reports.traced_statement_plans(log, detail, plans).select(
        big("process_instance"), "statement", "remarks", rnd("exec_secs"), "execute_count")


SPAN = "epoch_us(b.stimestamp) <= epoch_us(a.stimestamp) AND epoch_us(b.stimestamp) + CAST(floor(b.dur) * 1000000 AS BIGINT) >= epoch_us(a.stimestamp)"


def _spans(requests):
    start = F.unix_micros(F.col("stimestamp").cast("timestamp"))
    return requests.withColumns({"_s": start, "_e": start + F.floor("dur") * 1000000})


@query("svc_requests", sql=f"""
SELECT a.queue, a.event_id, count(*) AS concurrent FROM svc_requests a JOIN svc_requests b
ON a.queue = b.queue AND {SPAN} GROUP BY 1, 2""")
def concurrency(requests):
    """Requests running at each start."""
    return joins.concurrency(_spans(requests), ["queue"], ["event_id"], "_s", "_e").select(
        "queue", "event_id", big("concurrent"))


@query("svc_requests", sql="""
WITH r AS (SELECT event_id, queue, floor(epoch(stimestamp)) AS ts,
    (epoch_us(stimestamp) / 1e6)::DECIMAL(18,6) AS st, floor(dur) AS d FROM svc_requests)
SELECT a.queue, a.event_id, count(*) AS concurrent FROM r a JOIN r b ON a.queue = b.queue
 AND b.st <= a.st AND b.st + b.d::DECIMAL(18,6) >= a.st AND b.ts <= a.ts AND b.ts >= a.ts - ceil(a.d + 1)
GROUP BY 1, 2""")
def concurrency_with_lookback(requests):
    """J8 with the look-back of the original count."""
    start = F.unix_micros(F.col("stimestamp").cast("timestamp")).cast("decimal(20,0)") / 1000000
    rows = requests.withColumns({"_s": start.cast("decimal(18,6)"),
                                 "_d": F.floor("dur").cast("decimal(18,6)")})
    rows = rows.withColumn("_e", (F.col("_s") + F.col("_d")).cast("decimal(18,6)"))
    return joins.concurrency(rows, ["queue"], ["event_id"], "_s", "_e", "stimestamp").select(
        "queue", "event_id", big("concurrent"))


TRACE = """
t AS (SELECT event_id AS line_num, 'DB' AS database, 'P' AS program, 1 AS pid, 1 AS line_id,
        user_id AS cursor, ts AS stamp, CASE event_type WHEN 'click' THEN 'COM Stmt=SELECT'
          WHEN 'error' THEN 'Fetch' ELSE 'Other' END AS operation FROM events)"""


def _trace(events):
    return events.select(
        F.col("event_id").alias("line_num"), F.lit("DB").alias("database"),
        F.lit("P").alias("program"), F.lit(1).alias("pid"), F.lit(1).alias("line_id"),
        F.col("user_id").alias("cursor"), F.col("ts").alias("timestamp"),
        F.when(F.col("event_type") == "click", "COM Stmt=SELECT")
        .when(F.col("event_type") == "error", "Fetch").otherwise("Other").alias("operation"))


PARENT = """
m AS (SELECT f.line_num, max(s.line_num) AS parent FROM x f JOIN x s ON s.cursor = f.cursor
  AND s.line_num < f.line_num AND s.at <= f.at WHERE f.operation = 'Fetch'
  AND s.operation LIKE 'COM Stmt=%' GROUP BY 1)
SELECT x.line_num, CASE WHEN operation = 'Fetch' THEN coalesce(parent, -1) ELSE 0 END
  AS parent_line_num FROM x LEFT JOIN m USING (line_num)"""


@query("events", sql=f"""
WITH {TRACE}, x AS (SELECT line_num, cursor, operation, floor(epoch(stamp)) AS at FROM t), {PARENT}""")
def asof_parent(events):
    """Fetches with the statement they belong to."""
    return joins.asof_parent(_trace(events)).select("line_num", "parent_line_num")


@query("events", sql=f"""
WITH {TRACE}, x AS (SELECT line_num, cursor, operation,
    floor(epoch(stamp)) - epoch(date_trunc('day', stamp)) AS at FROM t), {PARENT}""")
def asof_parent_time_of_day(events):
    """J9 on a log whose times go back: they are times of day and wrap at midnight."""
    trace = _trace(events)
    second = F.pmod(F.unix_seconds(F.col("timestamp").cast("timestamp")), F.lit(86400))
    return joins.asof_parent(trace.withColumn("timestamp", F.timestamp_seconds(second))).select(
        "line_num", "parent_line_num")


@query("events", sql=f"""
WITH {TRACE}
SELECT line_num, CASE WHEN operation = 'Fetch' THEN coalesce(max(CASE WHEN operation LIKE 'COM Stmt=%'
    THEN line_num END) OVER (PARTITION BY cursor ORDER BY line_num
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) ELSE 0 END AS parent_line_num
FROM t""")
def asof_parent_by_line(events):
    """J9 without the time test."""
    return joins.asof_parent(_trace(events), monotone=True).select("line_num", "parent_line_num")


DATED = """
dated AS (SELECT CAST(o_custkey AS VARCHAR) AS fieldvalue, max(o_orderdate) AS effdt,
            max(CASE WHEN o_totalprice < 400000 THEN 'A' ELSE 'I' END) AS eff_status,
            max(o_orderpriority) AS label FROM orders GROUP BY o_custkey, o_orderdate)"""


def _dated(orders):
    return orders.groupBy(
        F.col("o_custkey").cast("string").alias("fieldvalue"), F.col("o_orderdate").alias("effdt")
    ).agg(F.max(F.when(F.col("o_totalprice") < 400000, "A").otherwise("I")).alias("eff_status"),
          F.max("o_orderpriority").alias("xlatshortname"))


@query("orders", "customer", sql=f"""
WITH {DATED},
l AS (SELECT fieldvalue, arg_max(eff_status, effdt) AS st, arg_max(label, effdt) AS label FROM dated
      WHERE effdt <= TIMESTAMP '1998-06-30' GROUP BY 1)
SELECT c_custkey, CASE WHEN st = 'A' THEN label ELSE concat('Status:', c_custkey) END AS label
FROM customer LEFT JOIN l ON fieldvalue = CAST(c_custkey AS VARCHAR)""")
def effective_dated_lookup(orders, customer):
    """J10 at one date."""
    rows = customer.select("c_custkey", F.col("c_custkey").cast("string").alias("code"))
    return joins.effective_dated_lookup(rows, _dated(orders), "code", "1998-06-30 00:00:00").select(
        "c_custkey", "label")


@query("orders", "lineitem", sql=f"""
WITH {DATED}, r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
    CAST(l_suppkey AS VARCHAR) AS code FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN eff_status = 'A' THEN label
  ELSE concat('Status:', code) END AS label
FROM r ASOF LEFT JOIN dated ON fieldvalue = code AND effdt <= l_shipdate""")
def effective_dated_lookup_per_row(orders, lineitem):
    """J10 at a date per row: an as-of join."""
    rows = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                           F.col("l_suppkey").cast("string").alias("code"))
    return joins.effective_dated_lookup(rows, _dated(orders), "code", "l_shipdate").select(
        "l_orderkey", "l_linenumber", "l_partkey", "label")


STREAMS = """
strm AS (SELECT s_suppkey AS strm_num, s_suppkey * 15 AS emplid_from,
           s_suppkey * 15 + s_suppkey % 40 AS emplid_to FROM supplier)"""


def _streams(supplier):
    return supplier.select(
        F.col("s_suppkey").alias("strm_num"), (F.col("s_suppkey") * 15).alias("emplid_from"),
        (F.col("s_suppkey") * 15 + F.col("s_suppkey") % 40).alias("emplid_to"))


@query("customer", "supplier", sql=f"""
WITH {STREAMS}
SELECT c_custkey, strm_num FROM customer JOIN strm ON c_custkey BETWEEN emplid_from AND emplid_to""")
def range_assign(customer, supplier):
    """J13 with ranges that overlap."""
    return joins.range_assign(customer, _streams(supplier), "c_custkey", "emplid_from",
                              "emplid_to").select("c_custkey", "strm_num")


@query("customer", "supplier", sql=f"""
WITH {STREAMS}
SELECT c_name, strm_num FROM customer JOIN strm ON c_name BETWEEN
  concat('Customer#', lpad(CAST(emplid_from AS VARCHAR), 9, '0')) AND
  concat('Customer#', lpad(CAST(emplid_to AS VARCHAR), 9, '0'))""")
def range_assign_by_scan(customer, supplier):
    """J13 with ranges of texts."""
    name = lambda c: F.concat(F.lit("Customer#"), F.lpad(F.col(c).cast("string"), 9, "0")).alias(c)
    named = _streams(supplier).select("strm_num", name("emplid_from"), name("emplid_to"))
    return joins.range_assign(customer, named, "c_name", "emplid_from", "emplid_to").select(
        "c_name", "strm_num")


@query("cat_objects", "cat_named", sql="""
WITH t AS (SELECT DISTINCT object_name FROM cat_objects WHERE object_type = 'TABLE'),
b AS (SELECT table_name, recname, rectype FROM cat_named)
SELECT object_name, coalesce(r0.recname, r1.recname, r2.recname) AS recname,
  CASE WHEN r0.recname IS NOT NULL THEN NULL WHEN r1.recname IS NOT NULL THEN right(object_name, 1)
       WHEN r2.recname IS NOT NULL THEN right(object_name, 2) END AS instance
FROM t LEFT JOIN b r0 ON r0.table_name = object_name AND r0.rectype IN (0, 7)
LEFT JOIN b r1 ON r1.rectype = 7 AND r1.table_name = left(object_name, -1)
LEFT JOIN b r2 ON r2.rectype = 7 AND r2.table_name = left(object_name, -2)""")
def resolve_instance_name(objects, named):
    """J14."""
    t = objects.where(F.col("object_type") == "TABLE").select("object_name").distinct()
    records = named.select("recname", "rectype", F.col("table_name").alias("base_table"))
    return joins.resolve_instance_name(t, records, "object_name").select(
        "object_name", "recname", "instance")


@query("cat_objects", "cat_named", sql="""
SELECT object_name, table_name AS base_table,
  CAST(TRY_CAST(substr(object_name, length(table_name) + 1) AS INTEGER) AS BIGINT) AS instance
FROM cat_objects JOIN cat_named ON starts_with(object_name, table_name)
 AND object_name BETWEEN concat(table_name, '1') AND concat(table_name, '9999Z')
WHERE rectype = 7 AND object_type = 'TABLE'""")
def prefix_name_join(objects, named):
    """J18."""
    bases = named.where(F.col("rectype") == 7).select(F.col("table_name").alias("base_table"))
    t = objects.where(F.col("object_type") == "TABLE").select("object_name")
    return joins.prefix_name_join(t, bases).select("object_name", "base_table", big("instance"))
