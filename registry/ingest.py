"""Log ingest and sinks (S1-S10, E5). Spark writes the tables out as log lines of each
format, good, bad and comment lines alike, and reads them back; the checking
SQL computes the typed rows from the tables directly."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from opsight.sources import formats, loader, versions
from opsight.streaming import events as ops
from opsight.streaming.stateful import fresh_folder
from registry.base import big, query, rnd, secs


def _s(column):
    return F.col(column).cast("string")


def _stamp(pattern):
    return F.date_format(F.col("ts").cast("timestamp"), pattern)


def _pipe_lines(events):
    status = F.when(F.col("event_type") == "signup", "-").otherwise("200")
    taken = F.when(F.col("event_type") == "error", "n/a").otherwise(
        F.floor("value").cast("string"))
    line = F.concat_ws(
        "|", _stamp("yyyy.MM.dd HH:mm:ss"), taken, _s("event_id"), F.lit("-"),
        F.concat(F.lit("10.0.0."), _s("user_id")), F.lit("Agent (x; y)"), status, F.lit("GET"),
        F.concat(F.lit("/psp/F84D/"), "event_type"),
        F.concat(F.lit("?ICType="), "event_type", F.lit("&q%3D"), _s("user_id"), F.lit("&c&&5&6&7&8&9&ten")))
    return events.select(line.alias("value"))


TYPED = """
SELECT CAST(floor(epoch(ts)) AS BIGINT) AS "timestamp", CAST(floor(value) AS DOUBLE) AS duration,
  event_id AS bytes_sent, CAST(CASE WHEN event_type = 'signup' THEN NULL ELSE 200 END AS BIGINT)
  AS return_status, '10' AS remote_host1, '0' AS remote_host2, '0' AS remote_host3,
  CAST(user_id AS VARCHAR) AS remote_host4, 'Agent (x; y)' AS user_agent, 'GET' AS request_method,
  concat('/psp/F84D/', event_type) AS url, {slots}
FROM events WHERE {keep}"""

SLOTS = [*(f"query_string{i}" for i in range(1, 9)), "query_rest"]
OCTETS = [f"remote_host{i}" for i in range(1, 5)]
DIGITS = 12  # event_id stands for sizes and processes, and grows with the table


@query("events", sql=TYPED.format(
    slots="concat('ICType=', event_type) AS query_string1, concat('q%3D', user_id) AS query_string2,"
          " 'c' AS query_string3, CAST(NULL AS VARCHAR) AS query_string4, '5' AS query_string5,"
          " '6' AS query_string6, '7' AS query_string7, '8' AS query_string8, '9&ten' AS query_rest",
    keep="event_type <> 'error' AND user_id < 1000"))
def ingest_pipe_access_log(events):
    """S1, S6."""
    fmt = formats.pipe_access_log(bytes_digits=DIGITS)
    done = loader.load_with_rejects(_pipe_lines(events), fmt).accepted
    return done.select(secs("timestamp"), rnd("duration", 3), big("bytes_sent"),
                       big("return_status"), *OCTETS, "user_agent", "request_method", "url", *SLOTS)


@query("events", sql="""
SELECT event_id AS bytes_sent, concat('q=', user_id) AS query_string2, 'F84D' AS domain
FROM events WHERE event_type <> 'error' AND user_id < 1000""")
def enrich_access_log(events):
    """E5 with P2, P3 on loaded lines."""
    fmt = formats.pipe_access_log(bytes_digits=DIGITS)
    done = loader.load_with_rejects(_pipe_lines(events), fmt).accepted
    return ops.enrich_access(done).select(big("bytes_sent"), "query_string2", "domain")


def _w3c_lines(events):
    query = F.when(F.col("event_type") == "signup", "-").otherwise(
        F.concat(F.lit("cmd=login&u="), _s("user_id")))
    taken = F.when(F.col("event_type") == "error", "-").otherwise(
        F.round(F.col("value"), 2).cast("decimal(9,3)").cast("string"))
    line = F.concat_ws(
        "\t", _stamp("yyyy-MM-dd"), _stamp("HH:mm:ss"), taken, _s("event_id"),
        F.concat(F.lit("10.0.0."), _s("user_id")), F.lit("host"), F.lit("GET"), F.lit("200"),
        F.concat(F.lit('"Agent ('), "event_type", F.lit('; y)"')), F.lit("/psp/ps/"), query)
    return events.select(F.when(F.col("event_type") == "purchase", F.concat(F.lit("#"), line))
                         .otherwise(line).alias("value"))


@query("events", sql="""
SELECT CAST(floor(epoch(ts)) AS BIGINT) AS "timestamp", value AS duration, event_id AS bytes_sent,
  '10' AS remote_host1, '0' AS remote_host2, '0' AS remote_host3,
  CAST(user_id AS VARCHAR) AS remote_host4, 'host' AS remote_dns, 'GET' AS request_method,
  CAST(200 AS BIGINT) AS return_status, '/psp/ps/' AS url,
  concat('Agent (', event_type, '; y)') AS user_agent,
  CASE WHEN event_type = 'signup' THEN NULL ELSE 'md=login' END AS query_string1,
  CASE WHEN event_type = 'signup' THEN NULL ELSE concat('u=', user_id) END AS query_string2
FROM events WHERE event_type NOT IN ('error', 'purchase') AND user_id < 1000""")
def ingest_w3c_access_log(events):
    """S2: '#' lines are discarded, the first character of slot 1 is cut."""
    fmt = formats.w3c_access_log(bytes_digits=DIGITS)
    done = loader.load_with_rejects(_w3c_lines(events), fmt).accepted
    return done.select(secs("timestamp"), rnd("duration", 3), big("bytes_sent"), *OCTETS,
                       "remote_dns", "request_method", big("return_status"), "url", "user_agent",
                       "query_string1", "query_string2")


@query("events", sql="""
SELECT count(*) AS read,
  count(*) FILTER (WHERE event_type NOT IN ('error', 'purchase') AND user_id < 1000) AS loaded,
  count(*) FILTER (WHERE event_type = 'error' OR (event_type <> 'purchase' AND user_id >= 1000))
    AS rejected,
  count(*) FILTER (WHERE event_type = 'purchase') AS discarded,
  count(*) FILTER (WHERE event_type = 'error' OR (event_type <> 'purchase' AND user_id >= 1000))
    <= 999999 AS within_limit FROM events""")
def load_report(events):
    """S7."""
    result = loader.load_with_rejects(_w3c_lines(events), formats.w3c_access_log(bytes_digits=DIGITS))
    return loader.within_error_limit(loader.load_report(result))


@query("events", sql="""
SELECT CASE WHEN event_type = 'error' THEN 'duration not convertible' ELSE 'remote_host4 too long'
  END AS reason, count(*) AS num_lines FROM events
WHERE event_type = 'error' OR (event_type <> 'purchase' AND user_id >= 1000) GROUP BY 1""")
def rejected_lines(events):
    """Why lines were rejected; the first reason of each."""
    result = loader.load_with_rejects(_w3c_lines(events), formats.w3c_access_log(bytes_digits=DIGITS))
    first = F.array_sort(F.filter("reasons", lambda r: ~F.endswith(r, F.lit("missing"))))
    return result.rejected.groupBy(F.get(first, F.lit(0)).alias("reason")).agg(
        F.count(F.lit(1)).alias("num_lines"))


def _service_lines(events):
    epoch = F.unix_seconds(F.col("ts").cast("timestamp"))
    begin = F.unix_millis(F.col("ts").cast("timestamp"))
    line = F.concat(
        F.lit("@"), "event_type", F.lit(" "), _s("user_id"), F.lit("       "),
        epoch.cast("string"), F.lit("   "), begin.cast("string"), F.lit("      "),
        (epoch + 5).cast("string"), F.lit("   "),
        (begin + F.floor("value")).cast("string"), F.lit("  "))
    return events.select(F.when(F.col("event_type") == "signup", " SERVICE PID").otherwise(line)
                         .alias("value"))


@query("events", sql="""
SELECT event_type AS service, user_id AS pid, CAST(floor(epoch(ts)) + 3600 AS BIGINT) AS stimestamp,
  round((CAST(floor(epoch_us(ts) / 1000) AS BIGINT) % 1000000000) / 1000.0, 3) AS stime, 'APPQ' AS queue,
  round(((CAST(floor(epoch_us(ts) / 1000) AS BIGINT) + CAST(floor(value) AS BIGINT)) % 1000000000) / 1000.0, 3) AS etime
FROM events WHERE event_type <> 'signup'""")
def ingest_service_trace(events):
    """S3: '@' lines, the epoch moved by an hour, milliseconds to seconds."""
    done = loader.load_with_rejects(_service_lines(events), formats.service_trace("APPQ", pid_digits=DIGITS)).accepted
    wrap = F.lit(1000000).cast("decimal(13,3)")
    return done.select(
        "service", big("pid"), secs("stimestamp"),
        F.round((F.col("stime") % wrap).cast("double"), 3).alias("stime"), "queue",
        F.round((F.col("etime") % wrap).cast("double"), 3).alias("etime"))


def _trace_lines(events, program):
    head = F.concat(F.lit("PSAPPSRV."), _s("user_id"), F.lit(" ")) if program else F.lit("")
    operation = F.when(F.col("event_type") == "error", "Fetch").otherwise(F.concat(
        F.lit("COM Stmt=SELECT 'x' FROM "), "event_type", F.lit(" WHERE a = "), _s("event_id"),
        F.lit("&rest")))
    line = F.concat(
        head, F.lit("1-"), _s("event_id"), F.lit(" "), _stamp("HH.mm.ss"), F.lit(" 0.010 Cur#"),
        _s("user_id"), F.lit(".HR88 RC=0 Dur=0.020 "), operation)
    return events.select(F.when(F.col("event_type") == "signup", "no trace line").otherwise(line)
                         .alias("value"))


TRACED = """
SELECT {program} AS program, {pid} AS pid, event_id AS line_num,
  CAST(floor(epoch(ts)) - epoch(date_trunc('day', ts)) AS BIGINT) AS time_of_day, user_id AS cursor,
  CASE WHEN event_type = 'error' THEN 'Fetch' ELSE concat('COM Stmt=SELECT ''x'' FROM ', event_type,
    ' WHERE a = ', event_id) END AS operation,
  CASE WHEN event_type = 'error' THEN 'Fetch' ELSE concat('COM Stmt=SELECT : FROM ', event_type,
    ' WHERE a=:') END AS fingerprint
FROM events WHERE event_type <> 'signup'"""


def _traced(events, program):
    fmt = formats.sql_trace("1970-01-01", program)
    done = loader.load_with_rejects(_trace_lines(events, program), fmt).accepted
    return ops.enrich_sql_trace(done).select(
        "program", big("pid"), big("line_num"),
        F.unix_seconds("timestamp").alias("time_of_day"), big("cursor"), "operation", "fingerprint")


@query("events", sql=TRACED.format(program="'PSAPPSRV'", pid="user_id"))
def ingest_sql_trace(events):
    """S4, E5 with P5: server lines."""
    return _traced(events, True)


@query("events", sql=TRACED.format(program="'Client'", pid="CAST(0 AS BIGINT)"))
def ingest_client_sql_trace(events):
    """Client lines without program and process."""
    return _traced(events, False)


def _message_lines(events):
    call = F.when(F.col("event_type") == "click", F.concat(
        F.lit('{ tpservice({"S'), _s("user_id"), F.lit('", 0x0, 0xabc, '), _s("event_id"),
        F.lit(", 0, -1, {5, 0, 30}})")))
    call = call.when(F.col("event_type") == "view", F.concat(
        F.lit("{ tpreturn(2, 0, 0x123, "), _s("event_id"), F.lit(", 0x0)")))
    call = call.otherwise(F.concat(F.lit('{ tpalloc("BYTES", "", '), _s("event_id"), F.lit(")")))
    return events.select(F.concat(
        _stamp("HHmmss"), F.lit(".UNIT-9!SHOPSRV."), _s("user_id"), F.lit(".7.5: TRACE:at:  "),
        call).alias("value"))


@query("events", sql="""
SELECT CAST(floor(epoch(ts)) - epoch(date_trunc('day', ts)) AS BIGINT) AS time_of_day,
  'UNIT-9' AS nodename, concat(user_id, '.7.5') AS prcsid,
  CASE event_type WHEN 'click' THEN 'tpservice' ELSE 'tpreturn' END AS funcname,
  CASE event_type WHEN 'click' THEN concat('{"S', user_id, '"') ELSE '2' END AS service,
  event_id AS msg_size FROM events WHERE event_type IN ('click', 'view')""")
def ingest_message_log(events):
    """Only calls that carry a message pass the check."""
    done = loader.load_with_rejects(
        _message_lines(events), formats.message_log("1970-01-01", DIGITS)).accepted
    return done.select(F.unix_seconds("timestamp").alias("time_of_day"), "nodename", "prcsid",
                       "funcname", "service", big("msg_size"))


@query("orders", sql="""
SELECT 'after a failed load' AS step, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT 'after a load', o_orderkey, o_totalprice FROM orders""")
def replace_load(orders):
    """A load, one that breaks off, and one of everything; the table is read after the second and the third."""
    path = fresh_folder(orders.sparkSession, "loaded")
    columns = ["o_orderkey", "o_totalprice"]
    versions.replace_load(orders.where(F.col("o_orderstatus") == "O").select(*columns), path)
    last = orders.agg(F.max("o_orderkey")).scalar()
    breaks = F.when(F.col("o_orderkey") == last, F.raise_error(F.lit("a line that cannot be loaded")).cast("double"))
    try:
        versions.replace_load(orders.select("o_orderkey", breaks.otherwise(F.col("o_totalprice")).alias("o_totalprice")), path)
    except Exception as error:
        if "a line that cannot be loaded" not in str(error):
            raise
    before = versions.current(orders.sparkSession, path).withColumn("step", F.lit("after a failed load"))
    after = versions.replace_load(orders.select(*columns), path).withColumn("step", F.lit("after a load"))
    return before.unionByName(after).select("step", *columns)


@query("lineitem", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'N')
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1""")
def materialize_loads(lineitem):
    """Loads added under an id, one of them twice; and a snapshot that replaces a wider one."""
    spark = lineitem.sparkSession
    rows = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    path, other = fresh_folder(spark, "added"), fresh_folder(spark, "snapshot")
    for flag in ("A", "N", "A"):
        table = versions.materialize(rows.where(F.col("l_returnflag") == flag), path, f"flag-{flag}")
    wide = versions.materialize(rows.where(F.col("l_returnflag") == "A"), other)
    return table.unionByName(versions.materialize(wide.where(F.col("l_linenumber") == 1), other))


LINES_PER_LOG = 4000


@query("events", sql=f"""
SELECT CAST(event_id // {LINES_PER_LOG} AS VARCHAR) AS file, line, line AS place, value FROM (
  SELECT event_id, concat(event_id, ' ', event_type) AS value,
    row_number() OVER (PARTITION BY event_id // {LINES_PER_LOG} ORDER BY event_id) AS line FROM events)""")
def log_set_per_file(events):
    """A set of log files read with line numbers, written as CSV per file and read back in order."""
    spark = events.sparkSession
    logs, out = fresh_folder(spark, "logs"), fresh_folder(spark, "csv")
    log = F.floor(F.col("event_id") / LINES_PER_LOG)
    lines = events.select(log.alias("log"), "event_id", F.concat_ws(" ", _s("event_id"), "event_type").alias("value"))
    lines.repartition("log").sortWithinPartitions("log", "event_id").drop("event_id").write.partitionBy("log").text(logs)
    read = loader.read_log_set(spark, f"{logs}/*", F.regexp_extract("_metadata.file_path", "log=([0-9]+)", 1))
    loader.write_per_file_csv(loader.line_numbers(read), out)
    back = loader.read_per_file_csv(spark, out, "value string, line long")
    per_part = Window.partitionBy("file", "part").orderBy("seq")
    placed = back.withColumn("in_part", F.row_number().over(per_part))
    parts = placed.groupBy(F.col("file").alias("f"), F.col("part").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("f").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    joined = placed.join(parts, (placed["file"] == parts["f"]) & (placed["part"] == parts["p"]))
    return joined.select("file", "line", (F.col("before") + F.col("in_part")).alias("place"), "value")
