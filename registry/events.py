"""Event-driven queries (E1-E9, W12), batch and streaming. A streaming query
reads the same files as a stream, runs until the input is used up and returns
what it wrote; it is checked against the same SQL as its batch form."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsight.operators import joins, stats
from opsight.operators.intervals import Validity
from opsight.sources import files
from opsight.streaming import events as ops
from opsight.streaming import keyed, stateful
from registry.base import ORACLE, QUERIES, big, micros, query, rnd
from registry.fixtures import derived, with_clause

CHANGES = """
c AS (SELECT *, lag(runstatus) OVER (PARTITION BY prcsinstance ORDER BY ts, event_id) AS old
      FROM prc_changes)"""


def _changes(rows):
    return ops.with_old_value(rows, ["prcsinstance"], ["ts", "event_id"], "runstatus",
                              "old_runstatus")


TRANSITIONS = f"""
WITH {CHANGES}
SELECT event_id, CASE WHEN runstatus = 7 THEN 'Start' ELSE 'End' END AS phase,
  concat(prcstype, ', ', prcsname, ', ', prcsinstance, ', ',
    CASE WHEN runstatus = 7 THEN 'Start' ELSE 'End' END, ', ', oprid) AS comment
FROM c WHERE (runstatus = 7 AND old <> 7) OR (runstatus <> 7 AND old = 7)"""


@query("prc_changes", sql=TRANSITIONS)
def status_transitions(rows):
    """E1 with P16."""
    return ops.status_transitions(_changes(rows)).select("event_id", "phase", "comment")


@query("prc_changes", sql=f"""
WITH {CHANGES}
SELECT event_id, CASE WHEN runstatus = 7 THEN 'Start' ELSE 'End' END AS phase,
  CAST(CASE WHEN runstatus = 7 THEN 5 ELSE 6 END AS BIGINT) AS snap_level
FROM c WHERE ((runstatus = 7 AND old <> 7) OR (runstatus <> 7 AND old = 7))
  AND runcntlid LIKE '%SNAP%'""")
def status_transitions_of_run_controls(rows):
    """E1 for matching run controls, with snapshot level."""
    out = ops.status_transitions(_changes(rows), run_control_like="%SNAP%")
    return out.select("event_id", "phase", big("snap_level"))


SNAPSHOTS = f"""
s AS (SELECT prcsinstance, 'reads' AS statistic, CASE WHEN runstatus = 7 THEN 'Start' ELSE 'End' END
        AS phase, ts, event_id, value AS db_value, round(value / 2, 3) AS my_value
      FROM ({{inner}}) c2
      WHERE (runstatus = 7 AND old <> 7) OR (runstatus <> 7 AND old = 7))""".format(
    inner=CHANGES.strip()[len("c AS ("):-1])
PAIRED = f"""
WITH {SNAPSHOTS},
p AS (SELECT *, lag(phase) OVER w AS ph, lag(db_value) OVER w AS db0, lag(my_value) OVER w AS my0,
        lag(ts) OVER w AS ts0 FROM s WINDOW w AS (PARTITION BY prcsinstance, statistic
        ORDER BY ts, event_id))
SELECT prcsinstance, statistic, db0 AS db_value_before, my0 AS my_value_before,
  epoch_us(ts0) AS begindttm, db_value AS db_value_after, my_value AS my_value_after,
  epoch_us(ts) AS enddttm FROM p WHERE phase = 'End' AND ph = 'Start'"""


def _snapshots(changes):
    done = ops.status_transitions(changes)
    return done.select(
        "prcsinstance", F.lit("reads").alias("statistic"), "phase", "ts", "event_id",
        F.col("value").alias("db_value"), F.round(F.col("value") / 2, 3).alias("my_value"))


PAIR_COLUMNS = ["db_value_before", "my_value_before", "db_value_after", "my_value_after"]


@query("prc_changes", sql=PAIRED)
def pair_snapshots(rows):
    """E2."""
    out = ops.pair_snapshots(_snapshots(_changes(rows)), ts="ts", tie=["event_id"])
    return out.select("prcsinstance", "statistic", *PAIR_COLUMNS, micros("begindttm"),
                      micros("enddttm"))


@query("prc_changes", sql=f"""
{PAIRED.replace("SELECT prcsinstance, statistic, db0", "SELECT prcsinstance, statistic, db0", 1)}
AND (db_value <> db0 OR my_value <> my0)""".replace(
    "SELECT prcsinstance, statistic, db0 AS db_value_before, my0 AS my_value_before,\n"
    "  epoch_us(ts0) AS begindttm, db_value AS db_value_after, my_value AS my_value_after,\n"
    "  epoch_us(ts) AS enddttm",
    "SELECT prcsinstance, epoch_us(ts) AS enddttm, round(my_value - my0, 4) AS my_diff,\n"
    "  round(db_value - db0, 4) AS db_diff"))
def paired_snapshot_differences(rows):
    """A14 on E2: what changed between Start and End."""
    out = ops.pair_snapshots(_snapshots(_changes(rows)), ts="ts", tie=["event_id"])
    return out.where(
        (F.col("db_value_after") != F.col("db_value_before"))
        | (F.col("my_value_after") != F.col("my_value_before"))
    ).select("prcsinstance", micros("enddttm"),
             F.round(F.col("my_value_after") - F.col("my_value_before"), 4).alias("my_diff"),
             F.round(F.col("db_value_after") - F.col("db_value_before"), 4).alias("db_diff"))


def _order_changes(orders):
    gone = orders.where(F.col("o_orderstatus") == "F").withColumn("op", F.lit("D"))
    return gone.unionByName(orders.withColumn("op", F.lit("I")))


@query("orders", sql="""
SELECT o_orderkey, o_custkey, o_totalprice, 'archive' AS kind FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, 'live' FROM orders
WHERE o_orderstatus <> 'F'""")
def archive_on_delete(orders):
    """Archived and live rows."""
    archived = ops.archive_on_delete(_order_changes(orders), orders.columns)
    live = ops.live_rows(orders, archived, ["o_orderkey"])
    columns = ["o_orderkey", "o_custkey", "o_totalprice"]
    return archived.select(*columns, F.lit("archive").alias("kind")).unionByName(
        live.select(*columns, F.lit("live").alias("kind")))


@query("orders", sql="""
SELECT count(*) AS rows_before, count(*) FILTER (WHERE o_orderstatus = 'F') AS rows_archived,
  count(*) FILTER (WHERE o_orderstatus <> 'F') AS rows_live, true AS balanced FROM orders""")
def archive_counts(orders):
    """The check of counts."""
    archived = ops.archive_on_delete(_order_changes(orders), orders.columns)
    return ops.archive_counts(orders, archived, ops.live_rows(orders, archived, ["o_orderkey"]))


PROGRESS = """
SELECT l_orderkey AS prcsinstance, l_suppkey AS emplid, l_partkey, l_linenumber,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey,
    l_extendedprice) - 1 AS sofar, count(*) OVER (PARTITION BY l_orderkey) AS totalwork,
  left(concat('PI=', l_orderkey, ':EMPLID=', l_suppkey), 32) AS action
FROM lineitem WHERE l_orderkey > 0"""


@query("lineitem", sql=PROGRESS)
def progress(lineitem):
    """E6 with A17, P16."""
    rows = lineitem.select(
        F.col("l_orderkey").alias("prcsinstance"), F.col("l_suppkey").alias("emplid"),
        "l_partkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    totals = rows.groupBy("prcsinstance").agg(F.count(F.lit(1)).alias("total_work"))
    out = ops.progress(rows, totals, order=["l_shipdate", "l_linenumber", "l_partkey", "emplid",
                                            "l_extendedprice"])
    return out.select("prcsinstance", "emplid", "l_partkey", "l_linenumber", big("sofar"),
                      big("totalwork"), "action")


@query("prc_changes", sql=f"""
WITH {CHANGES}
SELECT event_id, CASE WHEN runcntlid LIKE 'TRACE%' THEN 'enable'
    WHEN prcstype = 'Application Engine' THEN 'disable' ELSE 'none' END AS decision,
  runcntlid LIKE 'TRACE%' AND runcntlid LIKE 'TRACE%BIND%' AS binds,
  CASE WHEN runcntlid LIKE 'TRACE%' THEN replace(replace(concat_ws('_', prcstype, prcsname,
    prcsinstance, servernamerun), ' ', '_'), '-', '_') END AS trace_tag,
  concat('PI=', prcsinstance, ':Processing') AS action
FROM c WHERE runstatus = 7 AND old <> 7 AND prcstype <> 'PSJob'""")
def trace_rules(rows):
    """E7 with P15, P16."""
    return ops.trace_rules(_changes(rows)).select(
        "event_id", "decision", "binds", "trace_tag", "action")


MESSAGES = """
x AS (SELECT conv_id AS pi, max(turn) AS used FROM conversations WHERE role = 'user' GROUP BY 1),
ok AS (SELECT conv_id AS pi FROM conversations WHERE role = 'user' AND turn = 1),
n AS (SELECT conv_id AS pi, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn)
        + CASE WHEN EXISTS (SELECT 1 FROM ok WHERE ok.pi = conv_id) THEN
            (SELECT used FROM x WHERE x.pi = conv_id) ELSE 0 END AS message_seq
      FROM conversations WHERE role <> 'user' AND conv_id > 0 AND text <> '')"""


def _messages(conversations):
    existing = conversations.where(F.col("role") == "user").select(
        F.col("conv_id").alias("process_instance"), F.col("turn").alias("message_seq"))
    fresh = conversations.where(F.col("role") != "user").select(
        F.col("conv_id").alias("process_instance"), F.col("turn"), F.col("text").alias("message"),
        F.lit(None).cast("int").alias("severity"))
    return ops.append_messages(fresh, existing, ["turn"])


@query("conversations", sql=f"""
WITH {MESSAGES}
SELECT pi AS process_instance, CAST(message_seq AS BIGINT) AS message_seq,
  CAST(65 AS BIGINT) AS message_set_nbr, CAST(30 AS BIGINT) AS message_nbr,
  CAST(0 AS BIGINT) AS message_severity FROM n""")
def append_message_headers(conversations):
    """E8 with W12."""
    header, _ = _messages(conversations)
    return header.select("process_instance", *[big(c) for c in header.columns[1:]])


@query("conversations", sql=f"""
WITH RECURSIVE {MESSAGES},
p AS (SELECT pi, message_seq, 0 AS seq, '' AS piece, text AS rest FROM n
  UNION ALL
  SELECT pi, message_seq, seq + 1, left(rest, k), substr(rest, k + 1) FROM (
    SELECT *, CASE WHEN length(rest) < 254 THEN length(rest)
      WHEN strpos(reverse(left(rest, 254)), ' ') > 0
      THEN 255 - strpos(reverse(left(rest, 254)), ' ') ELSE 254 END AS k FROM p
    WHERE rest <> '' AND seq < 9))
SELECT pi AS process_instance, CAST(message_seq AS BIGINT) AS message_seq,
  CAST(seq AS BIGINT) AS parm_seq, piece AS message_parm FROM p WHERE seq > 0""")
def append_message_parts(conversations):
    """E8 with P17: at most nine pieces, as the message format has."""
    _, parts = _messages(conversations)
    return parts.select("process_instance", big("message_seq"), big("parm_seq"), "message_parm")


LABELLED = f"""
d AS (SELECT CAST(CASE r_regionkey WHEN 0 THEN 3 WHEN 1 THEN 7 WHEN 2 THEN 8 ELSE 9 END AS VARCHAR)
        AS fieldvalue, r_name, CASE r_regionkey WHEN 2 THEN 'I' ELSE 'A' END AS st,
        row_number() OVER (PARTITION BY CASE WHEN r_regionkey <= 2 THEN r_regionkey ELSE 3 END
                           ORDER BY r_regionkey DESC) AS newest FROM region), {CHANGES}
SELECT event_id, left(concat('PI=', prcsinstance, ':',
    CASE WHEN st = 'A' THEN r_name ELSE concat('Status:', runstatus) END), 32) AS action
FROM c LEFT JOIN d ON fieldvalue = CAST(runstatus AS VARCHAR) AND newest = 1
WHERE (runstatus IN (3, 7, 8, 9, 10) OR old IN (7, 8)) AND prcstype <> 'PSJob'"""


def _status_texts(region):
    key = F.col("r_regionkey")
    return region.select(
        F.when(key == 0, "3").when(key == 1, "7").when(key == 2, "8").otherwise("9").alias(
            "fieldvalue"),
        F.col("r_name").alias("xlatshortname"),
        F.when(key == 2, "I").otherwise("A").alias("eff_status"),
        F.timestamp_seconds(key.cast("long") * 86400).alias("effdt"))


@query("prc_changes", "region", sql=f"WITH {LABELLED.strip()}")
def status_labels(rows, region):
    """E9 with J10."""
    texts = _status_texts(region)
    changes = _changes(rows).withColumn("runstatus", F.col("runstatus").cast("string"))
    changes = changes.withColumn("runstatus", F.col("runstatus"))
    out = ops.status_labels(changes, texts, "2024-01-01 00:00:00")
    return out.select("event_id", "action")


DATED = """
d AS (SELECT CAST(CASE r_regionkey WHEN 0 THEN 3 WHEN 1 THEN 7 WHEN 2 THEN 8 ELSE 9 END AS VARCHAR)
        AS fieldvalue, r_name, CASE r_regionkey WHEN 2 THEN 'I' ELSE 'A' END AS st,
        TIMESTAMP '2024-01-02' + to_days(CAST(r_regionkey * 6 AS INTEGER)) AS effdt FROM region)"""
LABELLED_AT = f"""
WITH {DATED.strip()}, {CHANGES}
SELECT event_id, left(concat('PI=', prcsinstance, ':',
    CASE WHEN st = 'A' THEN r_name ELSE concat('Status:', runstatus) END), 32) AS action
FROM c ASOF LEFT JOIN d ON d.fieldvalue = CAST(runstatus AS VARCHAR) AND c.ts >= d.effdt
WHERE (runstatus IN (3, 7, 8, 9, 10) OR old IN (7, 8)) AND prcstype <> 'PSJob'"""


def _validity(region):
    """Texts that come into force six days apart."""
    start = F.unix_seconds(F.lit("2024-01-02 00:00:00").cast("timestamp"))
    days = (F.unix_seconds("effdt") / 86400).cast("long")  # of _status_texts: the region's number
    return Validity.of(_status_texts(region).withColumn("effdt", F.timestamp_seconds(start + days * 6 * 86400)))


@query("prc_changes", "region", sql=LABELLED_AT)
def status_labels_at_time(rows, region):
    """E9 with labels valid at each row's own time."""
    changes = _changes(rows).withColumn("runstatus", F.col("runstatus").cast("string"))
    return ops.status_labels_at(changes, _validity(region), "ts").select("event_id", "action")


# ---- streaming forms ----
# Every stream is fed in three parts, one per micro-batch. Where batches carry state, the
# last one is run again as after a failure, so the SQL also checks that a replay changes nothing.

PARTS = 3
#: Rows of a stream for which its state gets one bucket more.
BUCKET_ROWS = 250_000


def _buckets(rows):
    """Buckets of the state, so that one of them stays small however many rows the stream has."""
    return max(8, -(-rows.count() // BUCKET_ROWS))


class _Fed(NamedTuple):
    """Rows that arrive by part 0, 1 or 2, in as many files as tasks write them."""

    rows: DataFrame
    part: Column
    folder: str

    @property
    def stream(self):
        """The stream of what has arrived."""
        return self.rows.sparkSession.readStream.schema(self.rows.schema).parquet(self.folder)

    def run(self, start):
        """Let each part arrive, and have the query that start(stream) gives use it up as one micro-batch."""
        marked = self.rows.withColumn("_part", self.part.cast("int"))
        for i in range(PARTS):
            marked.where(F.col("_part") == i).drop("_part").write.mode("append").parquet(self.folder)
            start(self.stream).awaitTermination()


def _fed(rows, part):
    """Rows as a stream in three parts, by part 0, 1 or 2."""
    return _Fed(rows, part, stateful.fresh_folder(rows.sparkSession, "fed"))


def _thirds(rows, ts="ts"):
    """0, 1 or 2: the third of all time that a row falls into."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    low, high = rows.agg(F.min(at), F.max(at)).first()
    return F.lit(0) if low is None else F.expr(f"(3 * (unix_micros(cast({ts} AS timestamp)) - {low})) div {high - low + 1}")


THIRDS = """
b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
t AS (SELECT *, (3 * (epoch_us(ts) - lo)) // (hi - lo + 1) AS third FROM events, b)"""


def _rows(spark, sf_dir, *names):
    return derived(spark, sf_dir, *names)


def _run(fed, step, name, keys, ts=None, seed=None, buckets=8):
    """Run a step over the parts, then its last batch once more."""
    spark = fed.rows.sparkSession
    where = keyed.KeyedState(stateful.fresh_folder(spark, name), tuple(keys), ts, buckets)
    if seed is not None:
        where.seed(seed)
    fed.run(lambda stream: keyed.run_keyed(stream, step, where))
    last = where.last_batch(spark)
    for file in (f"{last}", f".{last}.crc"):
        files.delete(spark, f"{where.folder}/checkpoint/commits/{file}")
    keyed.run_keyed(fed.stream, step, where).awaitTermination()
    return where


def _stream(name, sql=None, uses=()):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            body = sql.strip()
            if not uses:
                ORACLE[name] = body
            elif body.startswith("WITH RECURSIVE"):
                ORACLE[name] = "WITH RECURSIVE" + with_clause(*uses)[4:] + ",\n" + body[14:]
            else:
                ORACLE[name] = with_clause(*uses) + (",\n" + body[4:] if body.startswith("WITH") else "\n" + body)
        return fn

    return register


def _change_run(spark, sf_dir, name, finish):
    """A step over three parts of status changes that knows each process's last status."""
    rows = _rows(spark, sf_dir, "prc_changes")
    step = stateful.previous_value_step(
        ["prcsinstance"], "ts", ["event_id"], "runstatus", "old_runstatus", finish)
    return _run(_fed(rows, _thirds(rows)), step, name, ["prcsinstance"], "ts", buckets=_buckets(rows))


@_stream("stream_status_transitions", TRANSITIONS, ("prc_changes",))
def stream_status_transitions(spark, sf_dir):
    """E1 as a stream over a status history."""
    state = _change_run(spark, sf_dir, "transitions", ops.status_transitions)
    return keyed.output(spark, state, "result").select("event_id", "phase", "comment")


@_stream("stream_pair_snapshots", PAIRED, ("prc_changes",))
def stream_pair_snapshots(spark, sf_dir):
    """E1 feeding E2: two streams, the second reads what the first wrote."""
    first = _change_run(spark, sf_dir, "snapshots", _snapshots)
    written = keyed.output(spark, first, "result")
    pair = stateful.pair_snapshots_step(
        ["prcsinstance", "statistic"], "ts", "phase", ["db_value", "my_value"], ["event_id"])
    state = _run(_fed(written, _thirds(written)), pair, "pairs", ["prcsinstance", "statistic"], "ts", buckets=_buckets(written))
    out = keyed.output(spark, state, "result")
    return out.select("prcsinstance", "statistic", *PAIR_COLUMNS, micros("begindttm"),
                      micros("enddttm"))


@_stream("stream_trace_rules", ORACLE["trace_rules"])
def stream_trace_rules(spark, sf_dir):
    """E7 on a stream of status changes."""
    state = _change_run(spark, sf_dir, "trace", ops.trace_rules)
    return keyed.output(spark, state, "result").select("event_id", "decision", "binds", "trace_tag", "action")


@_stream("stream_status_labels", ORACLE["status_labels_at_time"])
def stream_status_labels(spark, sf_dir):
    """E9 on a stream: changes written by one stream, labelled by a second one without state
    through an equi-join with intervals of validity."""
    region = _rows(spark, sf_dir, "region")
    first = _change_run(spark, sf_dir, "changes", lambda changes: changes)
    written = keyed.output(spark, first, "result")
    fed = _fed(written, _thirds(written))
    validity = _validity(region)
    folder = stateful.fresh_folder(spark, "labels")

    def label(stream):
        changes = stream.withColumn("runstatus", F.col("runstatus").cast("string"))
        return stateful.run_to_table(ops.status_labels_at(changes, validity, "ts"), folder)

    fed.run(label)
    return spark.read.parquet(f"{folder}/result").select("event_id", "action")


@_stream("stream_archive_on_delete", ORACLE["archive_on_delete"])
def stream_archive_on_delete(spark, sf_dir):
    """E4 as a stream of inserts and deletes: what was archived, and the live table in the state."""
    orders = _rows(spark, sf_dir, "orders")
    changes = _order_changes(orders).withColumn("seq", F.when(F.col("op") == "D", 2).otherwise(1))
    odd = F.col("o_orderkey") % 2 == 1  # their deletes come with their inserts, those of the others later
    part = F.when(odd, 1).when(F.col("op") == "D", 2).otherwise(0)
    step = stateful.archive_step(["o_orderkey"], orders.columns, ["seq"])
    state = _run(_fed(changes, part), step, "archive", ["o_orderkey"], buckets=_buckets(changes))
    columns = ["o_orderkey", "o_custkey", "o_totalprice"]
    live = state.current(spark)
    return keyed.output(spark, state, "archive").select(*columns, F.lit("archive").alias("kind")).unionByName(
        live.select(*columns, F.lit("live").alias("kind")))


def _message_run(spark, sf_dir):
    rows = _rows(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "process_instance")
    existing = rows.where(F.col("role") == "user").withColumn("message_seq", F.col("turn"))
    fresh = rows.where(F.col("role") != "user").select(
        "process_instance", "turn", F.col("text").alias("message"), F.lit(None).cast("int").alias("severity"))
    part = F.least(F.floor(F.col("turn") / 3), F.lit(2))
    return _run(_fed(fresh, part), stateful.append_messages_step(["turn"]), "messages", ["process_instance"],
                seed=ops.used_sequences(existing, "process_instance", "message_seq"), buckets=_buckets(fresh))


@_stream("stream_append_message_headers", ORACLE["append_message_headers"])
def stream_append_message_headers(spark, sf_dir):
    """E8 with W12 as a stream: numbers of a process go on from batch to batch."""
    header = keyed.output(spark, _message_run(spark, sf_dir), "header")
    return header.select("process_instance", *[big(c) for c in header.columns[1:]])


@_stream("stream_append_message_parts", ORACLE["append_message_parts"])
def stream_append_message_parts(spark, sf_dir):
    """E8 with P17 as a stream."""
    pieces = keyed.output(spark, _message_run(spark, sf_dir), "pieces")
    return pieces.select("process_instance", big("message_seq"), big("parm_seq"), "message_parm")


@_stream("stream_running_stats", """
SELECT oprid, qryname, count(*) AS execcount, round(avg(exectime), 8) AS avgexectime,
  epoch_us(max(execdttm)) AS lastexecdttm,
  CAST(sum(CASE WHEN killedreason = ' ' THEN 0 ELSE 1 END) AS BIGINT) AS numkills
FROM qry_log GROUP BY 1, 2""", ("qry_log",))
def stream_running_stats(spark, sf_dir):
    """E3 as an update-mode aggregation."""
    log = _rows(spark, sf_dir, "qry_log")
    folder = stateful.fresh_folder(spark, "stats")
    fed = _fed(log, _thirds(log, "execdttm"))
    fed.run(lambda stream: stateful.run_updates(stateful.running_stats_stream(stream), folder))
    out = stateful.read_latest(spark, folder, ["oprid", "qryname"])
    return out.select("oprid", "qryname", "execcount", rnd("avgexectime", 8),
                      micros("lastexecdttm"), big("numkills"))


@_stream("stream_enriched_rows", """
SELECT event_id, concat('q=', user_id) AS query_string1, 'F84D' AS domain FROM events""")
def stream_enriched_rows(spark, sf_dir):
    """E5 as a stateless stream."""
    events = _rows(spark, sf_dir, "events")
    fed = _fed(events, _thirds(events))
    folder = stateful.fresh_folder(spark, "enriched")

    def enrich(stream):
        rows = stream.select(
            "event_id", F.concat(F.lit("q%3D"), F.col("user_id").cast("string")).alias("query_string1"),
            F.concat(F.lit("/psp/f84d/"), "event_type").alias("url"))
        return stateful.run_to_table(ops.enrich_access(rows, slots=1), folder)

    fed.run(enrich)
    return spark.read.parquet(f"{folder}/result").select("event_id", "query_string1", "domain")


@_stream("stream_progress", """
SELECT user_id AS prcsinstance, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sofar FROM events""")
def stream_progress(spark, sf_dir):
    """E6 as a stream."""
    events = _rows(spark, sf_dir, "events")
    rows = events.select(F.col("user_id").alias("prcsinstance"), "event_id", "ts")
    step = stateful.progress_step("prcsinstance", ["ts", "event_id"])
    state = _run(_fed(rows, _thirds(rows)), step, "progress", ["prcsinstance"], "ts", buckets=_buckets(rows))
    return keyed.output(spark, state, "result").select("prcsinstance", "event_id", big("sofar"))


@_stream("stream_windowed_counts", f"""
WITH {THIRDS},
f AS (SELECT *, CASE WHEN event_id % 10 = 0 THEN 2 ELSE third END AS part,
        CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS bucket FROM t),
m AS (SELECT part, max(epoch_us(ts)) AS mark FROM f GROUP BY 1),
k AS (SELECT f.*, (bucket + 21600) * 1000000 <= (SELECT max(mark) FROM m WHERE m.part < f.part) - 600000000 AS late FROM f)
SELECT 'late' AS kind, bucket, event_type, count(*) AS num_rows, round(max(value), 6) AS top FROM k WHERE late GROUP BY 2, 3
UNION ALL
SELECT 'result', bucket, event_type, count(*), round(max(value), 6) FROM k
WHERE late IS NOT TRUE AND (bucket + 21600) * 1000000 <= (SELECT max(mark) FROM m) - 600000000 GROUP BY 2, 3""")
def stream_windowed_counts(spark, sf_dir):
    """T5 as tumbling windows over files out of order: windows that are over, and late rows."""
    events = _rows(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    fed = _fed(events, F.when(F.col("event_id") % 10 == 0, 2).otherwise(_thirds(events)))
    step = stateful.windowed_step("ts", ["event_type"], 21600, 600, {"num_rows": ("count", None), "top": ("max", "value")})
    state = _run(fed, step, "windows", (), "ts", buckets=1)
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    late = keyed.output(spark, state, "late").groupBy(
        (F.floor(second / 21600) * 21600).cast("long").alias("bucket"), "event_type").agg(
        F.count(F.lit(1)).alias("num_rows"), F.max("value").alias("top"))
    done = keyed.output(spark, state, "result").withColumn("bucket", F.unix_seconds("bucket"))
    return late.withColumn("kind", F.lit("late")).unionByName(done.withColumn("kind", F.lit("result"))).select(
        "kind", "bucket", "event_type", "num_rows", rnd("top"))
