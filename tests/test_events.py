"""Event operators, and their streaming forms over several micro-batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from opsight.operators.intervals import Validity
from opsight.sources import files
from opsight.streaming import events as ops
from opsight.streaming import keyed, stateful
from registry import events as registered
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)
CHANGE = ("id int, prcsinstance int, prcstype string, prcsname string, oprid string,"
          " runcntlid string, servernamerun string, runstatus int, old_runstatus int")


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def change(i, new, old, kind="SQR Report", run="DAILY", pi=5):
    return (i, pi, kind, "PRC", "me", run, "SRV 1", new, old)


def test_transitions(frame):
    df = frame(CHANGE, change(1, 7, 6), change(2, 9, 7), change(3, 7, 7), change(4, 9, 8),
               change(5, 7, None), change(6, 7, 6, run="X_SNAP"))
    assert rows(ops.status_transitions(df), "id", "phase", "comment") == [
        (1, "Start", "SQR Report, PRC, 5, Start, me"), (2, "End", "SQR Report, PRC, 5, End, me"),
        (6, "Start", "SQR Report, PRC, 5, Start, me")]
    named = ops.status_transitions(df, run_control_like="%SNAP%")
    assert rows(named, "id", "snap_level") == [(6, 5)]


def test_trace_rules(frame):
    df = frame(CHANGE, change(1, 7, 6, run="TRACE"), change(2, 7, 6, run="TRACE_BIND"),
               change(3, 7, 6, "Application Engine"), change(4, 7, 6), change(5, 7, 6, "PSJob"),
               change(6, 8, 7))
    got = ops.trace_rules(df)
    assert rows(got, "id", "decision", "binds", "trace_tag") == [
        (1, "enable", False, "SQR_Report_PRC_5_SRV_1"), (2, "enable", True, "SQR_Report_PRC_5_SRV_1"),
        (3, "disable", False, None), (4, "none", False, None)]


def test_status_labels(frame):
    texts = frame("fieldvalue string, effdt timestamp, eff_status string, xlatshortname string",
                  ("7", at(0), "A", "Processing"))
    df = frame(CHANGE, change(1, 7, 6), change(2, 5, 8), change(3, 5, 6), change(4, 9, 7, "PSJob"))
    df = df.withColumn("runstatus", F.col("runstatus").cast("string"))
    assert rows(ops.status_labels(df, texts, str(at(9))), "id", "action") == [
        (1, "PI=5:Processing"), (2, "PI=5:Status:5")]


def test_archive(frame):
    changes = frame("op string, k int, v string", ("D", 1, "a"), ("I", 2, "b"), ("D", 3, "c"))
    table = frame("k int, v string", (1, "a"), (2, "b"), (3, "c"))
    gone = ops.archive_on_delete(changes, table.columns)
    live = ops.live_rows(table, gone, ["k"])
    assert rows(gone) == [(1, "a"), (3, "c")] and rows(live) == [(2, "b")]
    assert tuple(ops.archive_counts(table, gone, live).first()) == (3, 2, 1, True)


def test_messages_are_numbered_and_cut(frame):
    new = frame("process_instance int, o int, message string, severity int", (1, 1, "x" * 300, None),
                (1, 2, "short", 3), (2, 1, "a b", 0), (0, 1, "ignored", 0), (1, 3, None, 0),
                (3, 1, "y", 0), (4, 1, "word " * 600, 0))
    old = frame("process_instance int, message_seq int", (1, 1), (1, 4), (3, 2))
    header, parts = ops.append_messages(new, old, ["o"])
    assert rows(header, "process_instance", "message_seq", "message_severity") == [
        (1, 5, 0), (1, 6, 3), (2, 1, 0), (3, 1, 0), (4, 1, 0)]  # 3 lacks number 1: starts again
    assert rows(parts.where("process_instance = 1"), "message_seq", "parm_seq", "message_parm") == [
        (5, 1, "x" * 254), (5, 2, "x" * 46), (6, 1, "short")]
    pieces = parts.where("process_instance = 4").collect()
    assert len(pieces) == 12 and all(len(p.message_parm) == 250 for p in pieces)


def test_progress(frame):
    df = frame("prcsinstance int, gp_calc_ts int, emplid string", (1, 1, "e1"), (1, 2, "e2"),
               (2, 1, "e9"), (0, 1, "e0"))
    got = ops.progress(df, frame("prcsinstance int, total_work long", (1, 2)))
    assert rows(got, "prcsinstance", "sofar", "totalwork", "action") == [
        (1, 0, 2, "PI=1:EMPLID=e1"), (1, 1, 2, "PI=1:EMPLID=e2"), (2, 0, 0, "PI=2:EMPLID=e9")]


SNAP = "prcsinstance int, statistic string, phase string, dttm timestamp, db_value long, my_value long"


def test_pairs(frame):
    df = frame(SNAP, (1, "s", "Start", at(0), 10, 1), (1, "s", "End", at(5), 15, 4),
               (1, "s", "End", at(6), 99, 9), (2, "s", "Start", at(0), 1, 1),
               (2, "s", "Start", at(1), 2, 2), (2, "s", "End", at(2), 7, 3))
    assert rows(ops.pair_snapshots(df), "prcsinstance", "db_value_before", "db_value_after",
                "begindttm") == [(1, 10, 15, at(0)), (2, 2, 7, at(1))]


def _feed(spark, tmp_path, df, batches):
    """Write one file per batch; the stream takes one file per trigger."""
    folder = str(tmp_path / "in")
    for name, cond in batches:
        part = df.where(cond).coalesce(1)
        part.write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture
def history(frame):
    data = [(i, 1 + i % 3, at(10 * i), [7, 7, 9, 7, 8, 5, 7][i % 7]) for i in range(40)]
    return frame("id int, k int, t timestamp, s int", *data)


def _state(spark, keys, ts=None, **more):
    return keyed.KeyedState(stateful.fresh_folder(spark, "t"), tuple(keys), ts, **more)


def _old_step(finish=lambda d: d, limit=None, **more):
    return stateful.previous_value_step(["k"], "t", ["id"], "s", "old", finish, limit, **more)


@pytest.mark.parametrize("limit", [4, 1000])
def test_stream_of_previous_values_equals_batch(spark, tmp_path, history, limit):
    def finish(rows_):
        return rows_.where("s = 7 AND old <> 7")

    want = finish(ops.with_old_value(history, ["k"], ["t", "id"], "s", "old"))
    stream = _feed(spark, tmp_path, history, [("a", "id < 13"), ("b", "id BETWEEN 13 AND 25"),
                                              ("c", "id > 25")])
    state = _state(spark, ["k"], "t", buckets=3)
    keyed.run_keyed(stream, _old_step(finish, limit), state).awaitTermination()
    got = keyed.output(spark, state, "result")
    assert rows(got, "id", "k", "s", "old") == rows(want, "id", "k", "s", "old")
    assert keyed.output(spark, state, "late").count() == 0


def test_late_rows_are_set_aside(spark, tmp_path, history):
    stream = _feed(spark, tmp_path, history, [("a", "id > 5"), ("b", "id <= 5")])
    state = _state(spark, ["k"], "t")
    keyed.run_keyed(stream, _old_step(), state).awaitTermination()
    assert rows(keyed.output(spark, state, "late"), "id") == [(i,) for i in range(6)]


def test_a_repeated_batch_changes_nothing(spark, history):
    """After a failure Spark runs a batch again; what the first try wrote is not counted twice."""
    parts = [history.where(c) for c in ("id < 13", "id BETWEEN 13 AND 25", "id > 25")]
    state = _state(spark, ["k"], "t", buckets=4)
    run = keyed.batch_function(_old_step(), state)
    run(parts[0], 0)
    once = rows(keyed.output(spark, state, "result"))
    run(parts[0], 0)
    assert rows(keyed.output(spark, state, "result")) == once

    def broken(batch, state_rows, marks):
        outputs, following = _old_step()(batch, state_rows, marks)
        return outputs, following.select(F.raise_error(F.lit("lost")).alias("k"))

    with pytest.raises(Exception, match="lost"):
        keyed.batch_function(broken, state)(parts[1], 1)
    assert rows(keyed.output(spark, state, "result")) == once  # written, but not committed
    for i in (1, 1, 2, 2):
        run(parts[i], i)
    want = ops.with_old_value(history, ["k"], ["t", "id"], "s", "old")
    assert rows(keyed.output(spark, state, "result"), "id", "old") == rows(want, "id", "old")
    with pytest.raises(FileNotFoundError):
        run(parts[0], 7)  # its predecessor is not there


def test_a_batch_rewrites_the_buckets_of_its_keys_only(spark, frame):
    schema = "id int, k int, t timestamp, s int"
    state = _state(spark, ["k"], "t", buckets=40)
    run = keyed.batch_function(_old_step(), state)
    run(frame(schema, *[(k, k, at(0), 1) for k in range(200)]), 0)
    full = state.manifest(spark, 0).versions
    assert len(full) > 30 and set(full.values()) == {0}
    for i in range(1, 4):
        run(frame(schema, (500 + i, 7, at(i), i)), i)
    versions = state.manifest(spark, 3).versions
    own = {b for b, v in versions.items() if v == 3}
    visited = {b for b in full if b % keyed.SWEEP == 3}
    assert visited < own and len(own) == len(visited) + 1  # the key's own bucket, and those whose turn it is
    assert state.current(spark).count() == 200
    assert rows(keyed.output(spark, state, "result").where("id > 500"), "id", "old") == [(501, 1), (502, 1), (503, 2)]
    kept = {n for n in files.names(spark, f"{state.folder}/state/v0") if n.startswith("_b=")}
    assert kept >= {f"_b={b}" for b, v in versions.items() if v == 0} and len(kept) < len(full)


def test_ended_and_silent_keys_leave_the_state(spark, frame):
    schema = "id int, k int, t timestamp, s int"
    state = _state(spark, ["k"], "t", buckets=2)
    step = _old_step(ended=F.col("s") == 9, max_idle_seconds=100)
    run = keyed.batch_function(step, state)
    run(frame(schema, (1, 1, at(0), 7), (2, 2, at(1), 7), (3, 3, at(2), 7)), 0)
    run(frame(schema, (4, 1, at(50), 9), (5, 2, at(60), 8)), 1)
    assert rows(state.current(spark), "k") == [(2,), (3,)]
    for i in range(2, 2 + keyed.SWEEP):  # each bucket is visited once at least
        run(frame(schema, (10 + i, 2, at(120 + i), 8)), i)
    assert rows(state.current(spark), "k") == [(2,)]
    assert rows(keyed.output(spark, state, "expired"), "k", "id") == [(3, 3)]


def test_stream_of_pairs_and_expiry(spark, tmp_path, frame):
    data = frame(SNAP, (1, "s", "Start", at(0), 10, 1), (2, "s", "Start", at(1), 1, 1),
                 (1, "s", "End", at(50), 15, 4), (3, "s", "Start", at(60), 1, 1),
                 (3, "s", "End", at(500), 2, 2))
    stream = _feed(spark, tmp_path, data, [("a", F.col("dttm") < at(10)),
                                           ("b", F.col("dttm").between(at(10), at(100))),
                                           ("c", F.col("dttm") > at(100))])
    step = stateful.pair_snapshots_step(["prcsinstance", "statistic"], "dttm", "phase",
                                        ["db_value", "my_value"], max_age_seconds=450)
    state = _state(spark, ["prcsinstance", "statistic"], "dttm", buckets=1)
    keyed.run_keyed(stream, step, state).awaitTermination()
    assert rows(keyed.output(spark, state, "result"), "prcsinstance", "db_value_after") == [
        (1, 15), (3, 2)]
    assert rows(keyed.output(spark, state, "expired"), "prcsinstance") == [(2,)]
    assert state.current(spark) is None or state.current(spark).count() == 0


def test_stream_progress_counts_on(spark, tmp_path, history):
    stream = _feed(spark, tmp_path, history, [("a", "id < 20"), ("b", "id >= 20")])
    state = _state(spark, ["k"], "t")
    step = stateful.progress_step("k", ["t", "id"], ts="t", ended=F.col("id") == 38)
    keyed.run_keyed(stream, step, state).awaitTermination()
    got = keyed.output(spark, state, "result")
    assert rows(got, "id", "sofar") == sorted([(i, i // 3) for i in range(40)], key=repr)
    assert rows(state.current(spark), "k", "_seen") == [(1, 14), (2, 13)]


MESSAGE = "process_instance int, o int, message string, severity int"


def test_messages_are_numbered_on_over_batches(spark, frame):
    parts = [frame(MESSAGE, (1, 1, "a", 0), (2, 1, "b", 0), (1, 2, None, 0)),
             frame(MESSAGE, (1, 3, "c " * 200, 0), (3, 1, "d", 0), (1, 4, "e", None)),
             frame(MESSAGE, (3, 2, "f", 0), (1, 5, "g", 0), (0, 1, "h", 0))]
    before = frame("process_instance int, message_seq int", (1, 1), (1, 4), (3, 2))
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    header, pieces = ops.append_messages(whole, before, ["o"])
    state = _state(spark, ["process_instance"], buckets=4)
    state.seed(ops.used_sequences(before, "process_instance", "message_seq"))
    run = keyed.batch_function(stateful.append_messages_step(["o"]), state)
    for i in (0, 1, 1, 2):
        run(parts[i], i)
        state.seed(before)  # too late: nothing happens
    assert rows(keyed.output(spark, state, "header")) == rows(header)
    assert rows(keyed.output(spark, state, "pieces")) == rows(pieces)


def test_archive_and_live_add_up(spark, frame):
    schema = "op string, seq int, k int, v string"
    parts = [frame(schema, ("I", 1, 1, "a"), ("I", 2, 2, "b"), ("D", 3, 2, "b")),
             frame(schema, ("U", 4, 1, "A"), ("I", 5, 3, "c"), ("I", 6, 2, "again")),
             frame(schema, ("D", 7, 1, "A"), ("D", 8, 99, "never there"))]
    state = _state(spark, ["k"], buckets=2)
    run = keyed.batch_function(stateful.archive_step(["k"], ["k", "v"], ["seq"]), state)
    for i in (0, 0, 1, 2, 2):
        run(parts[i], i)
    assert rows(keyed.output(spark, state, "archive")) == [(1, "A"), (2, "b"), (99, "never there")]
    assert rows(state.current(spark)) == [(2, "again"), (3, "c")]


def test_validity_of_dated_labels(spark, frame):
    dated = frame("fieldvalue string, effdt timestamp, eff_status string, xlatshortname string",
                  ("7", at(100), "A", "New"), ("7", at(0), "A", "Old"), ("7", at(100000), "I", "Gone"),
                  ("9", at(50), "A", "Done"), ("8", None, "A", "Undated"), ("9", at(53), "A", "Done?"))
    df = frame("code string, t timestamp", *[("7", at(x)) for x in (-1, 0, 99, 100, 99999, 100000)],
               ("9", at(49)), ("9", at(52)), ("9", at(10**6)), ("8", at(0)), (None, at(0)), ("7", None))
    found = Validity.of(dated).at(df, "code", "t", "label")
    assert rows(found) == rows(frame("code string, t timestamp, label string", *[
        ("7", at(-1), None), ("7", at(0), "Old"), ("7", at(99), "Old"), ("7", at(100), "New"), ("7", at(99999), "New"),
        ("7", at(100000), None), ("9", at(49), None), ("9", at(52), "Done"), ("9", at(10**6), "Done?"), ("8", at(0), None),
        (None, at(0), None), ("7", None, None)]))
    assert rows(Validity.of(dated.limit(0)).at(df, "code", "t", "label").where("label IS NOT NULL")) == []


def test_stream_running_stats(spark, tmp_path, frame):
    log = frame("oprid string, qryname string, exectime double, fetchtime double, numrows double,"
                " execdttm timestamp, killedreason string",
                *[("o", f"q{i % 2}", float(i), 1.0, 2.0, at(i), " " if i % 3 else "k")
                  for i in range(12)])
    stream = _feed(spark, tmp_path, log, [("a", "exectime < 5"), ("b", "exectime >= 5")])
    folder = stateful.fresh_folder(spark, "t")
    stateful.run_updates(stateful.running_stats_stream(stream), folder).awaitTermination()
    got = stateful.read_latest(spark, folder, ["oprid", "qryname"])
    assert rows(got, "qryname", "execcount", "avgexectime", "numkills") == [
        ("q0", 6, 5.0, 2), ("q1", 6, 6.0, 2)]


def test_windows_keep_late_rows(spark, tmp_path, history):
    stream = _feed(spark, tmp_path, history, [("a", "id BETWEEN 6 AND 13"), ("b", "id BETWEEN 14 AND 30"),
                                              ("c", "id < 6 OR id > 30")])
    state = _state(spark, (), "t", buckets=1)
    sums = {"n": ("count", None), "total": ("sum", "id"), "low": ("min", "id"), "high": ("max", "id")}
    keyed.run_keyed(stream, stateful.windowed_step("t", ["k"], 60, 60, sums), state).awaitTermination()
    assert rows(keyed.output(spark, state, "late"), "id") == [(i,) for i in range(6)]
    got = keyed.output(spark, state, "result").groupBy("k").agg(
        F.sum("n"), F.sum("total"), F.min("low"), F.max("high"))
    # seen up to second 390 less 60: the five buckets that end by 330, from id 6 on
    ids = {k: [i for i in range(6, 30) if 1 + i % 3 == k] for k in (1, 2, 3)}
    assert rows(got) == [(k, len(x), sum(x), min(x), max(x)) for k, x in ids.items()]


def test_equal_times_are_late_by_their_tie(spark, tmp_path, frame):
    data = frame("id int, k int, t timestamp, s int", (5, 1, at(0), 1), (3, 1, at(0), 2), (7, 1, at(0), 3))
    stream = _feed(spark, tmp_path, data, [("a", "id = 5"), ("b", "id <> 5")])
    state = _state(spark, ["k"], "t")
    keyed.run_keyed(stream, _old_step(), state).awaitTermination()
    assert rows(keyed.output(spark, state, "late"), "id") == [(3,)]
    assert rows(keyed.output(spark, state, "result"), "id", "old") == [(5, None), (7, 1)]


def test_window_step_must_divide_a_day(spark, history):
    with pytest.raises(ValueError):
        stateful.windowed_counts_stream(history, "t", ["k"], 420, "1 minute")


def test_a_part_is_written_by_many_tasks_and_read_as_one_batch(spark):
    ids = spark.range(0, 400, 1, 4)
    fed = registered._fed(ids, F.col("id") % 3)
    batches, checkpoint = [], stateful.fresh_folder(spark, "checkpoint")

    def start(stream):
        def note(batch, batch_id):
            named = batch.select("id", F.input_file_name().alias("file")).collect()
            batches.append((batch_id, len({r["file"] for r in named}), sorted(r["id"] for r in named)))

        return stream.writeStream.foreachBatch(note).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    fed.run(start)
    assert batches == [(i, 4, [n for n in range(400) if n % 3 == i]) for i in range(3)]
