"""Log formats on small logs of the same layout."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from opsight.operators import distribution, stats
from opsight.sources import files, formats, loader, versions
from tests.conftest import rows

W3C = """#Version:\t1.0
#Fields:\tdate time time-taken bytes c-ip c-dns cs-method sc-status cs(User-Agent) cs-uri-stem cs-uri-query
2031-05-06\t08:15:00\t2.625\t311\t10.0.0.3\thost\tGET\t200\t"Agent (x; y)"\t/shop/\tcmd=basket&a%20b&c
2031-05-06\t08:15:01\t1.5\t0\t10.0.0.3\thost\tGET\t-\t"Agent"\t/x\t-
2031-05-06\tnever\t1.5\t0\t10.0.0.3\thost\tGET\t200\t"Agent"\t/x\t-
2031-05-06\t08:15:01\t1.5\t0\t10.0.0.3000\thost\tGET\t200\t"Agent"\t/x\t-"""
PIPE = """2031.07.08 10:20:30|0|83|-|10.9.8.7|Agent (x; y)|200|GET|/pic/z.png|
2031.07.08 10:20:31|2|87654321|-|10.9.8.7|Agent|200|GET|/b|?x=1&y=2|3
2031.07.08 10:20:32|2|9|-|10.9.8.7|Agent|-|GET|/b|?x=1&y=2|3"""
TRACE = """ SERVICE    PID        SDATE        STIME        EDATE        ETIME
 -------    ---        -----        -----        -----        -----
@OpenBasket 77       2000000000   1000250      2000000001   1001500
@ShowItem 77       2000000005   1005000      2000000009   1009125
@ShowItem x       2000000005   1005000      2000000009   1009125"""
MESSAGES = """071500.UNIT-9!SHOPSRV.41.7.5: TRACE:at:  { tpservice({"PutItem", 0x0, 0xabc, 456, 0, -1})
071500.UNIT-9!SHOPSRV.41.7.5: TRACE:at:    { tpalloc("BYTES", "", 512)
071500.UNIT-9!SHOPSRV.41.7.5: TRACE:at:    } tpalloc = 0xdef
071501.UNIT-9!SHOPSRV.41.7.5: TRACE:at:    { tpreturn(2, 0, 0x123, 7777, 0x0)
071502.UNIT-9!SHOPSRV.41.7.5: TRACE:at:    } tpreturn [long jump]"""


def load(spark, tmp_path, content, fmt, name="log"):
    path = tmp_path / name
    path.write_text(content + "\n")
    return loader.load_with_rejects(loader.read_log_set(spark, str(path)), fmt)


def report(result):
    return tuple(loader.load_report(result).first())


def test_w3c_access_log(spark, tmp_path):
    result = load(spark, tmp_path, W3C, formats.w3c_access_log())
    assert report(result) == (6, 2, 2, 2)
    first = result.accepted.orderBy("timestamp").first()
    assert first["timestamp"] == dt.datetime(2031, 5, 6, 8, 15)
    assert (first.duration, first.bytes_sent) == (Decimal("2.625"), Decimal(311))
    assert (first.remote_host1, first.remote_host4, first.user_agent) == ("10", "3", "Agent (x; y)")
    assert (first.query_string1, first.query_string2, first.query_string4) == (
        "md=basket", "a%20b", None)
    second = result.accepted.orderBy(F.desc("timestamp")).first()
    assert second.return_status is None and second.query_string1 is None
    reasons = {r for row in result.rejected.collect() for r in row.reasons}
    assert {"timestamp not convertible", "remote_host4 too long"} <= reasons
    kept = load(spark, tmp_path, W3C, formats.w3c_access_log(drop_first=False), "again")
    assert rows(kept.accepted, "query_string1") == [("-",), ("cmd=basket",)]


def test_pipe_access_log(spark, tmp_path):
    result = load(spark, tmp_path, PIPE, formats.pipe_access_log())
    assert report(result) == (3, 2, 1, 0)  # bytes_sent holds seven digits
    last = result.accepted.orderBy(F.desc("timestamp")).first()
    assert (last.query_string1, last.query_string2) == ("x=1", "y=2|3")
    assert last.return_status is None


def test_service_trace(spark, tmp_path):
    result = load(spark, tmp_path, TRACE, formats.service_trace("APPQ"))
    assert report(result) == (5, 2, 1, 2)
    row = result.accepted.orderBy("stime").first()
    assert row.service == "OpenBasket"
    assert row.stimestamp == dt.datetime(2033, 5, 18, 4, 33, 20)  # an hour ahead
    assert (row.stime, row.etime) == (Decimal("1000.250"), Decimal("1001.500"))
    summary = stats.service_summary(result.accepted)
    assert rows(summary, "queue", "service", "requests") == [
        ("APPQ", "OpenBasket", 1), ("APPQ", "ShowItem", 1)]


def test_message_log(spark, tmp_path):
    result = load(spark, tmp_path, MESSAGES, formats.message_log("2031-05-06"))
    assert report(result) == (5, 2, 3, 0)
    assert rows(result.accepted, "funcname", "service", "msg_size") == [
        ("tpreturn", "2", Decimal(7777)), ("tpservice", '{"PutItem"', Decimal(456))]
    carried = distribution.carry_forward(
        result.accepted, F.when(F.col("funcname") == "tpservice", F.col("service")),
        list(loader.LINE_ORDER), ["file"])
    assert rows(carried.where("funcname = 'tpreturn'"), "carried") == [('{"PutItem"',)]


def test_sql_trace(spark, tmp_path):
    line = ("SHOPSRV.77 1-42 10.11.12 0.010 Cur#3.DB7 RC=0 Dur=0.020 "
            "COM Stmt=SELECT 'x' FROM t WHERE a = 3&tail")
    row = load(spark, tmp_path, line, formats.sql_trace("2004-01-01")).accepted.first()
    assert (row.program, row.pid, row.line_num, row.cursor, row.database) == (
        "SHOPSRV", 77, 42, 3, "DB7")
    assert row.operation == "COM Stmt=SELECT 'x' FROM t WHERE a = 3"
    client = line.split(" ", 1)[1]
    row = load(spark, tmp_path, client, formats.sql_trace("2004-01-01", False), "c").accepted.first()
    assert (row.program, row.pid, row.line_id) == ("Client", 0, 1)


def test_line_order_and_per_file_csv(spark, tmp_path):
    for name, sizes in (("a", (5, 0, 9)), ("b", (7,))):
        (tmp_path / f"log.{name}").write_text("\n".join(str(s) for s in sizes) + "\n")
    lines = loader.read_log_set(spark, str(tmp_path / "log.*"))
    sized = lines.withColumn("size", F.col("value").cast("int"))
    cdf = distribution.rowwise_cdf(sized, "file", "size", list(loader.LINE_ORDER))
    got = {(r.file, r.size): (r.prop_messages, r.prop_traffic) for r in cdf.collect()}
    assert got == {("log.a", 5): (2 / 3, 5 / 14), ("log.a", 9): (1.0, 1.0), ("log.b", 7): (1.0, 1.0)}
    out = str(tmp_path / "out")
    loader.write_per_file_csv(cdf.select("file", "size", "prop_messages"), out, order=["size"])
    back = spark.read.option("header", True).csv(f"{out}/file=log.a")
    assert rows(back, "size") == [("5",), ("9",)]


def test_lines_of_split_files_keep_their_order(spark, tmp_path):
    for name, n in (("a", 4000), ("b", 3), ("c", 900)):
        (tmp_path / f"log.{name}").write_text("".join(f"{name} {i} {'x' * (i % 40)}\n" for i in range(1, n + 1)))
    small = {"spark.sql.files.maxPartitionBytes": "9000", "spark.sql.files.openCostInBytes": "10",
             "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        lines = loader.line_numbers(loader.read_log_set(spark, str(tmp_path / "log.*")))
        assert lines.where("file = 'log.a'").select("block").distinct().count() > 5
        got = lines.select("file", "line", F.split("value", " ")[1].cast("long").alias("i"))
        assert got.count() == 4903 and got.where("line <> i").count() == 0
        out = str(tmp_path / "out")
        loader.write_per_file_csv(lines.drop("line"), out)
        back = loader.read_per_file_csv(spark, out, "value string")
        assert back.where("file = 'log.a'").select("part").distinct().count() > 1
        assert set(back.columns) == {"value", "file", "part", "seq"}
        for name, n in (("a", 4000), ("b", 3), ("c", 900)):
            found = back.where(f"file = 'log.{name}'").orderBy("part", "seq").collect()
            assert [int(r["value"].split()[1]) for r in found] == list(range(1, n + 1))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_failed_load_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        versions.current(spark, path)
    assert versions.replace_load(spark.range(5), path).count() == 5
    broken = spark.range(8).select(F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        versions.replace_load(broken, path)
    assert rows(versions.current(spark, path)) == [(i,) for i in range(5)]
    opened = versions.current(spark, path)
    # a load may read the table it replaces, and who has opened the old one can go on
    assert rows(versions.replace_load(versions.current(spark, path).where("id > 2"), path)) == [(3,), (4,)]
    assert opened.count() == 5
    assert versions.replace_load(spark.range(0), path).count() == 0
    assert len([n for n in files.names(spark, path) if n.startswith("v-")]) == 2


def test_a_repeated_append_does_not_double(spark, tmp_path):
    path = str(tmp_path / "t")
    for load, n in (("a", 3), ("b", 2), ("a", 3)):
        table = versions.materialize(spark.range(n), path, load)
    assert rows(table) == [(0,), (0,), (1,), (1,), (2,)]
    broken = spark.range(9).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        versions.materialize(broken, path, "b")
    assert table.count() == 5
    assert versions.materialize(spark.range(0), path, "a").count() == 2
    with pytest.raises(ValueError, match="load id"):
        versions.append_load(spark.range(1), path, "a/b")
    with pytest.raises(ValueError, match="holds the load id"):
        versions.append_load(spark.range(1).withColumn("load_id", F.lit(1)), path, "c")
    snapshot = str(tmp_path / "s")
    assert versions.materialize(versions.materialize(spark.range(4), snapshot).where("id > 1"), snapshot).count() == 2


def test_error_limit(spark, tmp_path):
    result = load(spark, tmp_path, W3C, formats.w3c_access_log())
    assert not loader.within_error_limit(loader.load_report(result), 1).first().within_limit
