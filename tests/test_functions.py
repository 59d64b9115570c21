"""Text, time and rule expressions: one test per peculiarity."""

import datetime as dt
import random

import time

import pytest
from tests.conftest import rows
from pyspark.sql import functions as F

from opsight.functions import rules, text, timegrid


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_query_slots(frame):
    df = frame("q string", ("?a=1&b=&c=3&d&e&f&g&h&ninth",), ("-",), (None,))
    got = text.split_query_string(df, "q", drop_first=True).drop("q").collect()
    assert tuple(got[0]) == ("a=1", "b=", "c=3", "d", "e", "f", "g", "h", "ninth")
    assert got[1][0] is None  # '-' loses its only character
    assert got[2][0] is None
    assert text.split_query_string(df, "q").collect()[1][1] == "-"


@pytest.mark.parametrize("raw, want", [
    ("a%20b+c", "a b+c"), ("%2541", "A"), ("%25252541", "A"), ("%", "%"), ("%zz", "%zz"),
    ("plain", "plain"), ("%252525252525252541", "A"), (None, None), ("a=100%&b=x%20y", "a=100%&b=x y"),
    ("%zz%41%", "%zzA%"), ("%%34%31", "A"), ("%C3%A9%2", "é%2"), ("", ""),
])
def test_percent_decode(frame, raw, want):
    df = frame("s string", (raw,))
    assert text.percent_decode(df, ["s"]).first()[0] == want


@pytest.mark.parametrize("raw, want", [
    ("SELECT a FROM t WHERE x = 5 AND y='it''s'", "SELECT a FROM t WHERE x=: AND y=:"),
    ("CEX Stmt=UPDATE t SET a=1.5 , b = 22", "UPDATE t SET a=:,b=:"),
    ("SELECT T1.A FROM T1 WHERE F(1,22) > 3", "SELECT T1.A FROM T1 WHERE F(:,:)>:"),
    ("Fetch", "Fetch"),
])
def test_fingerprint(spark, raw, want):
    assert one(spark, text.fingerprint(F.lit(raw))) == want


def test_classification_takes_the_first_match(frame):
    df = frame("url string", ("/psp/hr88/x/F84D/",), ("/HR88/",), ("/x/",))
    assert [r.domain for r in text.classify_url_domain(df).collect()] == ["F84D", "HR88", None]


def test_reassign_queue(frame):
    df = frame("service string, queue string", (".GETSVC", "APPQ"), ("RamList", "APPQ"),
               ("Other", "APPQ"))
    assert rows(text.reassign_queue(df), "queue") == [("APPQ",), ("JREPQ",), ("QCKQ",)]


def test_parts_of_text(spark):
    assert one(spark, text.nth_delimited_tail(F.lit("a=b=c=d"))) == "c=d"
    assert one(spark, text.nth_delimited_tail(F.lit("a=b"))) == "a=b"
    assert one(spark, text.host_of(F.lit("h:1:2"))) == "h"
    assert one(spark, text.port_of(F.lit("h:1:2"))) == "1:2"
    assert one(spark, text.host_of(F.lit("h"))) is None
    assert one(spark, text.port_of(F.lit("h"))) == "h"
    assert one(spark, text.strip_instance_suffix(F.lit("Q-1-12.pdf"), F.lit(12))) == "Q-1"
    assert one(spark, text.strip_instance_suffix(F.lit("Q-13.pdf"), F.lit(12))) is None
    assert [one(spark, text.statement_type_from_ascii(F.lit("a" + c))) for c in "\x02\x04z"] == [
        "D", "S", "_"]


def test_labels_and_tags(spark):
    null = F.lit(None).cast("string")
    assert one(spark, text.labelled_metric(3, null, F.lit(2))) == "Metric3:=2"
    assert one(spark, text.session_tag(F.lit("SQR Report"), F.lit("A-B"), F.lit(7))) == (
        "SQR_Report_A_B_7")
    assert len(one(spark, text.status_comment(
        F.lit("x" * 200), F.lit("n"), F.lit(1), F.lit("End"), F.lit("o"), 160))) == 160
    assert one(spark, text.action_tag(F.lit(12), F.lit("y" * 40), 32)) == "PI=12:" + "y" * 26
    assert one(spark, text.decode_codes(null, {"a": "A", None: "nothing"})) == "nothing"


def _pieces(value, size, limit):
    out, start = [], 0
    while start < len(value) and (limit is None or len(out) < limit):
        piece = value[start:start + size]
        blank = piece.rfind(" ") + 1
        if len(piece) == size and 0 < blank < size:
            piece = piece[:blank]
        out.append(piece)
        start += len(piece)
    return out


def test_chunks_match_the_rule(frame):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab \n") for _ in range(n)) for n in (0, 1, 9, 10, 11, 200)]
    texts += ["x" * 35, "x" * 9 + " y", "a" * 10, "é" * 12]
    df = frame("i int, t string", *enumerate(texts))
    for limit in (3, None):
        got = df.select("i", text.text_chunks("t", 10, limit)).collect()
        assert {i: p for i, p in got} == {i: _pieces(t, 10, limit) for i, t in enumerate(texts)}
    numbered = text.chunk_text(df.where("i = 6"), "t", 10, None)
    assert rows(numbered, "parm_seq", "message_parm") == [
        (1, "x" * 10), (2, "x" * 10), (3, "x" * 10), (4, "x" * 5)]


def test_grid_is_anchored_at_midnight(spark):
    def at(f, stamp, secs):
        return one(spark, f(F.lit(stamp).cast("timestamp"), secs))

    assert at(timegrid.time_floor, "2024-01-02 00:13:59", 420) == dt.datetime(2024, 1, 2, 0, 7)
    assert at(timegrid.time_ceil, "2024-01-02 23:59:01", 3600) == dt.datetime(2024, 1, 3)
    assert at(timegrid.time_round, "2024-01-02 00:03:30", 420) == dt.datetime(2024, 1, 2, 0, 7)
    assert at(timegrid.time_ceil, "2024-01-02 00:07:00.9", 420) == dt.datetime(2024, 1, 2, 0, 7)


def test_linear(spark):
    def t(s):
        return F.lit(f"2024-01-01 00:00:{s:02d}").cast("timestamp")

    assert one(spark, timegrid.linear(t(0), F.lit(10.0), t(20), F.lit(30.0), t(5))) == 15.0
    assert one(spark, timegrid.linear(t(3), F.lit(1.0), t(3), F.lit(9.0), t(3))) == 1.0
    assert one(spark, timegrid.linear(
        t(0), F.lit(None).cast("double"), t(3), F.lit(9.0), t(3))) is None


def test_time_filters(frame):
    df = frame("s string", ("2024-01-02 00:00:00",), ("2024-01-01 00:00:00",)).select(
        F.col("s").cast("timestamp").alias("t"))
    assert df.where(timegrid.within_days("t", "2024-01-31 00:00:00", 30)).count() == 1
    assert df.where(timegrid.between_times("t", "2024-01-01 00:00:00", "2024-01-02 00:00:00")
                    ).count() == 2


def test_flags(spark):
    assert one(spark, rules.has_flag(F.lit(4096 + 128), 4096))
    assert not one(spark, rules.has_flag(F.lit(128), 4096))
    assert one(spark, rules.has_flag(F.lit(17), 16))
    assert not one(spark, rules.has_flag_unfloored(F.lit(17), 16))
    assert one(spark, rules.has_flag_unfloored(F.lit(48), 16))


def test_rules(frame):
    df = frame("i int, f string", (1, "tpservice"), (2, "other"), (3, None))
    checks = {"allowed": F.col("f").isin("tpservice", "tpreturn"), "given": F.col("f").isNotNull()}
    assert rows(rules.check_rules(df, checks), "i", "rule") == [(2, "allowed"), (3, "given")]


def test_percent_decoding_ends_when_nothing_is_left(spark):
    """Long texts with many bare '%' take the rounds of their deepest code, not one per sign."""
    long = "%25252541 50% of it, 100%! " + "a% b " * 20_000
    df = spark.createDataFrame([(long,)] * 2, "t string")
    text.percent_decode(df.limit(1), ["t"]).collect()
    start = time.perf_counter()
    got = text.percent_decode(df, ["t"]).collect()
    assert time.perf_counter() - start < 5
    assert [r["t"] for r in got] == ["A" + long[9:]] * 2
