"""Ranking, series, join and statistics operators on small cases."""

import datetime as dt
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opsight.operators import distribution, dominance, joins, ranking, series, stats
from opsight.plans import reports
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_rank_keeps_ties_and_gaps(frame):
    df = frame("k string, v int", *[(f"k{i}", v) for i, v in enumerate([9, 8, 8, 7, 7, 7, 1])])
    got = ranking.top_n_rank(df, "v", 4)
    assert rows(got, "v", "rnk") == [(7, 4)] * 3 + [(8, 2)] * 2 + [(9, 1)]
    assert rows(ranking.top_n_rank(df, "v", 2), "v", "rnk") == [(8, 2), (8, 2), (9, 1)]
    assert rows(ranking.top_n_rank(df, "v", 1, descending=False), "v", "rnk") == [(1, 1)]


def test_rank_puts_null_first_when_descending(frame):
    df = frame("v int", (1,), (None,), (3,))
    assert rows(ranking.top_n_rank(df, "v", 2)) == [(3, 2), (None, 1)]


def test_shares(frame):
    df = frame("g string, v int", ("a", 1), ("a", 3), (None, 5), ("z", 0))
    whole = ranking.share(df, {"s": "v"})
    assert sum(r.s for r in whole.collect()) == pytest.approx(1)
    per = {(r.g, r.v): r.s for r in ranking.share(df, {"s": "v"}, ["g"]).collect()}
    assert per == {("a", 1): 0.25, ("a", 3): 0.75, (None, 5): 1.0, ("z", 0): None}


def test_cumulative_share_gives_peers_the_same(frame):
    df = frame("i int, v int", (1, 5), (2, 5), (3, 10))
    got = {r.i: r.c for r in ranking.cumulative_share(df, "v", {"c": "v"}).collect()}
    assert got == {1: 0.5, 2: 0.5, 3: 1.0}


def test_report_after_rank_filter(frame):
    totals = frame("name string, t double", ("a", 50.0), ("b", 30.0), ("c", 20.0))
    got = reports.ranked_shares(totals, 2, "t", {"t": "t"})
    assert rows(got, "name", "stmtrank", "pct_t", "cum_t") == [
        ("a", 1, 50.0, 50.0), ("b", 2, 30.0, 80.0)]


def test_minus_is_distinct(frame):
    a = frame("x int", (1,), (1,), (2,), (3,))
    assert rows(ranking.minus(a, frame("x int", (2,)), frame("x int", (3,)))) == [(1,)]


def test_counter_delta(frame):
    df = frame("k int, t int, a int, b int, ka string, kb string",
               (1, 1, 10, 5, "1", "2"), (1, 2, 14, 6, "1", "2"), (1, 3, 4, 7, "1", "2"))
    got = series.counter_delta(df, ["k"], ["t"], {"a": "ka", "b": "kb"})
    assert rows(got, "t", "a", "b") == [(1, None, 5), (2, 4, 6), (3, 4, 7)]


def test_lookback_filters_on_the_raw_value(frame):
    df = frame("k int, t timestamp, v int, kind string",
               (1, at(0), 5, "1"), (1, at(60), 5, "1"), (1, at(120), 0, "1"), (1, at(180), 2, "1"))

    def compute(wide):
        return series.counter_delta(wide, ["k"], ["t"], {"v": "kind"})

    got = series.with_lookback(df, "t", str(at(0)), str(at(60)), str(at(180)), compute, "v")
    assert rows(got, "v") == [(0,), (2,)]


def test_resample(frame):
    df = frame("k int, t timestamp, v double",
               (1, at(50), 0.0), (1, at(110), 60.0), (1, at(115), 65.0), (1, at(400), 0.0))
    got = series.resample_linear(df, ["k"], "t", ["v"], 60)
    assert rows(got, "t", "adj_ts", "comp_v") == [(at(50), at(60), 10.0)]
    # a gap of two steps or more is not bridged; every_grid_point fills one below
    wide = frame("k int, t timestamp, v double", (1, at(1), 0.0), (1, at(119), 118.0))
    every = series.resample_linear(wide, ["k"], "t", ["v"], 60, every_grid_point=True)
    assert rows(every, "adj_ts", "comp_v") == [(at(60), 59.0)]
    exact = frame("k int, t timestamp, v double", (1, at(60), 7.0), (1, at(90), 9.0))
    assert rows(series.resample_linear(exact, ["k"], "t", ["v"], 60), "comp_v") == [(7.0,)]


@pytest.mark.parametrize("limit", [3, 1000])
def test_spread_and_trend(frame, limit):
    data = [(1, 10.0), (1, 20.0), (1, 60.0), (2, 5.0), (2, 5.0), (2, 9.0), (2, 11.0), (3, 7.0)]
    got = {r.level: r for r in series.load_vs_cpu(
        frame("level int, cpu double", *data), "level", ["cpu"], limit).collect()}
    assert [got[i].med_cpu for i in (1, 2, 3)] == [20.0, 7.0, 7.0]
    assert got[3].std_cpu == 0.0  # one sample
    n = len(data)
    mx, my = sum(x for x, _ in data) / n, sum(y for _, y in data) / n
    slope = sum((x - mx) * (y - my) for x, y in data) / sum((x - mx) ** 2 for x, _ in data)
    assert got[2].cpu_y == pytest.approx(my + slope * (2 - mx))


def test_find_groups(frame):
    df = frame("q string, c string, r string", ("q1", "A", "X"), ("q1", "B", "Y"), ("q2", "A", "X"),
               ("q2", "B", "Z"), ("q3", "A", "Y"), ("q3", "B", "X"))
    wanted = [{"c": "A", "r": "X"}, {"c": "B", "r": "Y"}]
    assert rows(joins.find_groups_with_members(df, ["q"], wanted)) == [("q1",)]


def test_scalar_cross_refuses_several_rows(frame):
    df, one = frame("a int", (1,), (2,)), frame("b int", (7,))
    assert rows(joins.scalar_cross(df, one)) == [(1, 7), (2, 7)]
    with pytest.raises(Exception, match="several rows"):
        joins.scalar_cross(df, frame("b int", (7,), (8,))).collect()


def _like(value, pattern):
    return re.fullmatch(re.escape(pattern).replace("%", ".*").replace("_", "."), value) is not None


def test_like_join_matches_brute_force(frame):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 5))) for _ in range(40)]
    pats = sorted({"".join(rnd.choice("ab%_") for _ in range(rnd.randint(1, 4)))
                   for _ in range(40)}) + ["zz%"]
    df = frame("i int, t string", *enumerate(texts))
    patterns = frame("p string", *[(p,) for p in pats])
    got = rows(joins.like_join(df, patterns, [("t", "p")], salts=3), "i", "p")
    want = sorted(((i, p) for i, t in enumerate(texts) for p in pats if _like(t, p)), key=repr)
    assert got == want
    kept = joins.like_join(df, patterns, [("t", "p")], how="left_patterns")
    assert kept.where("p = 'zz%' AND i IS NULL").count() == 1


def test_like_join_by_grams(frame):
    """Patterns without a prefix meet only the texts that hold their rarest three characters."""
    rnd = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta_x", "50%off", "a\\\\b", "x"]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 4))) for _ in range(200)] + [None, "alpha"]
    pats = ["%alp%", "_lpha%", "%gam%bet%", "al%", "%elta\\_x", "%50\\%o%", "%zzz%", "%", "_", "alpha", "%a", "", None, "%alpha beta%"]
    df = frame("i int, t string, u string", *[(i, t, "u") for i, t in enumerate(texts)])
    patterns = frame("n int, p string, q string", *[(i, p, "_") for i, p in enumerate(pats)] + [(90, "%alp%", "_"), (91, "%alp%", "x")])
    plain = df.join(patterns, F.expr("t LIKE p AND u LIKE q")).select("i", "t", "n", "p")
    for hot in (1_000_000, 5):
        got = joins.like_join(df, patterns, [("t", "p"), ("u", "q")], salts=3, hot_texts=hot)
        assert rows(got, "i", "t", "n", "p") == rows(plain)
    kept = joins.like_join(df, patterns, [("t", "p"), ("u", "q")], how="left_patterns")
    assert {r["n"] for r in kept.where("i IS NULL").collect()} == {6, 12, 91}


def _spans(seed, n=150):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        start = rnd.randint(0, 300)
        clock = rnd.choice([0, 0, 0, 1000])  # a restarted clock moves ts, not start
        out.append((i, rnd.choice("pqq"), start, start + rnd.choice([0, 1, 3, 40, 200]),
                    at(start + clock)))
    return out


def test_one_broken_end_does_not_multiply_rows(frame):
    """Blocks of a very long look-back are filed only where it asks for them."""
    schema = "i int, q string, s long, e long, t timestamp"
    data = [(i, "q", 7 * i, 7 * i + i % 40, at(7 * i)) for i in range(400)]
    counts = []
    for extra in ([], [(999, "q", 0, 3 * 10**9, at(2900))]):
        base = frame(schema, *data, *extra).select(
            "q", F.col("i").alias("_id"), F.col("s").alias("_start"), F.col("e").alias("_end"), F.unix_seconds("t").alias("_ts"))
        span = F.col("_end") - F.col("_start") + 1
        asks = joins._with_blocks(base, F.col("_ts") - span, F.col("_ts"), F.lit(joins.SPAN_LEVELS))
        counts.append(joins._filed_where_asked(base, asks).count())
    assert counts[1] < counts[0] + 500 and counts[0] > 2000


@pytest.mark.parametrize("limit", [25, 100_000])
def test_concurrency_matches_brute_force(frame, limit):
    data = _spans(11)
    df = frame("i int, q string, s int, e int, t timestamp", *data)
    strict = {(q, i): sum(b[1] == q and b[2] <= s <= b[3] for b in data) for i, q, s, _, _ in data}
    got = joins.concurrency(df, ["q"], ["i"], "s", "e", max_group_rows=limit)
    assert {(r.q, r.i): r.concurrent for r in got.collect()} == strict
    back = {(q, i): sum(
        b[1] == q and b[2] <= s <= b[3] and b[4] <= t and b[4] >= t - dt.timedelta(seconds=e - s + 1)
        for b in data) for i, q, s, e, t in data}
    got = joins.concurrency(df, ["q"], ["i"], "s", "e", "t", max_group_rows=limit)
    assert {(r.q, r.i): r.concurrent for r in got.collect()} == back
    assert back != strict


def test_blocks_of_the_lookback_are_not_broadcast(frame):
    df = frame("i int, q string, s int, e int, t timestamp", *_spans(11))
    got = joins.concurrency(df, ["q"], ["i"], "s", "e", "t")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("kind", ["double", "decimal(18,6)", "decimal(28,6)"])
def test_lookback_over_many_slices(frame, kind):
    """Long look-backs over many slices, equal times, repeated ids, nulls, ends before starts: as by comparing all pairs.

    A request is not multiplied by the length of its look-back."""
    rnd = random.Random(5)
    data = [(rnd.randrange(180), rnd.choice(["p", "q", None]), rnd.choice([0.0, 5.25, 5.5, rnd.randrange(-300, 300) / 4]),
             rnd.choice([-3.0, -0.5, 0.0, 2.5, 40.0, 5000.0, 3e7]), rnd.choice([7, 7, rnd.randrange(3000)])) for _ in range(240)]
    data = [(i, q, s, s + d, at(t)) for i, q, s, d, t in data] + [(500, "q", None, 1.0, at(1)), (501, "q", 1.0, None, at(1)), (502, "q", 1.0, 2.0, None)]
    df = frame("i int, q string, s double, e double, t timestamp", *data)
    df = df.withColumns({"s": F.col("s").cast(kind), "e": F.col("e").cast(kind)})
    known = [b for b in data if None not in b[2:]]
    want = {}
    for i, q, s, e, t in known:
        span = math.ceil(e - s + 1)
        if span >= 0:
            n = sum(b[1] == q and b[2] <= s <= b[3] and 0 <= (t - b[4]).total_seconds() <= span for b in known)
            want[q, i] = want.get((q, i), 0) + n
    for limit in (7, 100_000):
        got = joins.concurrency(df, ["q"], ["i"], "s", "e", "t", max_group_rows=limit)
        assert got.count() == len(want) and {(r.q, r.i): r.concurrent for r in got.collect()} == want
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_dominated_is_counted_as_by_pairs():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 333):
        rank, weight, order = rng.integers(0, 40, n), rng.integers(-1, 2, n), rng.permutation(n)
        at_ = np.argsort(order)
        want = [sum(weight[j] for j in range(n) if at_[j] < at_[i] and rank[j] < rank[i]) for i in range(n)]
        assert dominance._dominated(order, rank, weight).tolist() == want
    values = pa.array([-np.inf, -2.5, -0.0, 0.0, 1e-300, 7.0, np.inf, np.nan])
    assert (np.diff(dominance._ints(values)) > 0).tolist() == [True, True, False, True, True, True, True]


def test_concurrency_of_equal_starts(spark, frame):
    df = frame("i int, q string, s int, e int", *[(i, "q", 5, 5 + i % 2) for i in range(300)], (300, "q", 6, 6), (301, None, 5, 9))
    got = joins.concurrency(df, ["q"], ["i"], "s", "e", max_group_rows=20)
    assert {(r.q, r.i, r.concurrent) for r in got.collect()} == {
        *(("q", i, 300) for i in range(300)), ("q", 300, 151), (None, 301, 1)}


def test_lookback_misses_an_early_long_request(frame):
    df = frame("i int, q string, s int, e int, t timestamp", (1, "q", 0, 100, at(0)),
               (2, "q", 50, 51, at(50)))
    strict = joins.concurrency(df, ["q"], ["i"], "s", "e")
    parity = joins.concurrency(df, ["q"], ["i"], "s", "e", "t")
    assert rows(strict, "i", "concurrent") == [(1, 1), (2, 2)]
    assert rows(parity, "i", "concurrent") == [(1, 1), (2, 1)]


@pytest.mark.parametrize("limit", [20, 100_000])
def test_parent_with_wrapped_times(frame, limit):
    rnd = random.Random(2)
    data = [(rnd.choice([1, 1, 2]), i, at(rnd.randint(0, 86399)),
             rnd.choice(["COM Stmt=x", "Fetch", "Fetch", "Other"])) for i in range(150)]
    df = frame("c int, n int, t timestamp, operation string", *data)
    got = joins.asof_parent(df, ["c"], "n", "operation", "t", max_group_rows=limit)
    want = []
    for c, n, t, op in data:
        parents = [m for d, m, u, o in data if d == c and m < n and u <= t and o[:3] == "COM"]
        want.append((n, max(parents, default=-1) if op == "Fetch" else 0))
    assert rows(got, "n", "parent_line_num") == sorted(want, key=repr)


def test_parent_in_line_order(frame):
    df = frame("c int, n int, t timestamp, operation string", (1, 1, at(0), "Fetch"),
               (1, 2, at(1), "COM Stmt=a"), (1, 3, at(2), "COM Stmt=b"), (1, 4, at(3), "Fetch"),
               (2, 5, at(4), "Fetch"))
    got = joins.asof_parent(df, ["c"], "n", "operation", "t")
    assert rows(got, "n", "parent_line_num") == [(1, -1), (2, 0), (3, 0), (4, 3), (5, -1)]


def test_effective_date_then_status(frame):
    dated = frame("fieldvalue string, effdt timestamp, eff_status string, xlatshortname string",
                  ("7", at(0), "A", "Old"), ("7", at(100), "I", "New"), ("9", at(0), "A", "Done"))
    df = frame("code string, t timestamp", ("7", at(50)), ("7", at(150)), ("9", at(0)), ("5", at(9)))
    const = joins.effective_dated_lookup(df, dated, "code", str(at(120)))
    assert rows(const, "code", "label") == [("5", "Status:5"), ("7", "Status:7"), ("7", "Status:7"),
                                            ("9", "Done")]
    per_row = joins.effective_dated_lookup(df, dated, "code", "t")
    assert rows(per_row, "code", "t", "label") == [
        ("5", at(9), "Status:5"), ("7", at(50), "Old"), ("7", at(150), "Status:7"),
        ("9", at(0), "Done")]


def test_range_assign(frame):
    spans = ((1, 0, 100), (2, 10, 20), (3, 50, 60), (4, 7, 6), (5, -9, -9), (6, -20, 15))
    ranges = frame("g int, lo int, hi int", *spans)
    values = (15, 55, 70, 15, 0, 100, 101, -9, -21, 10, 20, 21)
    got = joins.range_assign(frame("v int", *[(v,) for v in values]), ranges, "v", "lo", "hi")
    assert rows(got, "v", "g") == sorted(
        ((v, g) for v in values for g, lo, hi in spans if lo <= v <= hi), key=repr)
    nothing = joins.range_assign(frame("v int", (1,)), ranges.limit(0), "v", "lo", "hi")
    assert nothing.count() == 0


def test_range_assign_of_texts_and_fractions(frame):
    spans = (("a", "employee07", "employee11"), ("b", "B", "f"), ("c", "employee11", "employee11"))
    words = ("employee06", "employee07", "employee10", "employee11x", "employee11", "C", "é", "")
    got = joins.range_assign(frame("v string", *[(w,) for w in words]),
                             frame("g string, lo string, hi string", *spans), "v", "lo", "hi")
    assert rows(got, "v", "g") == sorted(
        ((v, g) for v in words for g, lo, hi in spans if lo <= v <= hi), key=repr)
    parts = ((1, 0.5, 0.7), (2, 0.6, 3.2))
    numbers = (0.4, 0.5, 0.65, 3.2, 3.3)
    got = joins.range_assign(frame("v double", *[(v,) for v in numbers]),
                             frame("g int, lo double, hi double", *parts), "v", "lo", "hi")
    assert rows(got, "v", "g") == sorted(
        ((v, g) for v in numbers for g, lo, hi in parts if lo <= v <= hi), key=repr)


@pytest.mark.parametrize("limit", [40, 100_000])
def test_texts_that_begin_alike_have_places_of_their_own(frame, monkeypatch, limit):
    seen, real = [], joins.match_points

    def spy(points, intervals, on, compared, position, *rest):
        seen.append(points.select(position.alias("p")).distinct().count())
        return real(points, intervals, on, compared, position, *rest)

    monkeypatch.setattr(joins, "match_points", spy)
    words = [f"Customer#{i:09d}" for i in range(100)] + [None, "Customer#000000007"]
    spans = [(g, words[g], words[g + g % 4]) for g in range(0, 90, 3)] + [(99, words[5], None), (98, "Customer#00000000", "Customer#0000000015")]
    got = joins.range_assign(frame("v string", *[(w,) for w in words]), frame("g int, lo string, hi string", *spans),
                             "v", "lo", "hi", max_group_rows=limit)
    assert rows(got, "v", "g") == sorted(
        ((v, g) for v in words if v for g, lo, hi in spans if hi and lo <= v <= hi), key=repr)
    assert seen == [100]


def test_interval_join_with_open_end(frame):
    points = frame("k int, t timestamp", (1, at(0)), (1, at(3600)), (1, at(90000)), (2, at(0)))
    spans = frame("kk int, b timestamp, e timestamp", (1, at(0), at(3600)), (1, at(3599), None))
    got = joins.interval_join(points, spans, [("k", "kk")], "t", "b", "e", str(at(90000)))
    assert rows(got, "t", "b") == [(at(0), at(0)), (at(3600), at(0)), (at(3600), at(3599)),
                                   (at(90000), at(3599))]


def test_instance_names(frame):
    records = frame("recname string, rectype int, base_table string, instances int",
                    ("A", 7, "PS_A", 3), ("B1", 0, "PS_B1", 0), ("C", 7, "PS_C", 0))
    tables = frame("table_name string", ("PS_A",), ("PS_A2",), ("PS_A12",), ("PS_B1",), ("PS_B12",))
    got = joins.resolve_instance_name(tables, records)
    assert rows(got, "table_name", "recname", "instance") == [
        ("PS_A", "A", None), ("PS_A12", "A", "12"), ("PS_A2", "A", "2"), ("PS_B1", "B1", None),
        ("PS_B12", None, None)]
    assert rows(joins.numbered_instances(records), "table_name") == [
        ("PS_A1",), ("PS_A2",), ("PS_A3",)]


def test_prefix_names(frame):
    bases = frame("base_table string", ("PS_A",), ("PS_A1",))
    objects = frame("object_name string", *[(n,) for n in (
        "PS_A", "PS_A0", "PS_A7", "PS_A12", "PS_A10000", "PS_A1X", "PS_AB1")])
    got = joins.prefix_name_join(objects, bases)
    assert rows(got, "object_name", "base_table", "instance") == [
        ("PS_A10000", "PS_A", 10000), ("PS_A12", "PS_A", 12), ("PS_A12", "PS_A1", 2),
        ("PS_A1X", "PS_A", None), ("PS_A7", "PS_A", 7)]


def test_unique_key_with_nulls(frame):
    df = frame("a int, b int, c int, d int", (None, None, 0, 1), (None, None, 0, 2),
               (None, None, None, 3), (None, None, None, 4))
    assert rows(stats.duplicate_keys(df, ["a", "b", "c"])) == [(None, None, 0, 2)]
    stored = df.where("d <> 2")
    assert tuple(stats.indexed_rows(stored, ["a", "b", "c"]).first()) == (3, 1)


def test_running_stats_equal_one_by_one(frame):
    log = [("o", "q", 4.0, 1.0, 10.0, at(5), " "), ("o", "q", 8.0, 3.0, 30.0, at(1), "killed"),
           ("o", "new", 2.0, 1.0, 5.0, at(2), None)]
    old = ("o", "q", 3, 2.0, 1.0, 20.0, at(3), 1)
    n, e, f, r, last, kills = 3, 2.0, 1.0, 20.0, at(3), 1
    for row in log[:2]:
        e, f, r = (e * n + row[2]) / (n + 1), (f * n + row[3]) / (n + 1), (r * n + row[4]) / (n + 1)
        last, n, kills = max(last, row[5]), n + 1, kills + (row[6] != " ")
    schema = ("oprid string, qryname string, execcount long, avgexectime double, avgfetchtime double,"
              " avgnumrows double, lastexecdttm timestamp, numkills long")
    stored = frame(schema, old, ("o", "idle", 1, 1.0, 1.0, 1.0, at(0), 0))
    entries = frame("oprid string, qryname string, exectime double, fetchtime double, numrows double,"
                    " execdttm timestamp, killedreason string", *log)
    got = {x.qryname: tuple(x)[2:] for x in stats.running_stats_upsert(stored, entries).collect()}
    assert got["q"] == (n, pytest.approx(e), pytest.approx(f), pytest.approx(r), last, kills)
    assert got["new"] == (1, 2.0, 1.0, 5.0, at(2), 1)
    assert got["idle"] == (1, 1.0, 1.0, 1.0, at(0), 0)


def test_null_time_stays_null(frame):
    entries = frame("oprid string, qryname string, exectime double, fetchtime double, numrows double,"
                    " execdttm timestamp, killedreason string",
                    ("o", "q", 1.0, 1.0, 1.0, None, " "), ("o", "q", 1.0, 1.0, 1.0, at(1), " "))
    assert stats.execution_stats(entries).first().lastexecdttm is None


def test_report_total(frame):
    got = stats.report_total(frame("g string, v int", ("a", 1), ("a", 2), ("b", 4)), ["g"], ["v"])
    assert rows(got) == [("a", 3, 0), ("b", 4, 0), (None, 7, 1)]


def test_size_cdf_ends_at_one(frame):
    df = frame("f string, s int", ("x", 1), ("x", 1), ("x", 8), ("y", 5))
    got = {(r.f, r.s): (r.cum_messages, r.cum_volume) for r in
           distribution.message_size_cdf(df, "s", ["f"]).collect()}
    assert got[("x", 1)] == (pytest.approx(2 / 3), pytest.approx(0.2))
    assert got[("x", 8)] == (pytest.approx(1), pytest.approx(1)) and got[("y", 5)] == (1.0, 1.0)


def test_service_time_cdf_drops_zero_length(frame):
    df = frame("t timestamp, svc string, s double, e double", (at(1), "a", 0.0, 1.0),
               (at(2), "a", 0.0, 1.004), (at(3), "a", 5.0, 5.0), (at(4), "a", 0.0, 3.0))
    got = distribution.service_time_cdf(df, "t", "svc", "s", "e")
    assert rows(got, "svc_time", "num_requests", "cum_svc_time") == [(1.0, 2, 2.0), (3.0, 3, 5.0)]


def test_query_stats(frame):
    runs = frame("prcsinstance int, prcsname string, runstatus int, begindttm timestamp,"
                 " enddttm timestamp", (1, "PSQUERY", 9, at(0), at(10)),
                 (2, "PSQUERY", 9, at(0), at(20)), (3, "PSQUERY", 7, at(0), at(9)))
    files = frame("prcsinstance int, filename string, cdm_file_type string", (1, "Q-1.pdf", "PDF"),
                  (2, "Q-2.xls", "XLS"), (2, "trace-2.log", "LOG"), (3, "Q-3.pdf", "PDF"))
    assert [tuple(r) for r in stats.query_stats(runs, files).collect()] == [("Q", 15.0, 30, 2)]


def test_catalogue_shows_first_context_id(frame):
    ids = ", ".join(f"pm_metricid_{i} int" for i in range(1, 8))
    trans = frame(f"pm_trans_defn_set int, pm_trans_defn_id int, {ids}, pm_contextid_1 int,"
                  " pm_contextid_2 int, pm_contextid_3 int", (1, 5, 1, 2, *[None] * 5, 10, 11, 12))
    metrics = frame("pm_metricid int, pm_metriclabel string, pm_metrictype string", (1, "Reads", "1"))
    texts = frame("fieldname string, fieldvalue string, xlatlongname string",
                  ("PM_METRICTYPE", "1", "Counter"), ("OTHER", "1", "No"))
    names = frame("pm_contextid int, pm_contextlabel string", (10, "User"), (11, "Panel"))
    row = reports.transaction_catalogue(trans, metrics, texts, names).first()
    assert (row.context1, row.context2, row.context3) == ("C1:10=User", "C2:10=Panel", "C3:10=")
    assert (row.metric1, row.pm_metrictype_text1, row.metric2) == ("M1:1=Reads", "Counter", "M2:2=")
    own = reports.transaction_catalogue(trans, metrics, texts, names, first_id_only=False).first()
    assert own.context2 == "C2:11=Panel"
