"""Scans give the same in one window and cut into chunks."""

import random

import pytest
from tests.conftest import rows
from pyspark.sql import functions as F

from opsight.operators import ranking, scan
from opsight.session import shared_dir


def _data(spark, n=400, seed=7):
    rnd = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", None]
    data = [(rnd.choice(keys), rnd.choice(["x", None]), i, rnd.choice([None, 1, 2, 5]))
            for i in range(n)]
    return spark.createDataFrame(data, "k string, k2 string, o int, v int"), data


def outputs():
    return [scan.lag("prev", "v"), scan.lead("nxt", "v"), scan.running_sum("total", "v"),
            scan.last_before("last", "v"), scan.row_number("n")]


def _expected(data):
    groups = {}
    for row in sorted(data, key=lambda r: r[2]):
        groups.setdefault((row[0], row[1]), []).append(row)
    out = []
    for key, members in groups.items():
        total, last = None, None
        for i, (_, _, o, v) in enumerate(members):
            total = v if total is None else total + (v or 0)
            out.append((*key, o, v, members[i - 1][3] if i else None,
                        members[i + 1][3] if i + 1 < len(members) else None, total, last, i + 1))
            last = v if v is not None else last
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [10, 60, 10_000])
def test_scan_matches_plain_python(spark, limit):
    df, data = _data(spark)
    got = scan.ordered_scan(df, ["k", "k2"], ["o"], outputs(), max_group_rows=limit)
    assert rows(got) == _expected(data)


def test_scan_without_keys_and_descending(spark):
    df, _ = _data(spark, 150)
    order = [F.col("o").desc()]
    plain = scan.ordered_scan(df, [], order, outputs(), max_group_rows=10_000)
    chunked = scan.ordered_scan(df, [], order, outputs(), max_group_rows=20)
    assert rows(plain) == rows(chunked)
    assert chunked.agg(F.max("n")).first()[0] == 150


def test_rows_of_equal_order_are_cut(spark, monkeypatch):
    """200,000 rows of one key and order: no chunk above the limit, and numbers without gaps."""
    df = spark.range(200_000, numPartitions=8).select(F.lit("k").alias("k"), F.lit(1).alias("o"), F.lit(2).alias("v"), "id")
    kept, stable = [], scan.stable
    monkeypatch.setattr(scan, "stable", lambda d: kept.append(stable(d)) or kept[-1])
    got = scan.ordered_scan(df, ["k"], ["o"], [scan.row_number("n"), scan.running_sum("total", "v"), scan.lag("before", "id")], 20_000)
    chunks = kept[-1].groupBy("_chunk").count()
    assert chunks.agg(F.max("count")).first()[0] <= 20_000
    ends = got.agg(F.count_distinct("n"), F.min("n"), F.max("n"), F.max("total"), F.count_distinct("before")).first()
    assert tuple(ends) == (200_000, 1, 200_000, 400_000, 199_999)
    assert got.where("total <> 2 * n").count() == 0


def test_split_hot_keeps_every_row(spark):
    df, data = _data(spark)
    cold, hot, n = scan.split_hot(df, ["k"], 100)
    assert cold.count() + hot.count() == len(data)
    assert {r[0] for r in hot.select("k").distinct().collect()} == {"hot"}
    assert n == hot.count()
    # NULL is a group of its own and stays with the small ones
    assert cold.where(F.col("k").isNull()).count() == sum(d[0] is None for d in data)


def test_shares_start_no_job_before_the_action(spark):
    sc = spark.sparkContext
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "k string, v double")
    sc.setJobGroup("plan", "building a plan")
    ranking.share(df, {"part": "v"})
    ranking.share(df, {"part": "v"}, ["k"])
    assert not sc.statusTracker().getJobIdsForGroup("plan")
    sc.setJobGroup("rest", "")


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
