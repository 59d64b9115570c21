"""The registered queries: contract, and a sample of them against their SQL."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import compare
from registry import ORACLE, QUERIES, events, fixtures
from registry.fixtures import SOURCES

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = ("top_statements", "service_time_cdf", "counter_delta", "concurrency", "key_positions",
          "ingest_w3c_access_log", "chunk_text", "stream_pair_snapshots")


def test_contract():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100
    assert set(QUERIES) == set(ORACLE) <= set(queries)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "stmtrank" and df.count() >= 20


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in SOURCES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_sql(spark, con, name):
    assert compare(spark, con, name, SF_DIR).startswith("ok")


def test_rebuild_list_has_the_offenders_of_every_audit(spark, con):
    name = "rebuild_list_of_all_audits"
    assert compare(spark, con, name, SF_DIR).startswith("ok")
    found = con.execute(ORACLE[name]).fetchall()
    assert len(found) == len(set(found))
    few = set(con.execute(ORACLE["rebuild_list"]).fetchall())
    assert few < set(found)
    assert {r[0] for r in set(found) - few} == {0, 1}  # records and indexes that offend only in the other six


def test_all_audits_read_columns_and_positions_once_made(spark, monkeypatch):
    """Five audits read the actual columns and two the key positions: both come as written tables."""
    from opsight.operators import catalog

    seen, audits = [], ("column_position_mismatch", "index_position_mismatch", "index_count_mismatch")
    for name in audits:
        real = getattr(catalog, name)
        monkeypatch.setattr(catalog, name, lambda *a, real=real: (seen.append(a[3] if len(a) == 4 else a[1]), real(*a))[1])
    entry.queries()["rebuild_list_of_all_audits"](spark, SF_DIR)
    assert len(seen) == 3
    for df in seen:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Join" not in plan


def test_a_missing_library_leaves_the_other_queries(tmp_path):
    """Hide a library of the optional subpackage: the core queries are still there."""
    (tmp_path / "zstandard.py").write_text("raise ImportError('hidden', name='zstandard')\n")
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op1') for n in e.queries()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "PYTHONPATH": f"{tmp_path}{os.pathsep}{root}"}
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=env, check=True)
    found, _ = out.stdout.split()
    assert int(found) >= len(QUERIES)


def test_buckets_of_a_stream_grow_with_its_rows(spark):
    assert [events._buckets(spark.range(n)) for n in (0, 100, 2_000_001, 20_000_000)] == [8, 8, 9, 80]


def test_query_rows_are_derived_once(spark, frame, tmp_path):
    """reordered_fields reads the joined rows from one written table, not from lineitem for each use."""
    kinds = {1: "ECONOMY", 2: "LARGE", 3: "PROMO", 4: "SMALL"}
    frame("p_partkey long, p_type string", *kinds.items()).write.parquet(f"{tmp_path}/part.parquet")
    frame("o_orderkey long, o_custkey long", (7, 1), (8, 1)).write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(o, p, 1, p, 1.0, "N") for o, few in ((7, (1, 2, 3, 4)), (8, (1, 2))) for p in few]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_returnflag string"
    frame(schema, *lines).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["reordered_fields"](spark, str(tmp_path))
    found = {(r["qryname"], r["fieldname"]): r["fldrcdnum"] for r in got.collect()}
    assert found == {("Q7", "FA"): 3, ("Q7", "FB"): 2, ("Q7", "FC"): 1, ("Q7", "FD"): None, ("Q8", "FA"): 1, ("Q8", "FB"): 2}
    assert not any("lineitem" in f for f in got.inputFiles())


def test_steps_to_one_written_table_are_not_written(spark, monkeypatch):
    """ddl_guard writes what it reads more than once; the pairs, keys and index columns are steps to that."""
    made, write = [], fixtures.written
    monkeypatch.setattr(fixtures, "written", lambda d, name: made.append(name) or write(d, name))
    QUERIES["ddl_guard"](spark, SF_DIR)
    assert sorted(made) == ["cat_fields", "cat_objects", "cat_table_indexes"]
