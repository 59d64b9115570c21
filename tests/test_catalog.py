"""Catalog audits and metadata policy on small catalogs."""

import pytest
from pyspark.sql import functions as F

from opsight.operators import catalog, policy
from opsight.operators.scan import all_fit
from tests.conftest import rows

RECORD = "recname string, rectype int, sqltablename string, systemidfieldname string"


@pytest.fixture
def records(frame):
    return frame(RECORD, ("A", 0, " ", " "), ("V", 1, " ", " "), ("S", 3, " ", " "),
                 ("S2", 3, " ", " "), ("T", 7, " ", " "), ("OWN", 0, "MYTAB", "SYSID"))


def test_nested_subrecords_keep_their_place(frame, records):
    fields = frame("recname string, fieldname string, useedit int, fieldnum int",
                   ("A", "F1", 1, 1), ("A", "S", 0, 2), ("A", "F9", 0, 3),
                   ("S", "X", 2, 1), ("S", "S2", 0, 2), ("S2", "Y", 0, 1), ("S2", "Z", 4, 2))
    got = catalog.expand_subrecords(fields, records).where("recname = 'A'")
    assert rows(got, "fieldnum", "fieldname", "useedit", "subrecname") == [
        (1, "F1", 1, "A"), (2, "X", 2, "S"), (3, "Y", 0, "S2"), (4, "Z", 4, "S2"), (5, "F9", 0, "A")]


def test_circular_subrecords_are_an_error(frame, records):
    fields = frame("recname string, fieldname string, useedit int, fieldnum int",
                   ("S", "S2", 0, 1), ("S2", "S", 0, 1))
    with pytest.raises(ValueError, match="circle"):
        catalog.expand_subrecords(fields, records, max_depth=3)


def test_fields_are_computed_once_whatever_the_nesting(spark, frame, records):
    fields = frame("recname string, fieldname string, useedit int, fieldnum int",
                   ("A", "F1", 1, 1), ("A", "S", 0, 2), ("S", "X", 2, 1), ("S", "S2", 0, 2), ("S2", "Y", 0, 1))
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(name):
        read.add(1)
        return name

    derived = fields.withColumn("fieldname", seen.asNondeterministic()("fieldname"))
    got = rows(catalog.expand_subrecords(derived, records).where("recname = 'A'"), "fieldnum", "fieldname")
    assert got == [(1, "F1"), (2, "X"), (3, "Y")]
    assert read.value == fields.count()


@pytest.mark.parametrize("limit, certain", [(9, False), (10, True)])
def test_groups_fit_if_their_buckets_do(spark, limit, certain):
    df = spark.range(1000).selectExpr("if(id < 10, null, id) AS k")
    assert all_fit(df, ["k"], limit) is certain
    assert all_fit(df.where("false"), ["k"], 0)


TYPES = "fieldname string, fieldtype int, length int, decimalpos int, format int"


def test_long_columns_go_last(frame, records):
    types = frame(TYPES, ("L", 1, 0, 0, 0), ("I", 8, 0, 0, 0), ("C", 0, 9, 0, 0))
    fields = frame("recname string, fieldname string, useedit int, fieldnum int, subrecname string",
                   *[(r, f, 0, i + 1, r) for r in ("A", "V") for i, f in enumerate("LCID")])
    got = catalog.move_long_last(fields, types, records)
    order = {r: "".join(x[1] for x in rows(got.where(f"recname = '{r}'"), "fieldnum", "fieldname"))
             for r in ("A", "V")}
    assert order == {"A": "CDLI", "V": "LCID"}


def test_objects(frame, records):
    objects = frame("object_type string, object_name string", ("TABLE", "PS_A"), ("TABLE", "MYTAB"),
                    ("TABLE", "PS_T"), ("TABLE", "PS_T3"), ("TABLE", "PS_T12"), ("TABLE", "PS_TX"),
                    ("TABLE", "OTHER"))
    assert rows(catalog.missing_objects(records, objects)) == [("VIEW", "V", " ")]
    assert rows(catalog.undeclared_objects(records, objects), "object_name") == [
        ("OTHER",), ("PS_TX",)]
    excess = catalog.excess_temp_instances(
        records, objects, frame("recname string, temptblinstances int", ("T", 2)),
        frame("temptblinstances int", (3,)))
    assert rows(excess) == [("T", "PS_T12", 5)]


COLUMN = ("table_name string, column_name string, data_type string, data_length int,"
          " data_precision int, data_scale int, nullable string, column_id int")


def _mismatch(frame, records, toolsrel="8.44", unicode_on=0):
    types = frame(TYPES, ("C", 0, 10, 0, 0), ("N", 2, 5, 2, 0), ("SN", 3, 6, 2, 0),
                  ("SYSID", 2, 5, 0, 0), ("D", 4, 0, 0, 0), ("REF", 9, 0, 0, 0), ("L7", 1, 0, 0, 7),
                  ("REQ", 5, 0, 0, 0))
    names = ["C", "N", "SN", "SYSID", "D", "REF", "L7", "REQ"]
    fields = frame("recname string, fieldname string, useedit int, fieldnum int",
                   *[("OWN", n, 256 if n == "REQ" else 0, i) for i, n in enumerate(names)])
    columns = frame(COLUMN,
                    ("MYTAB", "C", "VARCHAR2", 30, None, None, "N", 1),
                    ("MYTAB", "N", "NUMBER", 22, 4, 2, "N", 2),
                    ("MYTAB", "SN", "NUMBER", 22, 5, 2, "N", 3),
                    ("MYTAB", "SYSID", "NUMBER", 22, 9, 0, "Y", 4),
                    ("MYTAB", "D", "VARCHAR2", 8, None, None, "Y", 5),
                    ("MYTAB", "REF", "VARCHAR2", 30, None, None, "Y", 6),
                    ("MYTAB", "L7", "LONG", 0, None, None, "Y", 7),
                    ("MYTAB", "REQ", "DATE", 7, None, None, "Y", 8))
    settings = frame("unicode_enabled int, toolsrel string", (unicode_on, toolsrel))
    out = catalog.definition_mismatch(records, fields, types, columns, settings)
    return {r.column_name: sorted(r.reasons) for r in out.collect()}


def test_definitions(frame, records):
    assert _mismatch(frame, records) == {
        "C": ["length"], "SN": ["signed number"], "D": ["date"], "L7": ["raw long"],
        "REQ": ["required but nullable"]}
    assert "C" not in _mismatch(frame, records, unicode_on=1)
    assert _mismatch(frame, records, "8.22")["SYSID"] == ["plain type but nullable"]


def test_alternate_index_beyond_nine_does_not_fit(frame):
    fields = frame("recname string, fieldname string, useedit int, fieldnum int, subrecname string",
                   *[("A", f"F{i:02d}", 16, i, "A") for i in range(12)], ("A", "K", 17, 20, "A"))
    got = catalog.alternate_indexes(fields)
    assert rows(got.where("fieldnum >= 9"), "fieldname", "indexid") == [
        ("F09", "9"), ("F10", "##"), ("F11", "##")]  # 17 has a lower bit set: not an alternate key


def test_key_positions_ranks_key_columns_once(frame):
    fields = frame("recname string, fieldname string, useedit int, fieldnum int, subrecname string",
                   ("A", "X", 16, 1, "A"), ("A", "K2", 1, 2, "A"), ("A", "K1", 1, 3, "A"), ("A", "P", 0, 4, "A"))
    indexes = frame("recname string, indexid string, platform_ora int, custkeyorder int",
                    ("A", "_", 1, 1), ("A", "0", 1, 0), ("A", "B", 1, 0))
    keys = frame("recname string, indexid string, fieldname string, keyposn int",
                 ("A", "_", "K1", 1), ("A", "_", "K2", 2), ("A", "B", "P", 1))
    got = catalog.key_positions(fields, indexes, keys, catalog.derive_index_definitions(fields, indexes))
    assert rows(got, "indexid", "keyposn", "fieldname") == [
        ("0", 1, "X"), ("0", 2, "K2"), ("0", 3, "K1"), ("B", 1, "P"), ("_", 1, "K1"), ("_", 2, "K2")]
    plan = got._jdf.queryExecution().optimizedPlan().collectLeaves().mkString("\n")
    assert sum("keyposn#" in leaf for leaf in plan.split("\n")) == 2  # ranked once, looked up once


def test_rebuild_list_skips_placeless_tables(frame, records):
    tables = frame("table_name string, tablespace_name string", ("PS_A", "TS"), ("PS_T", None))
    got = catalog.rebuild_list([frame("recname string", ("A",), ("A",), ("T",))],
                               [frame("recname string, indexid string", ("A", "_"))], records, tables)
    assert rows(got) == [(0, "A", " "), (1, "A", "_")]


def test_rebuild_list_runs_each_audit_by_itself(frame, records):
    """The plan that is left reads written offenders; it does not hold the plans of all audits."""
    audits = [frame("recname string", (n,), (n,)).join(frame("recname string", (n,)), "recname") for n in ("A", "S")]
    index_audits = [frame("recname string, indexid string", ("A", "_"), ("A", "_"), ("V", None))]
    tables = frame("table_name string, tablespace_name string", ("PS_T", None))
    got = catalog.rebuild_list(audits, index_audits, records, tables)
    assert rows(got) == [(0, "A", " "), (0, "S", " "), (0, "V", " "), (1, "A", "_")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 4  # each of the two outputs leaves out tables without a place


def test_definitions_of_key_positions_are_read_from_one_table(frame):
    fields = frame("recname string, fieldname string, useedit int, fieldnum int, subrecname string",
                   ("A", "X", 16, 1, "A"), ("A", "K", 1, 2, "A"))
    indexes = frame("recname string, indexid string, platform_ora int, custkeyorder int", ("A", "_", 1, 1), ("A", "0", 1, 0))
    keys = frame("recname string, indexid string, fieldname string, keyposn int", ("A", "_", "K", 1))
    got = catalog.key_positions(fields, indexes, keys, catalog.derive_index_definitions(fields, indexes))
    assert rows(got, "indexid", "keyposn", "fieldname") == [("0", 1, "X"), ("0", 2, "K"), ("_", 1, "K")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("rank(") <= 2  # not those of alternate keys


def test_index_positions_of_records_that_share_a_table(frame, records):
    """Duplicate records and columns count each, as before; null names match nothing."""
    positions = frame("recname string, indexid string, keyposn long, fieldname string",
                      ("A", "_", 1, "X"), ("A", "_", 1, "X"), ("OWN", "_", 2, "X"), (None, "_", 1, "X"), ("T", None, 1, "X"))
    actual = frame("table_name string, index_name string, column_name string, column_position long",
                   ("PS_A", "PS_A", "X", 2), ("PS_A", "PS_A", "X", 3), ("PS_A", "PS_OWN", "X", 9), ("MYTAB", "PS_OWN", "X", 2),
                   ("PS_T", None, "X", 5), (None, "PS_A", "X", 5))
    got = catalog.index_position_mismatch(records.union(records.where("recname = 'A'")), positions, actual)
    assert rows(got) == 4 * [("A", "_", "X", 1, 2)] + 4 * [("A", "_", "X", 1, 3)]


def test_placement(frame, records):
    got = catalog.placement_drift(
        records, frame("recname string, ddlspacename string", ("A", "OLD"), ("OWN", "TS")),
        frame("table_name string, tablespace_name string", ("PS_A", "NEW"), ("MYTAB", "TS")))
    assert rows(got) == [("A", "OLD", "PS_A", "NEW")]


def test_stale(frame):
    unit = "owner string, table_name string, partition_name string, subpartition_name string"
    units = frame(unit + ", num_rows int", ("o", "t", "p", "s", 100), ("o", "t", "p", None, None),
                  ("o", "t", None, None, 100), ("o", "u", None, None, 100), ("o", "v", None, None, 5),
                  ("o", "w", None, None, 5))
    mods = frame(unit + ", inserts int, updates int, deletes int, truncated string",
                 ("o", "t", "p", "s", 4, 3, 3, "NO"), ("o", "t", None, None, 9, 0, 0, "NO"),
                 ("o", "v", None, None, 0, 0, 0, "YES"), ("o", "w", None, None, 5, 0, 0, "NO"))
    locks = frame(unit + ", stattype_locked string", ("o", "w", None, None, "ALL"))
    got = policy.stale_partitions(units, mods, locks)
    assert rows(got, "table_name", "granularity") == [
        ("t", "PARTITION"), ("t", "SUBPARTITION"), ("v", "GLOBAL")]
    assert policy.stale_partitions(units, mods, locks, force=True).count() == 4


def test_stats_policy(frame, records):
    temp = frame(RECORD, ("PROF", 7, " ", " "), ("WRK", 7, " ", " "), ("LOCK", 0, "PSLOCK", " "),
                 ("BIG", 0, " ", " "), ("GTT", 7, " ", " "))
    tables = frame("owner string, table_name string, temporary string, partitioned string",
                   *[("o", t, "Y" if "GTT" in t else "N", "YES" if t == "PS_BIG" else "NO")
                     for t in ("PS_PROF", "PS_PROF6", "PS_PROF12", "PS_WRK", "PSLOCK", "PS_BIG",
                               "PS_GTT", "PS_GTT12", "LONER")])
    overrides = frame("recname string, gather_stats string, estimate_percent string,"
                      " block_sample string, method_opt string",
                      ("WRK", "N", " ", " ", "SIZE 1"), ("PROF", "G", "42", "Y", "SIZE 1"))
    asked = tables.selectExpr("owner", "table_name", "1 AS estpct").unionByName(
        frame("owner string, table_name string, estpct int", ("o", "NONE", 1)))
    got = {r.table_name: r for r in policy.stats_policy(
        asked, tables, catalog.with_base_table(temp), overrides).collect()}
    assert {t: r.decision for t, r in got.items()} == {
        "PS_PROF": "gather", "PS_PROF6": "gather", "PS_PROF12": "gather", "PS_WRK": "none",
        "PSLOCK": "refresh", "PS_BIG": "refresh", "PS_GTT": "none", "PS_GTT12": "gather",
        "LONER": "gather", "NONE": "error"}
    assert (got["PS_PROF12"].estimate_percent, got["PS_PROF12"].instance) == (42.0, "12")
    assert got["PS_PROF12"].block_sample and got["PSLOCK"].estimate_percent == 1.0


def _facts(frame, tables=(), indexes=(), expressions=(), triggers=(), constraints=(), logs=(),
           views=()):
    return policy.SchemaFacts(
        records=frame("recname string, rectype int, base_table string, instances int",
                      ("DMK", 0, "PS_DMK", 0), ("TMP", 7, "PS_TMP", 2)),
        declared_indexes=frame("recname string, indexid string", ("DMK", "_"), ("TMP", "_")),
        key_fields=frame("recname string, fieldname string, useedit int", ("DMK", "A", 1)),
        tables=frame("owner string, table_name string, temporary string, partitioned string,"
                     " cluster_name string, iot_type string", *(tables or (
                         ("o", "PS_DMK", "N", "NO", None, None),))),
        indexes=frame("owner string, index_name string, table_owner string, table_name string,"
                      " temporary string, partitioned string", *indexes),
        expressions=frame("index_owner string, index_name string, table_owner string,"
                          " table_name string", *expressions),
        triggers=frame("table_owner string, table_name string, trigger_name string", *triggers),
        constraints=frame("owner string, table_name string, constraint_type string,"
                          " index_name string", *constraints),
        mview_logs=frame("log_owner string, master string", *logs),
        mviews=frame("owner string, mview_name string", *views),
    )


def _index(name, table="PS_DMK", temp="N", part="NO"):
    return ("o", name, "o", table, temp, part)


DROP_T, DROP_I = ("DROP", "TABLE", "PS_DMK"), ("DROP", "INDEX")
CASES = [
    ({}, ("ALTER", "TABLE", "PSRECDEFN"), 20006),
    ({}, ("RENAME", "TABLE", "PSRECDEFN"), 20006),
    ({}, DROP_T, None),
    ({"indexes": [_index("PS_DMK")]}, (*DROP_I, "PS_DMK"), None),
    ({"indexes": [_index("PS1DMK")]}, (*DROP_I, "PS1DMK"), None),
    ({"indexes": [_index("WIBBLE")]}, (*DROP_I, "WIBBLE"), 20005),
    ({"indexes": [_index("PSZDMK")]}, (*DROP_I, "PSZDMK"), 20005),
    ({"indexes": [_index("PSZDMK")], "expressions": [("o", "PSZDMK", "o", "PS_DMK")]},
     (*DROP_I, "PSZDMK"), 20004),
    ({"indexes": [_index("PSZDMK")]}, DROP_T, 20011),
    ({"indexes": [_index("PS_DMK", part="YES")]}, (*DROP_I, "PS_DMK"), 20003),
    ({"indexes": [_index("PS_DMK", temp="Y")]}, (*DROP_I, "PS_DMK"), 20002),
    ({"indexes": [_index("PS_DMK")], "constraints": [("o", "PS_DMK", "P", "PS_DMK")]}, DROP_T, 20014),
    ({"logs": [("o", "PS_DMK")]}, DROP_T, 20015),
    ({"views": [("o", "PS_DMK")]}, DROP_T, 20016),
    ({"triggers": [("o", "PS_DMK", "MINE")]}, DROP_T, 20013),
    ({"triggers": [("o", "PS_DMK", "PSUDMK")]}, DROP_T, None),
    ({"tables": [("o", "PS_DMK", "N", "NO", None, "IOT")]}, DROP_T, 20010),
    ({"tables": [("o", "PS_DMK", "Y", "NO", None, None)]}, DROP_T, 20007),
    ({"tables": [("o", "PS_DMK", "N", "YES", None, None)]}, DROP_T, 20008),
    ({"tables": [("o", "PS_DMK", "N", "YES", None, None)]}, ("ALTER", "TABLE", "PS_DMK"), None),
    ({"tables": [("o", "PS_DMK", "N", "NO", "C", None)]}, DROP_T, 20009),
    ({"tables": [("o", "PS_DMK", "N", "NO", None, None), ("o", "GT_DMK", "Y", "NO", None, None)]},
     DROP_T, 20017),
    ({"tables": [("o", "GT_TMP2", "Y", "NO", None, None)], "indexes": [_index("PSXTMP2", "PS_TMP2")]},
     ("DROP", "TABLE", "PS_TMP2"), 20011),
    ({"tables": [("o", "GT_TMP9", "Y", "NO", None, None)]}, ("DROP", "TABLE", "PS_TMP9"), None),
]


def test_ddl_guard(frame):
    """All cases at once: every case has its own schema owner."""
    parts = {f: [] for f in ("tables", "indexes", "expressions", "triggers", "constraints", "logs",
                             "views")}
    events, want = [], {}
    for i, (facts, (event, kind, name), errno) in enumerate(CASES):
        owner = f"o{i}"
        for key, given in facts.items():
            parts[key] += [tuple(owner if x == "o" else x for x in row) for row in given]
        events.append((str(i), event, kind, owner, name, "ddl", False))
        want[str(i)] = errno
    permitted = ("x", "DROP", "INDEX", "o5", "WIBBLE", "ddl", True)
    swap = ("y", "RENAME", "TABLE", "o22", "PS_TMP2",
            "alter table PS_TMP2 rename to GT_TMP2X", False)
    want |= {"x": None, "y": None}
    df = frame("event_id string, sysevent string, obj_type string, obj_owner string,"
               " obj_name string, sql_text string, ddl_permitted boolean", *events, permitted, swap)
    got = policy.ddl_guard(df, _facts(frame, **parts))
    assert {r.event_id: r.errno for r in got.collect()} == want
    assert got.where("event_id = '5'").first().rule == "unmanaged index"


def test_reorder(frame):
    recs = frame("oprid string, qryname string, selnum int, rcdnum int, corrname string,"
                 " recname string", ("o", "q", 1, 1, "A", "X"), ("o", "q", 1, 2, "B", "Y"),
                 ("o", "q", 1, 3, "C", "Z"), ("o", "q", 1, 4, "D", "W"), ("o", "other", 1, 1, "A", "X"),
                 ("o", "bad", 1, 1, "A", "X"))
    fields = frame("oprid string, qryname string, selnum int, fldrcdnum int, recname string,"
                   " fieldname string", ("o", "q", 1, 1, "X", "F"), ("o", "q", 1, 3, "Z", "G"),
                   ("o", "q", 1, 0, " ", " "), ("o", "bad", 1, 1, "GONE", "F"))
    groups = frame("oprid string, qryname string", ("o", "q"), ("o", "bad"))
    sound = policy.drop_corrupt_groups(groups, recs, fields)
    assert rows(sound) == [("o", "q")]
    new_recs, new_fields = policy.reorder_members(sound, recs, fields, {"A": 3, "B": 2, "C": 1})
    assert rows(new_recs.where("qryname = 'q'"), "recname", "rcdnum", "corrname") == [
        ("W", None, "D"), ("X", 3, "C"), ("Y", 2, "B"), ("Z", 1, "A")]
    assert rows(new_recs.where("qryname != 'q'"), "rcdnum", "corrname") == [(1, "A"), (1, "A")]
    assert rows(new_fields.where("qryname = 'q'"), "recname", "fldrcdnum") == [
        (" ", 0), ("X", 3), ("Z", 1)]


def test_default_overrides(frame):
    have = frame("recname string, gather_stats string, estimate_percent string, block_sample string,"
                 " method_opt string", ("A", "G", "5", " ", "x"))
    members = frame("ae_applid string, recname string", ("TL_TIMEADMIN", "A"), ("TL_TIMEADMIN", "B"),
                    ("TL_TIMEADMIN", "B"), ("OTHER", "C"))
    got = policy.default_override_rows(have, members)
    assert rows(got, "recname", "gather_stats") == [("A", "G"), ("B", "N")]
