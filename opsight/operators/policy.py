"""Metadata policy: statistics (C15, C16, C20), DDL audit (C17), query rewriting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsight.functions.rules import has_flag, has_flag_unfloored
from opsight.operators.joins import numbered_instances, resolve_instance_name
from opsight.operators.scan import null_safe
from opsight.session import written


def stale_partitions(
    units: DataFrame, modifications: DataFrame, statistics: DataFrame, threshold_pct: float = 10,
    force: bool = False,
) -> DataFrame:
    """Subpartitions, partitions and tables whose statistics are stale.

    units: (owner, table_name, partition_name, subpartition_name, num_rows)
    with NULL names at the upper levels; modifications add inserts, updates,
    deletes, truncated; statistics add stattype_locked. A unit is stale when its
    row count is unknown, its changes reach the threshold or it was truncated;
    without a modification row only the first can hold. Locked units are skipped
    unless forced. All three levels go through one pair of joins, since the
    NULLs of upper levels match NULLs.
    """
    names = ["owner", "table_name", "partition_name", "subpartition_name"]
    changes = modifications.select(
        *[F.col(c).alias(f"_m_{c}") for c in names],
        (F.col("inserts") + F.col("updates") + F.col("deletes")).alias("_changed"), "truncated",
    )
    locks = statistics.select(*[F.col(c).alias(f"_s_{c}") for c in names], "stattype_locked")
    joined = units.join(
        changes, null_safe(units, changes, [(c, f"_m_{c}") for c in names]), "left"
    )
    joined = joined.join(
        locks, null_safe(joined, locks, [(c, f"_s_{c}") for c in names]), "left"
    )
    stale = (
        F.col("num_rows").isNull()
        | (F.col("num_rows") * F.lit(threshold_pct) / 100 <= F.col("_changed"))
        | (F.col("truncated") == "YES")
    )
    granularity = F.when(F.col("subpartition_name").isNotNull(), "SUBPARTITION").when(
        F.col("partition_name").isNotNull(), "PARTITION"
    ).otherwise("GLOBAL")
    allowed = F.lit(force) | F.col("stattype_locked").isNull()
    return joined.where(stale & allowed).select(*names, granularity.alias("granularity"))


def stats_policy(
    requests: DataFrame, tables: DataFrame, records: DataFrame, overrides: DataFrame,
    default_method: str = "FOR ALL COLUMNS SIZE AUTO",
) -> DataFrame:
    """What to do about the statistics of each requested table: error,
    none, refresh (stale parts only) or gather. A plan, nothing is run.

    requests: (owner, table_name, estpct); tables: (owner, table_name,
    temporary, partitioned); records with base_table. An override decides
    first, then the record type: tables refresh, temporary records gather;
    without a record neither applies and the table is gathered.
    """
    known = tables.select(
        F.col("owner").alias("_o"), F.col("table_name").alias("_t"), "temporary",
        F.substring("partitioned", 1, 1).alias("_part"), F.lit(True).alias("_exists"),
    )
    found = requests.join(
        known, (F.col("owner") == F.col("_o")) & (F.col("table_name") == F.col("_t")), "left"
    ).drop("_o", "_t")
    found = resolve_instance_name(found, records)
    ovr = overrides.select(
        F.col("recname").alias("_rec"), F.col("gather_stats").alias("_gather"),
        *[F.nullif(F.rtrim(F.col(c)), F.lit("")).alias(f"_{c}")
          for c in ("estimate_percent", "method_opt", "block_sample")],
    )
    found = found.join(ovr, F.col("recname") == F.col("_rec"), "left")
    has_override = F.col("_rec").isNotNull()
    wanted = F.when(has_override, F.col("_gather")).when(F.col("rectype") == 0, "R").when(
        F.col("rectype") == 7, "G"
    )
    shared = (F.col("temporary") == "Y") & F.col("instance").isNull()
    decided = found.withColumn("_wanted", wanted).withColumn(
        "decision",
        F.when(F.col("_exists").isNull(), "error")
        .when(F.col("_wanted") == "N", "none")
        .when((F.col("_wanted") != "N") & shared, "none")
        .when((F.col("_part") == "Y") | (F.col("_wanted") == "R"), "refresh")
        .otherwise("gather"),
    )
    reason = (
        F.when(F.col("decision") == "error", "table does not exist")
        .when(F.col("_wanted") == "N", "override says no")
        .when(F.col("decision") == "none", "shared temporary table")
        .when(F.col("_part") == "Y", "partitioned")
        .when(has_override, "override").when(F.col("rectype") == 0, "table")
        .when(F.col("rectype") == 7, "temporary record").otherwise("unknown record")
    )
    acts = F.col("decision").isin("refresh", "gather")
    return decided.select(
        "owner", "table_name", "recname", "instance", "decision", reason.alias("reason"),
        F.when(acts, F.coalesce(F.col("_estimate_percent").try_cast("double"),
                                F.col("estpct").cast("double"))).alias("estimate_percent"),
        F.when(acts, F.when(has_override, F.col("_method_opt")).otherwise(default_method)).alias(
            "method_opt"),
        F.when(acts, F.coalesce(F.col("_block_sample") == "Y", F.lit(False))).alias(
            "block_sample"),
    )


def default_override_rows(
    overrides: DataFrame, members: DataFrame, application: str = "TL_TIMEADMIN"
) -> DataFrame:
    """C20: overrides with an 'N' row for each member of an application that has
    none yet."""
    fresh = members.where(F.col("ae_applid") == application).select("recname").distinct().join(
        overrides.select("recname"), "recname", "left_anti"
    ).select("recname", F.lit("N").alias("gather_stats"), F.lit(" ").alias("estimate_percent"),
             F.lit(" ").alias("block_sample"), F.lit(None).cast("string").alias("method_opt"))
    return overrides.select(*fresh.columns).unionByName(fresh)


@dataclass(frozen=True)
class SchemaFacts:
    """The catalog the DDL audit looks at.

    records: recname, rectype, base_table, instances (own plus global number)
    declared_indexes: recname, indexid
    key_fields: recname, fieldname, useedit
    tables: owner, table_name, temporary, partitioned, cluster_name, iot_type
    indexes: owner, index_name, table_owner, table_name, temporary, partitioned
    expressions: index_owner, index_name, table_owner, table_name
    triggers: table_owner, table_name, trigger_name
    constraints: owner, table_name, constraint_type, index_name
    mview_logs: log_owner, master;  mviews: owner, mview_name
    """

    records: DataFrame
    declared_indexes: DataFrame
    key_fields: DataFrame
    tables: DataFrame
    indexes: DataFrame
    expressions: DataFrame
    triggers: DataFrame
    constraints: DataFrame
    mview_logs: DataFrame
    mviews: DataFrame


MANAGED_CHARS = tuple("_0123456789")  # third character of generated index names: fixed values
PROTECTED_TABLES = ("PSRECDEFN",)  # fixed value


def _tables_with_record(facts: SchemaFacts) -> DataFrame:
    """(table, recname, rectype, suffix) of base tables and numbered instances."""
    base = facts.records.where(F.col("rectype").isin(0, 7)).select(
        F.col("base_table").alias("_table"), "recname", "rectype", F.lit("").alias("_suffix"),
        F.lit(0).alias("_pass"),
    )
    numbered = numbered_instances(facts.records.where(F.col("rectype") == 7)).select(F.col("table_name").alias("_table"), "recname", "rectype",
             F.col("instance").cast("string").alias("_suffix"), F.lit(1).alias("_pass"))
    # a name found directly is not searched among instances
    both = base.unionByName(numbered)
    return both.groupBy("_table").agg(
        F.min_by(F.struct("recname", "rectype", "_suffix", "_pass"),
                 F.struct("_pass", "recname")).alias("_r")
    ).select("_table", "_r.*")


def _with_declared(df: DataFrame, declared: DataFrame, name: str, flag: str) -> DataFrame:
    """flag: the name is 'PS' + id + record + suffix of a declared index."""
    d = declared.select(
        F.col("recname").alias("_dr"), F.col("indexid").alias("_di")
    ).distinct()
    out = df.join(
        d, (F.col("recname") == F.col("_dr")) & (F.substr(F.col(name), F.lit(3), F.lit(1))
                                                  == F.col("_di")), "left"
    )
    same = F.concat(F.lit("PS"), F.col("_di"), F.col("recname"), F.col("_suffix")) == F.col(name)
    return out.withColumn(flag, F.coalesce(same, F.lit(False))).drop("_dr", "_di")


def _flag(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return df.select(*keys).distinct().withColumn(name, F.lit(True))


def _shadows(facts: SchemaFacts) -> DataFrame:
    temporary = facts.tables.where(F.col("temporary") == "Y").select(
        F.col("owner").alias("_so"), F.col("table_name").alias("_sn")
    )
    return _flag(temporary, ["_so", "_sn"], "_shadow")


def _index_events(events: DataFrame, facts: SchemaFacts, owned: DataFrame) -> DataFrame:
    idx = facts.indexes.select(
        F.col("owner").alias("_io"), F.col("index_name").alias("_in"),
        F.col("table_owner").alias("_to"), F.col("table_name").alias("_tn"),
        F.col("temporary").alias("_temp"), F.col("partitioned").alias("_part"),
    )
    rows = events.where(F.col("obj_type") == "INDEX").join(
        idx, (F.col("obj_owner") == F.col("_io")) & (F.col("obj_name") == F.col("_in"))
    ).join(owned, F.col("_tn") == F.col("_table"))
    rows = _with_declared(rows, facts.declared_indexes, "obj_name", "_declared")
    expr = facts.expressions.select(
        F.col("index_owner").alias("_eo"), F.col("index_name").alias("_en"),
        F.col("table_owner").alias("_eto"), F.col("table_name").alias("_et"),
    ).distinct().withColumn("_has_expr", F.lit(True))
    rows = rows.join(
        expr, (F.col("_eo") == F.col("obj_owner")) & (F.col("_en") == F.col("obj_name"))
        & (F.col("_eto") == F.col("_to")) & (F.col("_et") == F.col("_tn")), "left"
    )
    rows = rows.join(
        _shadows(facts), (F.col("_so") == F.col("_to"))
        & (F.col("_sn") == F.concat(F.lit("GT"), F.substr(F.col("_tn"), F.lit(3)))), "left"
    )
    managed = F.substr(F.col("obj_name"), F.lit(3), F.lit(1)).isin(list(MANAGED_CHARS)) & F.expr(
        "obj_name LIKE concat('PS_', recname)"
    )
    tested = ~managed
    return rows.withColumn(
        "errno",
        F.when(F.col("_temp") == "Y", 20002)
        .when(F.col("_part") == "YES", 20003)
        .when(tested & ~F.col("_declared") & F.col("_has_expr"), 20004)
        .when(tested & ~F.col("_declared"), 20005)
        .when(tested & F.col("_shadow"), 20018),
    ).select("event_id", "errno")


def _table_facts(facts: SchemaFacts, owned: DataFrame) -> DataFrame:
    """One row of flags per owner and table with a record."""
    indexes = facts.indexes.select(
        F.col("table_owner").alias("_o"), F.col("table_name").alias("_t"),
        F.col("owner").alias("_io"), F.col("index_name").alias("_in"),
    ).join(owned, F.col("_t") == F.col("_table"))
    indexes = _with_declared(indexes, facts.declared_indexes, "_in", "_declared")
    indexes = _with_declared(indexes, facts.declared_indexes, "_t", "_declared_as_table")
    expr = facts.expressions.select(
        F.col("index_owner").alias("_eo"), F.col("index_name").alias("_en"),
        F.col("table_owner").alias("_eto"), F.col("table_name").alias("_et"),
    ).distinct().withColumn("_has_expr", F.lit(True))
    indexes = indexes.join(
        expr, (F.col("_eo") == F.col("_io")) & (F.col("_en") == F.col("_in"))
        & (F.col("_eto") == F.col("_o")) & (F.col("_et") == F.col("_t")), "left"
    )
    third = F.substr(F.col("_in"), F.lit(3), F.lit(1)).isin(list(MANAGED_CHARS))
    on_base = third & F.expr("_t LIKE concat('PS_', recname)")
    on_instance = third & F.expr("_t LIKE concat('PS_', recname, _suffix)")
    index_flags = indexes.groupBy("_o", "_t").agg(
        F.max(~on_base & ~F.col("_declared")).alias("_unmanaged"),
        F.max(~on_instance & ~F.col("_declared_as_table")
              & F.coalesce("_has_expr", F.lit(False)) & (F.col("_io") == F.col("_o"))
              ).alias("_function"),
    )
    triggers = facts.triggers.select(
        F.col("table_owner").alias("_o"), F.col("table_name").alias("_t"), "trigger_name"
    ).join(owned, F.col("_t") == F.col("_table")).where(
        F.col("trigger_name") != F.concat(F.lit("PSU"), F.col("recname"))
    )
    unique_key = facts.key_fields.groupBy(F.col("recname").alias("_kr")).agg(
        F.max(has_flag("useedit", 1)).alias("_uk"),
        F.max(has_flag_unfloored("useedit", 2)).alias("_dk"),
    )
    primary = facts.constraints.where(F.col("constraint_type") == "P").select(
        F.col("owner").alias("_o"), F.col("table_name").alias("_t"),
        F.col("index_name").alias("_in"),
    ).join(owned, F.col("_t") == F.col("_table")).join(
        unique_key, F.col("recname") == F.col("_kr")
    ).where(
        (F.col("_in") == F.concat(F.lit("PS_"), F.col("recname"), F.col("_suffix")))
        & F.col("_uk") & ~F.col("_dk")
    )
    out = index_flags
    for part, name in (
        (triggers, "_trigger"), (primary, "_primary"),
        (facts.mview_logs.select(F.col("log_owner").alias("_o"), F.col("master").alias("_t")),
         "_mview_log"),
        (facts.mviews.select(F.col("owner").alias("_o"), F.col("mview_name").alias("_t")), "_mview"),
    ):
        out = out.join(_flag(part, ["_o", "_t"], name), ["_o", "_t"], "full")
    return out


def _table_events(events: DataFrame, facts: SchemaFacts, owned: DataFrame, protected) -> DataFrame:
    sql = F.upper(F.col("sql_text"))
    is_protected = F.upper(F.col("obj_name")).isin([p.upper() for p in protected]) & F.col(
        "sysevent"
    ).isin("ALTER", "DROP", "RENAME")
    removes = F.col("sysevent").isin("DROP", "RENAME") | F.coalesce(
        sql.like("%ALTER%TABLE%RENAME%"), F.lit(False)
    )
    rows = events.where(F.col("obj_type") == "TABLE").join(
        owned, F.col("obj_name") == F.col("_table"), "left"
    )
    swap = F.expr(
        "upper(sql_text) LIKE upper(concat('ALTER%TABLE%PS_', recname, _suffix,"
        " '%RENAME%TO%GT_', recname, _suffix, '_'))"
        " OR upper(sql_text) LIKE upper(concat('ALTER%TABLE%PS_', recname, _suffix,"
        " '%RENAME%TO%XX_', recname, _suffix, '_'))"
    )
    exempt = (F.col("_pass") == 1) & (F.col("rectype") == 7) & F.coalesce(swap, F.lit(False))
    tested = removes & F.col("recname").isNotNull() & ~F.coalesce(exempt, F.lit(False))
    kinds = facts.tables.select(
        F.col("owner").alias("_ko"), F.col("table_name").alias("_kt"), "temporary", "partitioned",
        "cluster_name", "iot_type",
    )
    flags = _table_facts(facts, owned)
    rows = rows.join(
        kinds, (F.col("obj_owner") == F.col("_ko")) & (F.col("obj_name") == F.col("_kt")), "left"
    ).join(flags, (F.col("obj_owner") == F.col("_o")) & (F.col("obj_name") == F.col("_t")), "left")
    rows = rows.join(
        _shadows(facts), (F.col("obj_owner") == F.col("_so"))
        & (F.col("_sn") == F.concat(F.lit("GT"), F.substr(F.col("obj_name"), F.lit(3)))), "left"
    )
    return rows.withColumn(
        "errno",
        F.when(is_protected, 20006)
        .when(~tested, None)
        .when(F.col("temporary") == "Y", 20007)
        .when(F.col("partitioned") == "YES", 20008)
        .when(F.col("cluster_name").isNotNull(), 20009)
        .when(F.col("iot_type") == "IOT", 20010)
        .when(F.col("_unmanaged"), 20011)
        .when(F.col("_function"), 20012)
        .when(F.col("_trigger"), 20013)
        .when(F.col("_primary"), 20014)
        .when(F.col("_mview_log"), 20015)
        .when(F.col("_mview"), 20016)
        .when(F.col("_shadow"), 20017),
    ).select("event_id", "errno")


RULE_TEXTS: Mapping[int, str] = {  # fixed values
    20002: "global temporary index", 20003: "partitioned index", 20004: "function based index",
    20005: "unmanaged index", 20006: "protected table", 20007: "global temporary table",
    20008: "partitioned table", 20009: "clustered table", 20010: "index organised table",
    20011: "table with unmanaged index", 20012: "table with function based index",
    20013: "table with trigger", 20014: "table with primary key",
    20015: "table with materialized view log", 20016: "materialized view",
    20017: "table with shadow temporary table", 20018: "index with shadow temporary table",
}


def ddl_guard(
    events: DataFrame, facts: SchemaFacts, protected: Sequence[str] = PROTECTED_TABLES
) -> DataFrame:
    """C17: for each DROP, ALTER or RENAME the first rule it breaks, or NULL.

    events: event_id, sysevent, obj_type, obj_owner, obj_name, sql_text,
    ddl_permitted. Facts are reduced to one row of flags per table before they
    meet the events, so the audit is a few equi-joins whatever the number of
    events. Permitted statements are not tested.
    """
    owned = _tables_with_record(facts)
    tested = events.where(~F.col("ddl_permitted") & F.col("sysevent").isin(
        "DROP", "ALTER", "RENAME"))
    verdicts = _index_events(tested, facts, owned).unionByName(
        _table_events(tested, facts, owned, protected)
    ).where(F.col("errno").isNotNull())
    rule = None
    for code, text in RULE_TEXTS.items():
        hit = F.col("errno") == code
        rule = F.when(hit, text) if rule is None else rule.when(hit, text)
    return events.join(verdicts, "event_id", "left").withColumn("rule", rule)


def drop_corrupt_groups(groups: DataFrame, records: DataFrame, fields: DataFrame) -> DataFrame:
    """Queries whose fields all belong to one of their records; a field
    with blank record and name is ignored. The groups are written first, so that
    few of them meet the rows without a shuffle of these."""
    key = ["oprid", "qryname"]
    groups = written(groups, "query-groups")
    used = fields.where((F.col("recname") != " ") | (F.col("fieldname") != " "))
    corrupt = used.join(groups, key, "left_semi").join(
        records.join(groups, key, "left_semi").select(*key, "recname"), [*key, "recname"],
        "left_anti"
    ).select(*key)
    return groups.join(corrupt, key, "left_anti")


def reorder_members(
    groups: DataFrame, records: DataFrame, fields: DataFrame, positions: Mapping[str, int]
) -> tuple[DataFrame, DataFrame]:
    """New versions of query records and fields with records in another order.

    positions maps an alias to its new place; other aliases get NULL. Aliases
    are handed out anew by rank over (selection, place): A to L, then NULL. A
    query has few records, so a window per query is a small group. The groups and
    their new order are written first: few of them meet the rows without a shuffle.
    """
    key = ["oprid", "qryname"]
    groups = written(groups, "query-groups")
    place = None
    for alias, number in positions.items():
        hit = F.col("corrname") == alias
        place = F.when(hit, number) if place is None else place.when(hit, number)
    chosen = records.join(groups, key, "left_semi").select(
        *key, "selnum", "recname", F.col("rcdnum").alias("_old"), place.alias("_new")
    )
    w = Window.partitionBy(*key).orderBy("selnum", F.col("_new").asc_nulls_last())
    rank = F.rank().over(w)
    ranked = chosen.withColumn("_rank", rank).withColumn(
        "_alias", F.when(F.col("_rank") <= 12, F.char(F.lit(64) + F.col("_rank")))
    ).withColumn("_hit", F.lit(True)).drop("_rank")
    ranked = written(ranked, "query-order")
    on = [*key, "selnum", "recname"]

    def renumber(rows: DataFrame, number: str) -> DataFrame:
        mapped = ranked.withColumnRenamed("_old", number)
        in_group = rows.join(groups.select(*key).distinct().withColumn("_in", F.lit(True)),
                             key, "left")
        return in_group.join(mapped, [*on, number], "left").withColumn(
            "_change", F.coalesce("_in", F.lit(False)) & (F.col("recname") != " ")
        )

    new_records = renumber(records, "rcdnum")
    new_records = new_records.withColumn(
        "rcdnum", F.when(F.col("_change"), F.col("_new")).otherwise(F.col("rcdnum"))
    ).withColumn(
        "corrname", F.when(F.col("_change"), F.col("_alias")).otherwise(F.col("corrname"))
    ).select(*records.columns)
    new_fields = renumber(fields, "fldrcdnum")
    new_fields = new_fields.withColumn(
        "fldrcdnum", F.when(F.col("_change"), F.col("_new")).otherwise(F.col("fldrcdnum"))
    ).select(*fields.columns)
    return new_records, new_fields
