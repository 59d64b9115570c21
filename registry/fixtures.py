"""Input tables of the operators, derived from the star-schema tables by Spark.

The SQL is plain enough to run elsewhere: `{table}` stands for a source table.
Attributes follow from column values, so every derived table grows with its
source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opsight.session import configure, written

SOURCES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "pages", "benchmark", "labels", "conversations",
)

# name -> SQL; later entries may use earlier ones
DERIVED = {
    # declared catalog: parts are records, suppliers fields, lineitem pairs their use
    "cat_records": """
        SELECT concat('R', cast(p_partkey AS varchar(20))) AS recname,
               CASE WHEN p_size <= 30 THEN 0 WHEN p_size <= 34 THEN 1 WHEN p_size <= 36 THEN 6
                    WHEN p_size <= 42 THEN 3 ELSE 7 END AS rectype,
               CASE WHEN p_brand = 'Brand#7' THEN concat('T_', cast(p_partkey AS varchar(20)))
                    ELSE ' ' END AS sqltablename,
               CASE WHEN p_brand = 'Brand#3' THEN 'F5' ELSE ' ' END AS systemidfieldname,
               p_brand AS brand, p_type AS kind, p_size AS size, p_partkey AS pkey
        FROM {part}""",
    "cat_pairs": """
        SELECT l_partkey, l_suppkey, min(l_quantity) AS q, max(l_tax) AS tax,
               max(l_discount) AS disc, min(l_returnflag) AS flag, max(l_linestatus) AS status,
               count(*) AS uses
        FROM {lineitem} GROUP BY l_partkey, l_suppkey""",
    "cat_fields": """
        SELECT concat('R', cast(l_partkey AS varchar(20))) AS recname,
               concat('F', cast(l_suppkey AS varchar(20))) AS fieldname,
               CASE WHEN q <= 10 THEN 1 WHEN q <= 15 THEN 2 WHEN q <= 22 THEN 16
                    WHEN q <= 30 THEN 256 WHEN q <= 32 THEN 257 ELSE 0 END AS useedit,
               cast(row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS bigint)
                   AS fieldnum,
               concat('R', cast(l_partkey AS varchar(20))) AS subrecname
        FROM {cat_pairs}""",
    "cat_field_types": """
        SELECT concat('F', cast(s_suppkey AS varchar(20))) AS fieldname,
               CASE WHEN s_nationkey <= 6 THEN 0 WHEN s_nationkey <= 8 THEN 1
                    WHEN s_nationkey <= 13 THEN 2 WHEN s_nationkey <= 16 THEN 3
                    WHEN s_nationkey <= 18 THEN 4 WHEN s_nationkey <= 20 THEN 6
                    WHEN s_nationkey <= 22 THEN 8 ELSE 9 END AS fieldtype,
               CASE WHEN s_acctbal < 0 THEN 0 WHEN s_acctbal < 1500 THEN 10
                    WHEN s_acctbal < 6000 THEN 18 ELSE 2500 END AS length,
               CASE WHEN s_acctbal < 3000 THEN 0 ELSE 2 END AS decimalpos,
               CASE WHEN s_acctbal < 8000 THEN 0 ELSE 7 END AS format
        FROM {supplier} WHERE s_nationkey <> 24""",
    "cat_named": """
        SELECT recname, rectype, brand, kind, size, sqltablename,
               CASE WHEN sqltablename = ' ' THEN concat('PS_', recname) ELSE sqltablename END
                   AS table_name
        FROM {cat_records}""",
    "cat_objects": """
        SELECT CASE WHEN rectype IN (1, 6) THEN 'VIEW' ELSE 'TABLE' END AS object_type,
               table_name AS object_name
        FROM {cat_named} WHERE rectype <> 3 AND brand <> 'Brand#11'
        UNION
        SELECT 'TABLE', concat(table_name, '_OLD') FROM {cat_named} WHERE brand = 'Brand#2'
        UNION
        SELECT 'TABLE', concat(table_name, '2') FROM {cat_named}
        WHERE rectype = 7 AND kind = 'ECONOMY'
        UNION
        SELECT 'TABLE', concat(table_name, '14') FROM {cat_named}
        WHERE rectype = 7 AND kind = 'SMALL'
        UNION
        SELECT 'TABLE', concat(table_name, '9') FROM {cat_named}
        WHERE rectype = 7 AND kind = 'LARGE'""",
    "cat_columns": """
        SELECT n.table_name, concat('F', cast(p.l_suppkey AS varchar(20))) AS column_name,
               CASE WHEN s.s_nationkey <= 8 THEN 'VARCHAR2' WHEN s.s_nationkey <= 16 THEN 'NUMBER'
                    WHEN s.s_nationkey <= 20 THEN 'DATE' WHEN s.s_nationkey <= 22 THEN 'LONG RAW'
                    ELSE 'VARCHAR2' END AS data_type,
               CASE WHEN p.tax >= 0.07 THEN 30 WHEN s.s_acctbal < 1500 THEN 10
                    WHEN s.s_acctbal < 6000 THEN 18 ELSE 2500 END AS data_length,
               CASE WHEN s.s_acctbal < 1500 THEN 9 WHEN s.s_acctbal < 6000 THEN 17
                    ELSE 38 END AS data_precision,
               CASE WHEN s.s_acctbal < 3000 THEN 0 ELSE 2 END AS data_scale,
               CASE WHEN p.flag = 'R' THEN 'Y' ELSE 'N' END AS nullable,
               cast(row_number() OVER (PARTITION BY n.table_name
                   ORDER BY CASE WHEN n.kind = 'STANDARD' THEN 0 - p.l_suppkey
                                 ELSE p.l_suppkey END) AS bigint) AS column_id
        FROM {cat_pairs} p
        JOIN {cat_named} n ON n.recname = concat('R', cast(p.l_partkey AS varchar(20)))
        JOIN {supplier} s ON s.s_suppkey = p.l_suppkey
        WHERE p.disc > 0.01 AND n.rectype <> 3 AND n.brand <> 'Brand#11'
        UNION ALL
        SELECT table_name, 'FX', 'VARCHAR2', 10, 9, 0, 'N', cast(99999 AS bigint)
        FROM {cat_named} WHERE brand = 'Brand#12' AND rectype <> 3""",
    "cat_settings": """
        SELECT CASE WHEN count(*) > 0 THEN 0 ELSE 1 END AS unicode_enabled, '8.44' AS toolsrel,
               min(s_nationkey) + 3 AS temptblinstances
        FROM {supplier}""",
    "cat_instances": """
        SELECT recname, CASE WHEN size <= 46 THEN 6 ELSE 0 END AS temptblinstances
        FROM {cat_records} WHERE rectype = 7 AND brand <> 'Brand#5'""",
    "cat_raw_fields": """
        SELECT recname, fieldname, useedit, fieldnum * 10 AS fieldnum FROM {cat_fields}
        UNION ALL
        SELECT a.recname, b.recname, 0, cast(CASE WHEN a.kind = 'PROMO' THEN 5 ELSE 15 END AS bigint)
        FROM {cat_records} a JOIN {cat_records} b ON b.pkey = a.pkey + 1 WHERE b.rectype = 3""",
    "cat_indexes": """
        SELECT recname, '_' AS indexid, CASE WHEN brand = 'Brand#9' THEN 0 ELSE 1 END AS platform_ora,
               CASE WHEN size <= 20 THEN 1 ELSE 0 END AS custkeyorder FROM {cat_records}
        UNION ALL
        SELECT recname, 'A', 1, CASE WHEN size <= 10 THEN 1 ELSE 0 END FROM {cat_records}
        WHERE kind = 'ECONOMY'
        UNION ALL
        SELECT recname, '0', 1, 0 FROM {cat_records} WHERE kind IN ('LARGE', 'PROMO')
        UNION ALL
        SELECT recname, '1', 1, 0 FROM {cat_records} WHERE kind = 'LARGE'""",
    "cat_keys": """
        SELECT recname, '_' AS indexid, fieldname,
               cast(row_number() OVER (PARTITION BY recname ORDER BY fieldname DESC) AS bigint)
                   AS keyposn
        FROM {cat_fields} WHERE useedit IN (1, 2, 257)
        UNION ALL
        SELECT recname, 'A', fieldname,
               cast(row_number() OVER (PARTITION BY recname ORDER BY useedit, fieldname) AS bigint)
        FROM {cat_fields} WHERE useedit IN (0, 256)""",
    "cat_ind_columns": """
        SELECT n.table_name, concat('PS', k.indexid, k.recname) AS index_name,
               k.fieldname AS column_name,
               CASE WHEN n.brand = 'Brand#4' THEN k.keyposn + 1 ELSE k.keyposn END
                   AS column_position
        FROM {cat_keys} k JOIN {cat_named} n ON n.recname = k.recname
        WHERE NOT (n.brand = 'Brand#6' AND k.keyposn = 1)
          AND (k.indexid = '_' OR n.kind = 'ECONOMY' OR n.brand = 'Brand#25')""",
    "cat_tables": """
        SELECT 'SYSADM' AS owner, object_name AS table_name,
               CASE WHEN n.kind = 'SMALL' AND n.size >= 40 THEN 'Y' ELSE 'N' END AS temporary,
               CASE WHEN n.brand = 'Brand#8' THEN 'YES' ELSE 'NO' END AS partitioned,
               CASE WHEN n.brand = 'Brand#10' AND n.size <= 25 THEN 'CLU' END AS cluster_name,
               CASE WHEN n.brand = 'Brand#13' AND n.size <= 25 THEN 'IOT' END AS iot_type,
               CASE WHEN n.brand = 'Brand#8' THEN NULL ELSE concat('TS', n.kind) END
                   AS tablespace_name,
               n.size * 10 AS avg_row_len
        FROM {cat_objects} o LEFT JOIN {cat_named} n ON n.table_name = o.object_name
        WHERE o.object_type = 'TABLE'
        UNION ALL
        SELECT 'SYSADM', concat('GT_', recname), 'Y', 'NO', NULL, NULL, 'TSTEMP', 0
        FROM {cat_named} WHERE brand = 'Brand#14'""",
    "cat_table_indexes": """
        SELECT DISTINCT 'SYSADM' AS owner, i.index_name, 'SYSADM' AS table_owner, i.table_name,
               CASE WHEN n.brand = 'Brand#15' THEN 'Y' ELSE 'N' END AS temporary,
               CASE WHEN n.brand = 'Brand#16' AND n.size <= 25 THEN 'YES' ELSE 'NO' END AS partitioned
        FROM {cat_ind_columns} i JOIN {cat_named} n ON n.table_name = i.table_name
        UNION ALL
        SELECT 'SYSADM', concat('PSZ', recname), 'SYSADM', table_name, 'N', 'NO'
        FROM {cat_named} WHERE brand IN ('Brand#17', 'Brand#18')
        UNION ALL
        SELECT 'SYSADM', concat('IX', recname), 'SYSADM', table_name, 'N', 'NO'
        FROM {cat_named} WHERE brand = 'Brand#19'""",
    "cat_expressions": """
        SELECT 'SYSADM' AS index_owner, concat('PSZ', recname) AS index_name,
               'SYSADM' AS table_owner, table_name
        FROM {cat_named} WHERE brand = 'Brand#18'""",
    "cat_triggers": """
        SELECT 'SYSADM' AS table_owner, table_name,
               CASE WHEN size <= 25 THEN concat('PSU', recname) ELSE concat('TR', recname) END
                   AS trigger_name
        FROM {cat_named} WHERE brand = 'Brand#20'""",
    "cat_constraints": """
        SELECT 'SYSADM' AS owner, table_name, 'P' AS constraint_type,
               concat('PS_', recname) AS index_name
        FROM {cat_named} WHERE brand = 'Brand#21'""",
    "cat_mview_logs": """
        SELECT 'SYSADM' AS log_owner, table_name AS master FROM {cat_named}
        WHERE brand = 'Brand#22'""",
    "cat_mviews": """
        SELECT 'SYSADM' AS owner, table_name AS mview_name FROM {cat_named}
        WHERE brand = 'Brand#23'""",
    "cat_ddl_events": """
        SELECT concat(n.recname, ':', o.object_name) AS event_id,
               CASE n.kind WHEN 'ECONOMY' THEN 'ALTER' WHEN 'PROMO' THEN 'RENAME' ELSE 'DROP' END
                   AS sysevent,
               'TABLE' AS obj_type, 'SYSADM' AS obj_owner, o.object_name AS obj_name,
               CASE WHEN n.kind = 'ECONOMY' AND n.size <= 20
                        THEN concat('alter table ', o.object_name, ' rename to x')
                    WHEN n.kind = 'SMALL' THEN concat('ALTER TABLE ', o.object_name,
                        ' RENAME TO GT_', substr(o.object_name, 4), 'X')
                    ELSE 'ddl' END AS sql_text,
               n.size = 50 AS ddl_permitted
        FROM {cat_named} n JOIN {cat_objects} o
          ON o.object_type = 'TABLE' AND o.object_name = n.table_name
        UNION ALL
        SELECT concat(n.recname, ':', o.object_name),
               CASE n.kind WHEN 'ECONOMY' THEN 'ALTER' WHEN 'PROMO' THEN 'RENAME' ELSE 'DROP' END,
               'TABLE', 'SYSADM', o.object_name,
               CASE WHEN n.kind = 'SMALL' THEN concat('ALTER TABLE ', o.object_name,
                        ' RENAME TO GT_', substr(o.object_name, 4), 'X')
                    ELSE 'ddl' END, n.size = 50
        FROM {cat_named} n JOIN {cat_objects} o
          ON o.object_type = 'TABLE' AND o.object_name
             = concat(n.table_name, CASE WHEN n.kind = 'SMALL' THEN '14' ELSE '2' END)
        WHERE n.kind IN ('ECONOMY', 'SMALL')
        UNION ALL
        SELECT concat('I:', n.recname, ':', i.index_name), 'DROP', 'INDEX', 'SYSADM', i.index_name, 'drop index', n.size = 49
        FROM {cat_named} n
        JOIN (SELECT table_name, max(index_name) AS index_name FROM {cat_table_indexes}
              GROUP BY table_name) i ON i.table_name = n.table_name""",
    "cat_stat_units": """
        SELECT 'SYSADM' AS owner, p_brand AS table_name, p_type AS partition_name,
               concat('S', cast(p_size AS varchar(20))) AS subpartition_name,
               CASE WHEN p_size = 7 THEN NULL ELSE count(*) * 20 END AS num_rows
        FROM {part} GROUP BY p_brand, p_type, p_size
        UNION ALL
        SELECT 'SYSADM', p_brand, p_type, NULL, count(*) * 25 FROM {part} GROUP BY p_brand, p_type
        UNION ALL
        SELECT 'SYSADM', p_brand, NULL, NULL, count(*) * 30 FROM {part} GROUP BY p_brand""",
    "cat_part_lines": """
        SELECT p_brand, p_type, p_size, l_returnflag, l_quantity, l_tax
        FROM {lineitem} JOIN {part} ON p_partkey = l_partkey""",
    "cat_modifications": """
        SELECT 'SYSADM' AS owner, p_brand AS table_name, p_type AS partition_name,
               concat('S', cast(p_size AS varchar(20))) AS subpartition_name,
               sum(CASE WHEN l_quantity <= 1 THEN 1 ELSE 0 END) AS inserts,
               sum(CASE WHEN l_quantity = 2 THEN 1 ELSE 0 END) AS updates,
               sum(CASE WHEN l_quantity = 3 THEN 1 ELSE 0 END) AS deletes,
               CASE WHEN max(l_tax) < 0.08 THEN 'YES' ELSE 'NO' END AS truncated
        FROM {cat_part_lines} GROUP BY p_brand, p_type, p_size
        UNION ALL
        SELECT 'SYSADM', p_brand, p_type, NULL, sum(CASE WHEN l_quantity <= 2 THEN 1 ELSE 0 END),
               0, 0, 'NO' FROM {cat_part_lines} WHERE p_type <> 'SMALL' GROUP BY p_brand, p_type
        UNION ALL
        SELECT 'SYSADM', p_brand, NULL, NULL, sum(CASE WHEN l_quantity <= 4 THEN 1 ELSE 0 END),
               0, 0, 'NO' FROM {cat_part_lines} GROUP BY p_brand""",
    "cat_stat_locks": """
        SELECT owner, table_name, partition_name, subpartition_name,
               CASE WHEN table_name = 'Brand#5' THEN 'ALL' END AS stattype_locked
        FROM {cat_stat_units}""",
    "cat_overrides": """
        SELECT recname, CASE WHEN size <= 15 THEN 'N' WHEN size <= 30 THEN 'R' ELSE 'G' END
                   AS gather_stats,
               CASE WHEN size <= 38 THEN '42' ELSE ' ' END AS estimate_percent,
               CASE WHEN size <= 45 THEN 'Y' ELSE ' ' END AS block_sample,
               CASE WHEN size <= 33 THEN NULL ELSE 'FOR ALL COLUMNS SIZE 1' END AS method_opt
        FROM {cat_records} WHERE brand IN ('Brand#1', 'Brand#20', 'Brand#21', 'Brand#22')""",
    "cat_stat_requests": """
        SELECT 'SYSADM' AS owner, table_name, 5 AS estpct FROM {cat_tables}
        UNION ALL
        SELECT 'SYSADM', concat('NO_', recname), 5 FROM {cat_records} WHERE brand = 'Brand#24'""",
    "qry_records": """
        SELECT concat('U', cast(o_custkey AS varchar(20))) AS oprid,
               concat('Q', cast(l_orderkey AS varchar(20))) AS qryname,
               CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS selnum,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                   l_extendedprice) AS rcdnum,
               CASE l_linenumber WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'C' WHEN 4 THEN 'D'
                    ELSE 'E' END AS corrname,
               p_type AS recname
        FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {part} ON p_partkey = l_partkey""",
    "qry_fields": """
        SELECT oprid, qryname, selnum, rcdnum AS fldrcdnum,
               CASE WHEN corrname = 'E' AND recname = 'PROMO' THEN 'GONE' ELSE recname END AS recname,
               concat('F', corrname) AS fieldname
        FROM {qry_records}""",
    # monitoring samples: users are agents, event types definitions
    "mon_samples": """
        SELECT 1 AS pm_event_defn_set,
               CASE event_type WHEN 'click' THEN 300 WHEN 'view' THEN 302 WHEN 'error' THEN 153
                    WHEN 'purchase' THEN 150 ELSE 600 END AS pm_event_defn_id,
               event_id AS pm_instance_id, user_id AS pm_agentid, ts AS pm_agent_dttm,
               value AS pm_metric_value1, round(value * 2, 2) AS pm_metric_value2,
               round(value + 1, 2) AS pm_metric_value3, round(500 - value, 2) AS pm_metric_value4,
               value AS pm_metric_value5, value AS pm_metric_value6,
               CASE WHEN value < 100 THEN 'PSAPPSRV' WHEN value < 250 THEN 'PSQRYSRV'
                    ELSE 'JSH' END AS pm_metric_value7,
               CASE WHEN value > 60 THEN '(idle)' ELSE 'busy' END AS pm_addtnl_descr
        FROM {events}""",
    "mon_agents": """
        SELECT c_custkey AS pm_agentid, c_nationkey AS pm_systemid,
               CASE WHEN c_acctbal < 0 THEN c_name
                    ELSE concat('host', cast(c_nationkey AS varchar(20)), ':9000') END
                   AS pm_host_port,
               c_mktsegment AS pm_domain_name, c_name AS pm_instance,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Y' ELSE 'N' END AS pm_agent_inactive,
               CASE WHEN c_acctbal < 5000 THEN '01' ELSE '02' END AS pm_domain_type
        FROM {customer}""",
    "mon_systems": """
        SELECT n_nationkey AS pm_systemid, n_name AS dbname,
               CASE WHEN n_regionkey <= 1 THEN 21600 WHEN n_regionkey = 2 THEN 7200
                    ELSE 28800 END AS pm_sample_int
        FROM {nation}""",
    "mon_definitions": """
        SELECT DISTINCT 1 AS pm_event_defn_set,
               CASE event_type WHEN 'click' THEN 300 WHEN 'view' THEN 302 WHEN 'error' THEN 153
                    WHEN 'purchase' THEN 150 ELSE 600 END AS pm_event_defn_id,
               event_type AS descr60,
               CASE event_type WHEN 'click' THEN 0 ELSE 5 END AS pm_metricid_1,
               CASE event_type WHEN 'view' THEN 1 ELSE 6 END AS pm_metricid_2,
               CASE event_type WHEN 'error' THEN 2 ELSE 7 END AS pm_metricid_3,
               CASE event_type WHEN 'error' THEN 3 ELSE 8 END AS pm_metricid_4,
               12 AS pm_metricid_5, 9 AS pm_metricid_6,
               CASE event_type WHEN 'error' THEN 10 ELSE 999999999 END AS pm_metricid_7
        FROM {events}""",
    "mon_metrics": """
        SELECT n_nationkey AS pm_metricid, concat('Label ', n_name) AS pm_metriclabel,
               CASE WHEN n_regionkey <= 1 THEN '1' WHEN n_regionkey = 2 THEN '2'
                    ELSE '3' END AS pm_metrictype
        FROM {nation}""",
    "mon_translate": """
        SELECT CASE WHEN r_regionkey = 4 THEN 'RUNSTATUS' ELSE 'PM_METRICTYPE' END AS fieldname,
               cast(r_regionkey AS varchar(20)) AS fieldvalue, r_name AS xlatlongname,
               r_name AS xlatshortname
        FROM {region}""",
    # process requests: orders run, their status tells how they ended
    "prc_requests": """
        SELECT o_orderkey AS prcsinstance,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'Application Engine'
                    WHEN '2-HIGH' THEN 'SQR Report' WHEN '5-LOW' THEN 'PSJob'
                    ELSE 'COBOL SQL' END AS prcstype,
               concat('PRC', cast(c_nationkey AS varchar(20))) AS prcsname,
               CASE o_orderstatus WHEN 'F' THEN 9 WHEN 'O' THEN 7 ELSE 11 END AS runstatus,
               o_orderdate AS begindttm,
               CASE WHEN o_orderstatus = 'O' THEN NULL ELSE
                   o_orderdate + INTERVAL '1' SECOND * cast(floor(o_totalprice / 10) AS int)
               END AS enddttm, c_name AS oprid,
               CASE WHEN o_totalprice < 60000 THEN 'TRACE_BINDS' WHEN o_totalprice < 120000
                    THEN 'TRACE' WHEN o_totalprice < 200000 THEN 'SNAP_DAILY' ELSE 'DAILY' END
                   AS runcntlid,
               concat('SRV ', c_mktsegment, '-1') AS servernamerun
        FROM {orders} JOIN {customer} ON c_custkey = o_custkey""",
    "prc_changes": """
        SELECT event_id, user_id AS prcsinstance, ts,
               CASE event_type WHEN 'click' THEN 7 WHEN 'view' THEN 8 WHEN 'error' THEN 3
                    WHEN 'purchase' THEN 9 ELSE 5 END AS runstatus,
               CASE WHEN value < 100 THEN 'Application Engine' WHEN value < 150 THEN 'PSJob'
                    ELSE 'SQR Report' END AS prcstype,
               concat('PRC ', event_type) AS prcsname, 'OPR-1' AS oprid,
               CASE WHEN value < 30 THEN 'TRACE_BIND' WHEN value < 60 THEN 'TRACE 1'
                    WHEN value < 300 THEN 'MY_SNAP' ELSE 'DAILY' END AS runcntlid,
               concat('SRV-', event_type) AS servernamerun, value
        FROM {events}""",
    # statement timings: brands are programs, types statements, orders processes
    "stm_timings": """
        SELECT l_orderkey AS process_instance, p_brand AS bat_program_name, p_type AS detail_id,
               l_quantity AS execute_time, l_tax * 100 AS compile_time,
               l_discount * 100 AS fetch_time, cast(l_linenumber AS double) AS retrieve_time,
               cast(l_linenumber AS bigint) AS execute_count,
               cast(p_size AS double) AS peoplecodesqltime,
               l_extendedprice / 1000 AS peoplecodetime, cast(1 AS bigint) AS peoplecodecount
        FROM {lineitem} JOIN {part} ON p_partkey = l_partkey""",
    # query executions
    "qry_log": """
        SELECT concat('USER', cast(user_id AS varchar(20))) AS oprid, event_type AS qryname,
               value AS exectime, round(value / 10, 3) AS fetchtime,
               cast(user_id AS double) AS numrows, ts AS execdttm, event_id,
               CASE WHEN value > 450 THEN 'killed' ELSE ' ' END AS killedreason
        FROM {events}""",
    "qry_stats": """
        SELECT concat('USER', cast(c_custkey AS varchar(20))) AS oprid,
               CASE WHEN c_nationkey <= 12 THEN 'click' ELSE 'view' END AS qryname,
               cast(c_nationkey + 1 AS bigint) AS execcount, abs(c_acctbal) AS avgexectime,
               round(abs(c_acctbal) / 10, 3) AS avgfetchtime,
               cast(c_nationkey AS double) AS avgnumrows,
               cast('2023-06-01 00:00:00' AS timestamp) AS lastexecdttm,
               cast(0 AS bigint) AS numkills
        FROM {customer}""",
    # service requests: queue = event type, running for value minutes
    "svc_requests": """
        SELECT event_id, event_type AS queue, concat('S', cast(user_id AS varchar(20))) AS service,
               user_id AS pid, ts AS stimestamp, value, value * 60 AS dur
        FROM {events}""",
}


# written once when a query has several inputs that are built from them
BUILT_ONCE = ("cat_pairs", "cat_fields", "cat_keys", "cat_ind_columns", "cat_objects",
              "cat_table_indexes")


def _built_once(names: tuple[str, ...]) -> set[str]:
    """The tables to write before a query of these inputs: those of BUILT_ONCE that it reads
    more than once. What one such table alone is built from once is a step on the way to it.
    """
    needed = set(names)
    for name in reversed(DERIVED):
        if name in needed:
            needed.update(n for n in DERIVED if f"{{{n}}}" in DERIVED[name])
    if {"qry_records", "qry_fields"} <= set(names):
        return {"qry_records"}
    if sum(n in DERIVED for n in names) < 3:
        return set()
    readers = {n: [m for m in needed if m in DERIVED for _ in range(DERIVED[m].count(f"{{{n}}}"))]
               for n in BUILT_ONCE}
    return {n for n in BUILT_ONCE if n in needed
            and (n in names or len(readers[n]) > 1 or readers[n][0] not in BUILT_ONCE)}


def derived(spark: SparkSession, sf_dir: str, *names: str):
    """The named source or derived tables as DataFrames; only files that are
    needed are opened."""
    configure(spark)
    once = _built_once(names)
    known: dict[str, DataFrame] = {}

    def table(name: str) -> DataFrame:
        if name not in known:
            if name in DERIVED:
                sql = DERIVED[name]
                used = {n: table(n) for n in (*SOURCES, *DERIVED) if f"{{{n}}}" in sql}
                made = spark.sql(sql, **used)
                known[name] = written(made, name) if name in once else made
            else:
                known[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return known[name]

    out = tuple(table(n) for n in names)
    return out[0] if len(out) == 1 else out


def with_clause(*names: str) -> str:
    """The same derivation as WITH clause of a plain SQL statement."""
    needed = set(names)
    for name in reversed(DERIVED):
        if name in needed:
            needed.update(n for n in DERIVED if f"{{{n}}}" in DERIVED[name])
    plain = {n: n for n in (*SOURCES, *DERIVED)}
    parts = [f"{n} AS ({sql.format(**plain)})" for n, sql in DERIVED.items() if n in needed]
    return "WITH " + ",\n".join(parts)
