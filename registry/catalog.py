"""Catalog and policy queries (C0-C20) over catalogs derived from the tables:
parts are records, suppliers fields, line items say which record has which."""

from pyspark.sql import functions as F

from opsight.operators import catalog, policy
from opsight.session import written
from registry.base import big, query

BUILT = """
b AS (SELECT *, CASE WHEN sqltablename = ' ' THEN concat('PS_', recname) ELSE sqltablename END AS base,
        CASE WHEN rectype IN (1, 6) THEN 'VIEW' ELSE 'TABLE' END AS otype,
        CASE rectype WHEN 0 THEN 'TABLE' WHEN 1 THEN 'VIEW' WHEN 6 THEN 'QUERY VIEW'
          ELSE 'TEMPORARY TABLE' END AS rectype_desc
      FROM cat_records WHERE rectype IN (0, 1, 6, 7))"""
EXPANDED = """
x AS (SELECT recname, fieldname, useedit, [fieldnum] AS path, recname AS subrecname FROM cat_raw_fields
  UNION ALL
  SELECT x.recname, f.fieldname, f.useedit, list_append(x.path, f.fieldnum), f.recname
  FROM x JOIN cat_records s ON s.recname = x.fieldname AND s.rectype = 3
  JOIN cat_raw_fields f ON f.recname = x.fieldname),
e AS (SELECT recname, fieldname, useedit, subrecname,
        row_number() OVER (PARTITION BY recname ORDER BY path, fieldname) AS fieldnum
      FROM x WHERE NOT EXISTS (SELECT 1 FROM cat_records s WHERE s.recname = x.fieldname
                               AND s.rectype = 3))"""


@query("cat_raw_fields", "cat_records", sql=f"""
WITH RECURSIVE {EXPANDED}
SELECT recname, fieldname, CAST(useedit AS BIGINT) AS useedit, fieldnum, subrecname FROM e""")
def expand_subrecords(fields, records):
    """Nested sub-records replaced by their fields."""
    return catalog.expand_subrecords(fields, records).select(
        "recname", "fieldname", big("useedit"), big("fieldnum"), "subrecname")


@query("cat_fields", "cat_field_types", "cat_records", sql="""
SELECT f.recname, f.fieldname, row_number() OVER (PARTITION BY f.recname ORDER BY
  CASE WHEN r.rectype IN (0, 7) AND ((t.fieldtype = 1 AND NOT t.length BETWEEN 1 AND 2000)
    OR t.fieldtype = 8) THEN 1 ELSE 0 END, f.fieldnum) AS fieldnum
FROM cat_fields f LEFT JOIN cat_field_types t USING (fieldname)
LEFT JOIN cat_records r ON r.recname = f.recname""")
def move_long_last(fields, types, records):
    """C0b."""
    return catalog.move_long_last(fields, types, records).select(
        "recname", "fieldname", big("fieldnum"))


ALT = """
a AS (SELECT recname, fieldname, fieldnum, subrecname,
        rank() OVER (PARTITION BY recname ORDER BY fieldnum) - 1 AS n,
        rank() OVER (PARTITION BY recname, subrecname ORDER BY fieldnum) - 1 AS m
      FROM cat_fields WHERE useedit % 32 = 16),
al AS (SELECT recname, CASE WHEN n < 10 THEN CAST(n AS VARCHAR) ELSE '##' END AS indexid, subrecname,
         CASE WHEN m < 10 THEN CAST(m AS VARCHAR) ELSE '##' END AS subindexid, fieldname, fieldnum
       FROM a)"""
DEFS = f"""{ALT},
defs AS (SELECT DISTINCT c.recname, i.indexid, c.recname AS subrecname, i.indexid AS subindexid
    FROM cat_fields c JOIN cat_indexes i ON i.recname = c.subrecname AND i.platform_ora = 1
    WHERE NOT i.indexid BETWEEN '0' AND '9'
  UNION ALL
  SELECT DISTINCT al.recname, al.indexid, al.subrecname, al.subindexid FROM al
    JOIN cat_indexes i ON i.indexid = al.subindexid AND i.recname = al.subrecname
    AND i.platform_ora = 1 WHERE al.indexid BETWEEN '0' AND '9')"""
POSITIONS = f"""{DEFS},
kv AS (SELECT j.recname, j.indexid, k.fieldname,
    rank() OVER (PARTITION BY j.recname, j.indexid ORDER BY CASE WHEN j.indexid <> '_'
      OR i.custkeyorder = 1 THEN k.keyposn ELSE c.fieldnum END) AS keyposn,
    rank() OVER (PARTITION BY j.recname, j.indexid ORDER BY c.fieldnum) AS fieldposn
  FROM defs j JOIN cat_indexes i ON i.recname = j.subrecname AND i.indexid = j.subindexid
  JOIN cat_fields c ON c.recname = j.recname
  JOIN cat_keys k ON k.recname = c.subrecname AND k.indexid = j.subindexid
    AND k.fieldname = c.fieldname
  WHERE j.indexid = '_' OR j.indexid BETWEEN 'A' AND 'Z'),
kd AS (SELECT recname, indexid, keyposn, fieldname FROM kv
  UNION ALL SELECT recname, indexid, 1, fieldname FROM al
  UNION ALL SELECT al.recname, al.indexid, kv.fieldposn + 1, kv.fieldname FROM al
    JOIN kv ON kv.recname = al.recname AND kv.indexid = '_'),
pos AS (SELECT kd.recname, kd.indexid, kd.fieldname, CASE WHEN EXISTS (
    SELECT 1 FROM defs d JOIN cat_indexes j ON j.recname = d.recname AND j.indexid = d.indexid
    WHERE j.custkeyorder = 1 AND d.recname = kd.recname AND d.indexid = kd.indexid)
  THEN k1.keyposn ELSE kd.keyposn END AS keyposn
  FROM kd LEFT JOIN cat_keys k1 ON k1.recname = kd.recname AND k1.indexid = kd.indexid
    AND k1.fieldname = kd.fieldname)"""


@query("cat_fields", "cat_indexes", sql=f"""
WITH {DEFS} SELECT * FROM defs""")
def index_definitions(fields, indexes):
    """C0c with W10."""
    return catalog.derive_index_definitions(fields, indexes)


def _positions(fields, indexes, keys):
    definitions = catalog.derive_index_definitions(fields, indexes)
    return catalog.key_positions(fields, indexes, keys, definitions)


@query("cat_fields", "cat_indexes", "cat_keys", sql=f"""
WITH {POSITIONS} SELECT recname, indexid, fieldname, CAST(keyposn AS BIGINT) AS keyposn FROM pos""")
def key_positions(fields, indexes, keys):
    """C0c with W10, O4."""
    return _positions(fields, indexes, keys).select(
        "recname", "indexid", "fieldname", big("keyposn"))


@query("cat_records", "cat_objects", sql=f"""
WITH {BUILT} SELECT rectype_desc, recname, sqltablename FROM b WHERE NOT EXISTS (
  SELECT 1 FROM cat_objects WHERE object_type = otype AND object_name = base)""")
def missing_objects(records, objects):
    """C1 with J16, P8."""
    return catalog.missing_objects(records, objects)


@query("cat_records", "cat_objects", sql=f"""
WITH {BUILT}
SELECT object_type, object_name FROM cat_objects EXCEPT SELECT otype, base FROM b
EXCEPT SELECT 'TABLE', object_name FROM b JOIN cat_objects ON starts_with(object_name, base)
  AND object_name BETWEEN concat(base, '1') AND concat(base, '9999Z') AND object_type = 'TABLE'
  WHERE rectype = 7""")
def undeclared_objects(records, objects):
    """C2 with J18, O3."""
    return catalog.undeclared_objects(records, objects)


@query("cat_records", "cat_objects", "cat_instances", "cat_settings", sql=f"""
WITH {BUILT}, t AS (SELECT b.recname, base, coalesce(i.temptblinstances, 0) + s.temptblinstances AS n
  FROM b LEFT JOIN cat_instances i USING (recname) CROSS JOIN cat_settings s WHERE rectype = 7)
SELECT recname, object_name AS table_name, CAST(n AS BIGINT) AS temptblinstances
FROM t JOIN cat_objects ON object_type = 'TABLE' AND starts_with(object_name, base)
  AND object_name BETWEEN concat(base, '1') AND concat(base, '9999')
WHERE TRY_CAST(substr(object_name, length(base) + 1) AS INTEGER) > n""")
def excess_temp_instances(records, objects, instances, settings):
    """C3 with J17, J18."""
    return catalog.excess_temp_instances(records, objects, instances, settings).select(
        "recname", "table_name", big("temptblinstances"))


COUNTS = """
p AS (SELECT recname, count(*) AS pscols FROM cat_fields GROUP BY 1),
d AS (SELECT table_name, count(*) AS dbcols FROM cat_columns GROUP BY 1)"""


@query("cat_records", "cat_fields", "cat_columns", sql=f"""
WITH {BUILT}, {COUNTS}
SELECT recname, table_name, pscols, dbcols FROM b JOIN p USING (recname)
JOIN d ON d.table_name = base WHERE pscols <> dbcols""")
def column_count_mismatch(records, fields, columns):
    """C4 with A12."""
    return catalog.column_count_mismatch(records, fields, columns)


@query("cat_records", "cat_objects", "cat_fields", "cat_columns", sql=f"""
WITH {BUILT}
SELECT rectype_desc, recname, fieldname, sqltablename FROM cat_fields JOIN b USING (recname)
JOIN cat_objects ON object_type = otype AND object_name = base
WHERE NOT EXISTS (SELECT 1 FROM cat_columns WHERE table_name = base AND column_name = fieldname)""")
def missing_columns(records, objects, fields, columns):
    """C5."""
    return catalog.missing_columns(records, objects, fields, columns)


@query("cat_records", "cat_objects", "cat_fields", "cat_columns", sql=f"""
WITH {BUILT}
SELECT rectype_desc, recname, column_name, sqltablename FROM cat_columns JOIN b ON table_name = base
EXCEPT
SELECT rectype_desc, recname, fieldname, sqltablename FROM cat_fields JOIN b USING (recname)
JOIN cat_objects ON object_type = otype AND object_name = base""")
def undeclared_columns(records, objects, fields, columns):
    """C6."""
    return catalog.undeclared_columns(records, objects, fields, columns)


@query("cat_records", "cat_fields", "cat_field_types", "cat_columns", "cat_settings", sql="""
WITH b AS (SELECT *, CASE WHEN sqltablename = ' ' THEN concat('PS_', recname) ELSE sqltablename END
  AS base FROM cat_records WHERE rectype IN (0, 7)),
j AS (SELECT b.recname, c.column_name, c.data_type, CAST(c.data_length AS BIGINT) AS data_length,
    f.fieldtype, [
    CASE WHEN p.useedit % 512 = 256 AND c.nullable = 'Y' THEN 'required but nullable' END,
    CASE WHEN f.fieldtype IN (0, 2, 3) AND c.nullable = 'Y' AND NOT p.fieldname = b.systemidfieldname
      THEN 'plain type but nullable' END,
    CASE WHEN c.data_type = 'VARCHAR2' AND f.fieldtype = 0 AND c.data_length <> least(4000, f.length)
      THEN 'length' END,
    CASE WHEN f.fieldtype = 1 AND f.length BETWEEN 1 AND 2000 AND c.data_type <> 'VARCHAR2'
      THEN 'short long' END,
    CASE WHEN f.fieldtype = 1 AND NOT f.length BETWEEN 1 AND 2000 AND f.format = 0
      AND c.data_type <> 'LONG' THEN 'long' END,
    CASE WHEN f.fieldtype = 1 AND f.format = 7 AND c.data_type <> 'LONG RAW' THEN 'raw long' END,
    CASE WHEN f.fieldtype = 2 AND NOT (c.data_type = 'NUMBER' AND c.data_scale = f.decimalpos
      AND (c.data_precision + 1 = f.length OR c.data_scale = 0)) THEN 'number' END,
    CASE WHEN f.fieldtype = 3 AND NOT (c.data_type = 'NUMBER' AND c.data_scale = f.decimalpos
      AND (c.data_precision + 2 = f.length OR c.data_scale = 0)) THEN 'signed number' END,
    CASE WHEN f.fieldtype IN (4, 5, 6) AND c.data_type <> 'DATE' THEN 'date' END,
    CASE WHEN f.fieldtype = 8 AND c.data_type <> 'LONG RAW' THEN 'image' END,
    CASE WHEN f.fieldtype = 9 AND NOT (c.data_type = 'VARCHAR2' AND c.data_length = 30)
      THEN 'image reference' END] AS why
  FROM b JOIN cat_fields p USING (recname) JOIN cat_field_types f ON f.fieldname = p.fieldname
  JOIN cat_columns c ON c.table_name = base AND c.column_name = p.fieldname)
SELECT recname, column_name, data_type, data_length,
  array_to_string(list_filter(why, lambda w: w IS NOT NULL), ', ') AS reasons
FROM j WHERE len(list_filter(why, lambda w: w IS NOT NULL)) > 0""")
def definition_mismatch(records, fields, types, columns, settings):
    """C7 with P7, P8, J17, O3's LEAST rule."""
    out = catalog.definition_mismatch(records, fields, types, columns, settings)
    return out.select("recname", "column_name", "data_type", big("data_length"),
                      F.array_join("reasons", ", ").alias("reasons"))


@query("cat_records", "cat_raw_fields", "cat_field_types", sql="""
SELECT f.recname, f.fieldname FROM cat_raw_fields f JOIN cat_records r USING (recname)
WHERE r.rectype <> 3 AND NOT EXISTS (SELECT 1 FROM cat_field_types d WHERE d.fieldname = f.fieldname
  UNION ALL SELECT 1 FROM cat_records s WHERE s.recname = f.fieldname AND s.rectype = 3)""")
def undefined_fields(records, raw_fields, types):
    """C8."""
    return catalog.undefined_fields(records, raw_fields, types)


@query("cat_records", "cat_fields", "cat_field_types", "cat_columns", sql=f"""
WITH {BUILT}, {COUNTS}
SELECT rectype_desc, b.recname, column_name, sqltablename, column_id, fieldnum
FROM b JOIN p USING (recname) JOIN d ON d.table_name = base AND pscols = dbcols
JOIN cat_fields f ON f.recname = b.recname
JOIN cat_columns c ON c.table_name = base AND c.column_name = f.fieldname
WHERE column_id <> fieldnum
  AND EXISTS (SELECT 1 FROM cat_field_types t WHERE t.fieldname = f.fieldname)""")
def column_position_mismatch(records, fields, types, columns):
    """C9."""
    return catalog.column_position_mismatch(records, fields, types, columns)


@query("cat_records", "cat_fields", "cat_indexes", "cat_keys", "cat_ind_columns", sql=f"""
WITH {POSITIONS},
b AS (SELECT recname, CASE WHEN sqltablename = ' ' THEN concat('PS_', recname) ELSE sqltablename END
  AS base FROM cat_records),
k AS (SELECT recname, indexid, count(*) AS pscols FROM pos GROUP BY 1, 2),
i AS (SELECT table_name, index_name, count(*) AS dbcols FROM cat_ind_columns GROUP BY 1, 2)
SELECT recname, indexid, table_name, index_name, dbcols, pscols FROM k JOIN b USING (recname)
JOIN i ON table_name = base AND index_name = concat('PS', indexid, recname)
WHERE dbcols <> pscols""")
def index_count_mismatch(records, fields, indexes, keys, ind_columns):
    """C10."""
    return catalog.index_count_mismatch(records, _positions(fields, indexes, keys), ind_columns)


@query("cat_records", "cat_fields", "cat_indexes", "cat_keys", "cat_ind_columns", sql=f"""
WITH {POSITIONS},
b AS (SELECT recname, CASE WHEN sqltablename = ' ' THEN concat('PS_', recname) ELSE sqltablename END
  AS base FROM cat_records)
SELECT recname, indexid, fieldname, CAST(keyposn AS BIGINT) AS keyposn,
  CAST(column_position AS BIGINT) AS column_position
FROM pos JOIN b USING (recname) JOIN cat_ind_columns i ON i.table_name = base
  AND i.index_name = concat('PS', indexid, recname) AND column_name = fieldname
WHERE keyposn <> column_position""")
def index_position_mismatch(records, fields, indexes, keys, ind_columns):
    """C11."""
    return catalog.index_position_mismatch(
        records, _positions(fields, indexes, keys), ind_columns).select(
        "recname", "indexid", "fieldname", big("keyposn"), big("column_position"))


@query("cat_records", "cat_fields", "cat_tables", sql="""
WITH m AS (SELECT *, useedit % 4 = 2 OR useedit % 2 = 1 AS is_key FROM cat_fields),
b AS (SELECT recname, CASE WHEN sqltablename = ' ' THEN concat('PS_', recname) ELSE sqltablename END
  AS base FROM cat_records WHERE rectype IN (0, 7))
SELECT x.recname, x.fieldname, x.fieldnum,
  CASE WHEN x.useedit % 4 = 2 THEN 'Duplicate' ELSE 'Unique' END AS keytype,
  CAST(nullif(avg_row_len, 0) AS BIGINT) AS avg_row_len
FROM m x JOIN m y ON y.recname = x.recname AND y.fieldnum = x.fieldnum - 1
JOIN b ON b.recname = x.recname LEFT JOIN cat_tables t ON t.table_name = base
WHERE x.is_key AND NOT y.is_key""")
def keys_not_first(records, fields, tables):
    """C12, switched on."""
    return catalog.keys_not_first(records, fields, tables, enabled=True).select(
        "recname", "fieldname", "fieldnum", "keytype", big("avg_row_len"))


@query("cat_records", "cat_objects", "cat_fields", "cat_columns", "cat_indexes", "cat_keys",
       "cat_ind_columns", "cat_tables", sql=f"""
WITH {BUILT}, {COUNTS}, {POSITIONS},
f1 AS (SELECT recname FROM b WHERE NOT EXISTS (SELECT 1 FROM cat_objects WHERE object_type = otype
    AND object_name = base)
  UNION SELECT recname FROM b JOIN p USING (recname) JOIN d ON d.table_name = base
    WHERE pscols <> dbcols),
f2 AS (SELECT DISTINCT pos.recname, pos.indexid FROM pos JOIN cat_records r USING (recname)
  JOIN cat_ind_columns i ON i.table_name = CASE WHEN r.sqltablename = ' '
      THEN concat('PS_', r.recname) ELSE r.sqltablename END
    AND i.index_name = concat('PS', indexid, pos.recname) AND column_name = fieldname
  WHERE keyposn <> column_position),
ok AS (SELECT recname FROM cat_records EXCEPT SELECT recname FROM b JOIN cat_tables ON table_name = base
       WHERE rectype IN (0, 7) AND tablespace_name IS NULL)
SELECT CAST(0 AS BIGINT) AS object_type, recname, ' ' AS indexid
FROM (SELECT recname FROM f1 UNION SELECT recname FROM f2) JOIN ok USING (recname)
UNION ALL
SELECT CAST(1 AS BIGINT), recname, indexid FROM f2 JOIN ok USING (recname)""")
def rebuild_list(records, objects, fields, columns, indexes, keys, ind_columns, tables):
    """C13 over three of its audits: C1, C4 and C11. rebuild_list_of_all_audits has all nine."""
    positions = _positions(fields, indexes, keys)
    return catalog.rebuild_list(
        [catalog.missing_objects(records, objects),
         catalog.column_count_mismatch(records, fields, columns)],
        [catalog.index_position_mismatch(records, positions, ind_columns)],
        records, tables).select(big("object_type"), "recname", "indexid")


@query("cat_records", "cat_objects", "cat_fields", "cat_columns", "cat_indexes", "cat_keys",
       "cat_ind_columns", "cat_tables", "cat_instances", "cat_settings", "cat_field_types", sql=f"""
WITH {BUILT}, {COUNTS}, {POSITIONS},
r AS (SELECT *, CASE WHEN sqltablename = ' ' THEN concat('PS_', recname) ELSE sqltablename END AS base
  FROM cat_records),
there AS (SELECT b.* FROM b JOIN cat_objects ON object_type = otype AND object_name = base),
temps AS (SELECT b.recname, base, coalesce(i.temptblinstances, 0) + s.temptblinstances AS n
  FROM b LEFT JOIN cat_instances i USING (recname) CROSS JOIN cat_settings s WHERE rectype = 7),
pairs AS (SELECT b.recname, b.rectype, b.systemidfieldname, q.fieldname AS declared, q.fieldnum, q.useedit,
    c.* FROM b JOIN cat_fields q USING (recname)
  JOIN cat_columns c ON c.table_name = base AND c.column_name = q.fieldname),
f1 AS (SELECT recname FROM b WHERE NOT EXISTS (SELECT 1 FROM cat_objects WHERE object_type = otype
    AND object_name = base)
  UNION SELECT recname FROM temps JOIN cat_objects ON object_type = 'TABLE' AND starts_with(object_name, base)
    AND object_name BETWEEN concat(base, '1') AND concat(base, '9999')
    WHERE TRY_CAST(substr(object_name, length(base) + 1) AS INTEGER) > n
  UNION SELECT recname FROM b JOIN p USING (recname) JOIN d ON d.table_name = base
    WHERE pscols <> dbcols
  UNION SELECT recname FROM there JOIN cat_fields USING (recname) WHERE NOT EXISTS (
    SELECT 1 FROM cat_columns WHERE table_name = base AND column_name = fieldname)
  UNION SELECT recname FROM b JOIN cat_columns ON table_name = base WHERE NOT EXISTS (
    SELECT 1 FROM there JOIN cat_fields q ON q.recname = there.recname
    WHERE there.recname = b.recname AND q.fieldname = column_name)
  UNION SELECT recname FROM pairs c JOIN cat_field_types f ON f.fieldname = declared
    WHERE rectype IN (0, 7) AND (useedit % 512 = 256 AND nullable = 'Y'
      OR fieldtype IN (0, 2, 3) AND nullable = 'Y' AND NOT declared = systemidfieldname
      OR data_type = 'VARCHAR2' AND fieldtype = 0 AND data_length <> least(4000, f.length)
      OR fieldtype = 1 AND f.length BETWEEN 1 AND 2000 AND data_type <> 'VARCHAR2'
      OR fieldtype = 1 AND NOT f.length BETWEEN 1 AND 2000 AND f.format = 0 AND data_type <> 'LONG'
      OR fieldtype = 1 AND f.format = 7 AND data_type <> 'LONG RAW'
      OR fieldtype = 2 AND NOT (data_type = 'NUMBER' AND data_scale = f.decimalpos
        AND (data_precision + 1 = f.length OR data_scale = 0))
      OR fieldtype = 3 AND NOT (data_type = 'NUMBER' AND data_scale = f.decimalpos
        AND (data_precision + 2 = f.length OR data_scale = 0))
      OR fieldtype IN (4, 5, 6) AND data_type <> 'DATE' OR fieldtype = 8 AND data_type <> 'LONG RAW'
      OR fieldtype = 9 AND NOT (data_type = 'VARCHAR2' AND data_length = 30))
  UNION SELECT pairs.recname FROM pairs JOIN p ON p.recname = pairs.recname
    JOIN d ON d.table_name = pairs.table_name AND pscols = dbcols WHERE column_id <> fieldnum
    AND EXISTS (SELECT 1 FROM cat_field_types t WHERE t.fieldname = declared)),
k AS (SELECT recname, indexid, count(*) AS n FROM pos GROUP BY 1, 2),
i AS (SELECT table_name, index_name, count(*) AS n FROM cat_ind_columns GROUP BY 1, 2),
f2 AS (SELECT recname, indexid FROM k JOIN r USING (recname) JOIN i ON table_name = base
    AND index_name = concat('PS', indexid, recname) WHERE k.n <> i.n
  UNION SELECT pos.recname, pos.indexid FROM pos JOIN r USING (recname) JOIN cat_ind_columns c
    ON c.table_name = base AND c.index_name = concat('PS', indexid, pos.recname) AND column_name = fieldname
    WHERE keyposn <> column_position),
ok AS (SELECT recname FROM cat_records EXCEPT SELECT recname FROM b JOIN cat_tables ON table_name = base
       WHERE rectype IN (0, 7) AND tablespace_name IS NULL)
SELECT CAST(0 AS BIGINT) AS object_type, recname, ' ' AS indexid
FROM (SELECT recname FROM f1 UNION SELECT recname FROM f2) JOIN ok USING (recname)
UNION ALL
SELECT CAST(1 AS BIGINT), recname, indexid FROM f2 JOIN ok USING (recname)""")
def rebuild_list_of_all_audits(records, objects, fields, columns, indexes, keys, ind_columns, tables,
                               instances, settings, types):
    """C13 over the nine audits that feed it: C1, C3-C7 and C9 for records, C10 and C11 for indexes."""
    columns = written(columns, "columns")  # five audits read them
    positions = written(_positions(fields, indexes, keys), "key-positions")
    return catalog.rebuild_list(
        [catalog.missing_objects(records, objects),
         catalog.excess_temp_instances(records, objects, instances, settings),
         catalog.column_count_mismatch(records, fields, columns),
         catalog.missing_columns(records, objects, fields, columns),
         catalog.undeclared_columns(records, objects, fields, columns),
         catalog.definition_mismatch(records, fields, types, columns, settings),
         catalog.column_position_mismatch(records, fields, types, columns)],
        [catalog.index_count_mismatch(records, positions, ind_columns),
         catalog.index_position_mismatch(records, positions, ind_columns)],
        records, tables).select(big("object_type"), "recname", "indexid")


@query("cat_records", "cat_tables", sql=f"""
WITH {BUILT}
SELECT recname, 'TSSMALL' AS ddlspacename, table_name, tablespace_name AS new_ddlspacename
FROM b JOIN cat_tables ON table_name = base
WHERE rectype IN (0, 7) AND tablespace_name <> 'TSSMALL'""")
def placement_drift(records, tables):
    """C14."""
    placements = records.select("recname", F.lit("TSSMALL").alias("ddlspacename"))
    return catalog.placement_drift(records, placements, tables)


STALE = """
SELECT u.owner, u.table_name, u.partition_name, u.subpartition_name,
  CASE WHEN u.subpartition_name IS NOT NULL THEN 'SUBPARTITION'
    WHEN u.partition_name IS NOT NULL THEN 'PARTITION' ELSE 'GLOBAL' END AS granularity
FROM cat_stat_units u LEFT JOIN cat_modifications m ON m.owner = u.owner
  AND m.table_name = u.table_name AND m.partition_name IS NOT DISTINCT FROM u.partition_name
  AND m.subpartition_name IS NOT DISTINCT FROM u.subpartition_name
LEFT JOIN cat_stat_locks s ON s.owner = u.owner AND s.table_name = u.table_name
  AND s.partition_name IS NOT DISTINCT FROM u.partition_name
  AND s.subpartition_name IS NOT DISTINCT FROM u.subpartition_name
WHERE (u.num_rows IS NULL OR u.num_rows * 10 / 100 <= m.inserts + m.updates + m.deletes
  OR m.truncated = 'YES') AND {locks}"""


@query("cat_stat_units", "cat_modifications", "cat_stat_locks",
       sql=STALE.format(locks="s.stattype_locked IS NULL"))
def stale_partitions(units, modifications, statistics):
    """C15."""
    return policy.stale_partitions(units, modifications, statistics)


@query("cat_stat_units", "cat_modifications", "cat_stat_locks", sql=STALE.format(locks="true"))
def stale_partitions_forced(units, modifications, statistics):
    """C15 with locked units."""
    return policy.stale_partitions(units, modifications, statistics, force=True)


@query("cat_stat_requests", "cat_tables", "cat_records", "cat_overrides", sql="""
WITH b AS (SELECT recname, rectype, CASE WHEN sqltablename = ' ' THEN concat('PS_', recname)
    ELSE sqltablename END AS base FROM cat_records),
q AS (SELECT r.owner, r.table_name, r.estpct, t.temporary, left(t.partitioned, 1) AS part,
    t.table_name IS NOT NULL AS there, coalesce(r0.recname, r1.recname, r2.recname) AS recname,
    coalesce(r0.rectype, r1.rectype, r2.rectype) AS rectype,
    CASE WHEN r0.recname IS NOT NULL THEN NULL WHEN r1.recname IS NOT NULL
      THEN right(r.table_name, 1) WHEN r2.recname IS NOT NULL THEN right(r.table_name, 2) END AS inst
  FROM cat_stat_requests r LEFT JOIN cat_tables t USING (owner, table_name)
  LEFT JOIN b r0 ON r0.base = r.table_name AND r0.rectype IN (0, 7)
  LEFT JOIN b r1 ON r1.base = left(r.table_name, -1) AND r1.rectype = 7
  LEFT JOIN b r2 ON r2.base = left(r.table_name, -2) AND r2.rectype = 7),
w AS (SELECT q.*, o.recname IS NOT NULL AS has, CASE WHEN o.recname IS NOT NULL THEN o.gather_stats
    WHEN rectype = 0 THEN 'R' WHEN rectype = 7 THEN 'G' END AS want,
    nullif(rtrim(o.estimate_percent), '') AS pct, nullif(rtrim(o.method_opt), '') AS opt
  FROM q LEFT JOIN cat_overrides o ON o.recname = q.recname),
z AS (SELECT *, CASE WHEN NOT there THEN 'error' WHEN want = 'N' THEN 'none'
    WHEN want <> 'N' AND temporary = 'Y' AND inst IS NULL THEN 'none'
    WHEN part = 'Y' OR want = 'R' THEN 'refresh' ELSE 'gather' END AS decision FROM w)
SELECT owner, table_name, recname, inst AS instance, decision,
  CASE WHEN decision IN ('refresh', 'gather') THEN coalesce(CAST(pct AS DOUBLE),
    CAST(estpct AS DOUBLE)) END AS estimate_percent,
  CASE WHEN decision IN ('refresh', 'gather') THEN CASE WHEN has THEN opt
    ELSE 'FOR ALL COLUMNS SIZE AUTO' END END AS method_opt
FROM z""")
def stats_policy(requests, tables, records, overrides):
    """C16 with J14."""
    out = policy.stats_policy(requests, tables, catalog.with_base_table(records), overrides)
    return out.select("owner", "table_name", "recname", "instance", "decision",
                      "estimate_percent", "method_opt")


@query("cat_overrides", "part", sql="""
SELECT recname, gather_stats, estimate_percent, block_sample, method_opt FROM cat_overrides
UNION ALL
SELECT DISTINCT concat('R', p_partkey), 'N', ' ', ' ', NULL FROM part
WHERE p_name LIKE 'red%' AND concat('R', p_partkey) NOT IN (SELECT recname FROM cat_overrides)""")
def default_override_rows(overrides, part):
    """C20."""
    members = part.select(
        F.concat(F.lit("R"), F.col("p_partkey").cast("string")).alias("recname"),
        F.when(F.col("p_name").like("red%"), "TL_TIMEADMIN").otherwise("OTHER").alias("ae_applid"))
    return policy.default_override_rows(overrides, members)


FACTS = ("cat_named", "cat_indexes", "cat_fields", "cat_tables", "cat_table_indexes",
         "cat_expressions", "cat_triggers", "cat_constraints", "cat_mview_logs", "cat_mviews")


@query("cat_ddl_events", *FACTS, sql="""
WITH own0 AS (SELECT table_name AS t, recname, rectype, '' AS sfx, 0 AS ps FROM cat_named
    WHERE rectype IN (0, 7)),
own1 AS (SELECT concat(table_name, CAST(n AS VARCHAR)) AS t, recname, rectype, CAST(n AS VARCHAR) AS sfx,
    1 AS ps FROM cat_named, (SELECT unnest(generate_series(1, 9)) AS n) WHERE rectype = 7),
own AS (SELECT * FROM own0 UNION ALL SELECT * FROM own1 WHERE t NOT IN (SELECT t FROM own0)),
ix AS (SELECT i.*, recname, sfx, substr(index_name, 3, 1) IN ('_','0','1','2','3','4','5','6','7','8','9')
    AS third, EXISTS (SELECT 1 FROM cat_indexes d WHERE d.recname = own.recname
      AND concat('PS', d.indexid, d.recname, sfx) = index_name AND d.indexid = substr(index_name, 3, 1))
    AS declared, EXISTS (SELECT 1 FROM cat_indexes d WHERE d.recname = own.recname
      AND concat('PS', d.indexid, d.recname, sfx) = i.table_name) AS declared_t,
    EXISTS (SELECT 1 FROM cat_expressions e WHERE e.index_name = i.index_name
      AND e.table_name = i.table_name) AS expr
  FROM cat_table_indexes i JOIN own ON own.t = i.table_name),
iv AS (SELECT e.event_id, CASE WHEN ix.temporary = 'Y' THEN 20002 WHEN ix.partitioned = 'YES' THEN 20003
    WHEN third AND obj_name LIKE concat('PS_', recname) THEN NULL
    WHEN NOT declared AND expr THEN 20004 WHEN NOT declared THEN 20005
    WHEN EXISTS (SELECT 1 FROM cat_tables s WHERE s.temporary = 'Y'
      AND s.table_name = concat('GT', substr(ix.table_name, 3))) THEN 20018 END AS errno
  FROM cat_ddl_events e JOIN ix ON ix.index_name = obj_name
  WHERE obj_type = 'INDEX' AND NOT ddl_permitted),
te AS (SELECT e.*, recname, rectype, sfx, ps FROM cat_ddl_events e JOIN own ON own.t = obj_name
  WHERE obj_type = 'TABLE' AND NOT ddl_permitted
    AND (sysevent IN ('DROP', 'RENAME') OR upper(sql_text) LIKE '%ALTER%TABLE%RENAME%')
    AND NOT (ps = 1 AND rectype = 7 AND (
      upper(sql_text) LIKE concat('ALTER%TABLE%PS_', recname, sfx, '%RENAME%TO%GT_', recname, sfx, '_')
      OR upper(sql_text) LIKE concat('ALTER%TABLE%PS_', recname, sfx, '%RENAME%TO%XX_', recname, sfx, '_')))),
tv AS (SELECT te.event_id, CASE WHEN k.temporary = 'Y' THEN 20007 WHEN k.partitioned = 'YES' THEN 20008
    WHEN k.cluster_name IS NOT NULL THEN 20009 WHEN k.iot_type = 'IOT' THEN 20010
    WHEN EXISTS (SELECT 1 FROM ix WHERE ix.table_name = obj_name AND NOT declared
      AND NOT (third AND obj_name LIKE concat('PS_', te.recname))) THEN 20011
    WHEN EXISTS (SELECT 1 FROM ix WHERE ix.table_name = obj_name AND NOT declared_t AND expr
      AND NOT (third AND obj_name LIKE concat('PS_', te.recname, te.sfx))) THEN 20012
    WHEN EXISTS (SELECT 1 FROM cat_triggers g WHERE g.table_name = obj_name
      AND trigger_name <> concat('PSU', te.recname)) THEN 20013
    WHEN EXISTS (SELECT 1 FROM cat_constraints c WHERE c.table_name = obj_name
      AND c.index_name = concat('PS_', te.recname, te.sfx))
      AND EXISTS (SELECT 1 FROM cat_fields f WHERE f.recname = te.recname AND f.useedit % 2 = 1)
      AND NOT EXISTS (SELECT 1 FROM cat_fields f WHERE f.recname = te.recname AND f.useedit % 4 = 2)
      THEN 20014
    WHEN EXISTS (SELECT 1 FROM cat_mview_logs l WHERE l.master = obj_name) THEN 20015
    WHEN EXISTS (SELECT 1 FROM cat_mviews l WHERE l.mview_name = obj_name) THEN 20016
    WHEN EXISTS (SELECT 1 FROM cat_tables s WHERE s.temporary = 'Y'
      AND s.table_name = concat('GT', substr(obj_name, 3))) THEN 20017 END AS errno
  FROM te LEFT JOIN cat_tables k ON k.table_name = obj_name)
SELECT e.event_id, e.obj_name, CAST(v.errno AS BIGINT) AS errno FROM cat_ddl_events e
LEFT JOIN (SELECT * FROM iv UNION ALL SELECT * FROM tv) v USING (event_id)""")
def ddl_guard(events, named, indexes, fields, tables, table_indexes, expressions, triggers,
              constraints, mview_logs, mviews):
    """C17 with J14, P7."""
    facts = policy.SchemaFacts(
        records=named.select("recname", "rectype", F.col("table_name").alias("base_table"),
                             F.lit(9).alias("instances")),
        declared_indexes=indexes, key_fields=fields, tables=tables, indexes=table_indexes,
        expressions=expressions, triggers=triggers, constraints=constraints,
        mview_logs=mview_logs, mviews=mviews)
    return policy.ddl_guard(events, facts).select("event_id", "obj_name", big("errno"))


GROUPS = """
g0 AS (SELECT DISTINCT r1.oprid, r1.qryname FROM qry_records r1
  JOIN qry_records r2 ON r2.oprid = r1.oprid AND r2.qryname = r1.qryname
  JOIN qry_records r3 ON r3.oprid = r1.oprid AND r3.qryname = r1.qryname
  WHERE r1.corrname = 'A' AND r1.recname = 'ECONOMY' AND r2.corrname = 'B' AND r2.recname = 'LARGE'
    AND r3.corrname = 'C' AND r3.recname = 'PROMO'),
g AS (SELECT * FROM g0 WHERE (oprid, qryname) NOT IN (SELECT f.oprid, f.qryname FROM qry_fields f
  WHERE (f.recname <> ' ' OR f.fieldname <> ' ') AND NOT EXISTS (SELECT 1 FROM qry_records r
    WHERE r.oprid = f.oprid AND r.qryname = f.qryname AND r.recname = f.recname))),
l AS (SELECT r.*, CASE corrname WHEN 'A' THEN 3 WHEN 'B' THEN 2 WHEN 'C' THEN 1 END AS nr
  FROM qry_records r JOIN g USING (oprid, qryname)),
k AS (SELECT *, rank() OVER (PARTITION BY oprid, qryname ORDER BY selnum, nr NULLS LAST) AS rk FROM l)"""


def _reordered(records, fields):
    from opsight.operators.joins import find_groups_with_members
    groups = find_groups_with_members(records, ["oprid", "qryname"], [
        {"corrname": "A", "recname": "ECONOMY"}, {"corrname": "B", "recname": "LARGE"},
        {"corrname": "C", "recname": "PROMO"}])
    groups = policy.drop_corrupt_groups(groups, records, fields)
    return policy.reorder_members(groups, records, fields, {"A": 3, "B": 2, "C": 1})


@query("qry_records", "qry_fields", sql=f"""
WITH {GROUPS}
SELECT r.oprid, r.qryname, CAST(r.selnum AS BIGINT) AS selnum, r.recname,
  CASE WHEN g.qryname IS NULL THEN r.rcdnum ELSE k.nr END AS rcdnum,
  CASE WHEN g.qryname IS NULL THEN r.corrname WHEN rk <= 12 THEN chr(CAST(64 + rk AS INTEGER)) END
    AS corrname
FROM qry_records r LEFT JOIN g ON g.oprid = r.oprid AND g.qryname = r.qryname
LEFT JOIN k ON k.oprid = r.oprid AND k.qryname = r.qryname AND k.recname = r.recname
  AND k.selnum = r.selnum AND k.rcdnum = r.rcdnum""")
def reordered_records(records, fields):
    """C18 with J5, J15, J16, W11."""
    return _reordered(records, fields)[0].select(
        "oprid", "qryname", big("selnum"), "recname", big("rcdnum"), "corrname")


@query("qry_records", "qry_fields", sql=f"""
WITH {GROUPS}
SELECT f.oprid, f.qryname, f.fieldname, f.recname,
  CASE WHEN g.qryname IS NULL THEN f.fldrcdnum ELSE k.nr END AS fldrcdnum
FROM qry_fields f LEFT JOIN g ON g.oprid = f.oprid AND g.qryname = f.qryname
LEFT JOIN k ON k.oprid = f.oprid AND k.qryname = f.qryname AND k.recname = f.recname
  AND k.selnum = f.selnum AND k.rcdnum = f.fldrcdnum""")
def reordered_fields(records, fields):
    """The same on fields."""
    return _reordered(records, fields)[1].select(
        "oprid", "qryname", "fieldname", "recname", big("fldrcdnum"))
