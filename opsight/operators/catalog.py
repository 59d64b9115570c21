"""Declared versus actual catalog.

Declared side: records (recname, rectype, sqltablename, systemidfieldname),
fields (recname, fieldname, useedit, fieldnum, subrecname), field types
(fieldname, fieldtype, length, decimalpos, format), indexes (recname, indexid,
platform_ora, custkeyorder), keys (recname, indexid, keyposn, fieldname).
Actual side: objects (object_type, object_name), columns, index columns.
Names are joined by equality throughout, so many catalogs or snapshots can be
audited in one job by adding their id to the names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsight.functions.rules import has_flag, has_flag_unfloored
from opsight.functions.text import decode_codes
from opsight.operators.joins import prefix_name_join, scalar_cross
from opsight.operators.ranking import minus
from opsight.operators.scan import all_fit, ordered_scan, row_number
from opsight.session import written

TABLE, VIEW, SUBRECORD, QUERY_VIEW, TEMP_TABLE = 0, 1, 3, 6, 7  # record types: fixed values
BUILT_TYPES = (TABLE, VIEW, QUERY_VIEW, TEMP_TABLE)
OBJECT_TYPES = {TABLE: "TABLE", VIEW: "VIEW", QUERY_VIEW: "VIEW", TEMP_TABLE: "TABLE"}
RECORD_LABELS = {  # fixed values
    TABLE: "TABLE", VIEW: "VIEW", QUERY_VIEW: "QUERY VIEW", TEMP_TABLE: "TEMPORARY TABLE",
}
FIELD_LABELS = {  # fixed values
    0: "Character", 1: "Long Char", 2: "Number", 3: "Sign Num", 4: "Date", 5: "Time",
    6: "DateTime", 8: "Image", 9: "ImageRef",
}


def base_table_name(prefix: str = "PS_") -> Column:
    """The table of a record: its own name, or prefix and record name."""
    return F.when(
        F.col("sqltablename") == " ", F.concat(F.lit(prefix), F.col("recname"))
    ).otherwise(F.col("sqltablename"))


def with_base_table(records: DataFrame, prefix: str = "PS_") -> DataFrame:
    return records.withColumn("base_table", base_table_name(prefix))


def _built(records: DataFrame) -> DataFrame:
    """Records that exist in a database, with table name and object type."""
    return with_base_table(records.where(F.col("rectype").isin(list(BUILT_TYPES)))).withColumn(
        "object_type", decode_codes("rectype", OBJECT_TYPES)
    ).withColumn("rectype_desc", decode_codes("rectype", RECORD_LABELS))


def expand_subrecords(fields: DataFrame, records: DataFrame, max_depth: int = 20) -> DataFrame:
    """Fields with every reference to a sub-record replaced by its fields,
    nested ones too, renumbered in place. subrecname tells the record a field
    was taken from.

    Each round joins only the references that are left; a field's place is the
    path of positions that led to it. Fields and what a round found are written
    once, references apart, so that no round computes its input again.
    """
    subrecords = records.where(F.col("rectype") == SUBRECORD).select(
        F.col("recname").alias("_sub")
    ).distinct()

    def filed(rows: DataFrame) -> DataFrame:
        marked = rows.join(subrecords, F.col("fieldname") == F.col("_sub"), "left")
        return written(marked.withColumn("_ref", F.col("_sub").isNotNull().cast("int")).drop("_sub"),
                       "expanded-fields", ("_ref",))

    given = filed(fields.select("recname", "fieldname", "useedit", "fieldnum"))
    inner = given.select(
        F.col("recname").alias("_owner"), F.col("fieldname").alias("_field"),
        F.col("useedit").alias("_useedit"), F.col("fieldnum").alias("_num"),
    )
    current = given.select(
        "recname", "fieldname", "useedit", F.array("fieldnum").alias("_path"),
        F.col("recname").alias("subrecname"), "_ref",
    )
    finished = []
    for _ in range(max_depth):
        finished.append(current.where("_ref = 0"))
        references = current.where("_ref = 1")
        if references.isEmpty():
            break
        current = filed(
            references.join(inner, references["fieldname"] == inner["_owner"]).select(
                "recname", F.col("_field").alias("fieldname"), F.col("_useedit").alias("useedit"),
                F.concat("_path", F.array("_num")).alias("_path"),
                F.col("_owner").alias("subrecname"),
            )
        )
    else:
        if not current.isEmpty():
            raise ValueError(f"sub-records nested deeper than {max_depth}, or in a circle")
    rows = finished[0]
    for part in finished[1:]:
        rows = rows.unionByName(part)
    numbered = ordered_scan(rows, ["recname"], ["_path", "fieldname"], [row_number("fieldnum")],
                            known_bounded=all_fit(rows, ["recname"]))
    return numbered.select("recname", "fieldname", "useedit", "fieldnum", "subrecname")


def _is_long() -> Column:
    return (
        (F.col("fieldtype") == 1) & ~F.col("length").between(1, 2000)
    ) | (F.col("fieldtype") == 8)


def move_long_last(fields: DataFrame, field_types: DataFrame, records: DataFrame) -> DataFrame:
    """In tables, long and image columns come after all others."""
    typed = fields.join(
        field_types.select("fieldname", _is_long().alias("_long")), "fieldname", "left"
    ).join(records.select("recname", F.col("rectype").isin(TABLE, TEMP_TABLE).alias("_table")),
           "recname", "left")
    last = F.coalesce(F.col("_long") & F.col("_table"), F.lit(False)).cast("int")
    renumbered = ordered_scan(
        typed.withColumn("_last", last).withColumnRenamed("fieldnum", "_num"),
        ["recname"], ["_last", "_num", "fieldname"], [row_number("fieldnum")],
    )
    return renumbered.select(*fields.columns)


ALTERNATE_KEY = 16  # flag of alternate search keys: fixed value


def alternate_indexes(fields: DataFrame) -> DataFrame:
    """Alternate search keys with zero-based rank in the record and in the
    (sub-)record they come from. A two-digit rank does not fit the one-character
    id and shows as '##'. Fields per record are few, so plain windows serve."""
    alt = fields.where(has_flag_unfloored("useedit", ALTERNATE_KEY))

    def one_digit(window) -> Column:
        place = F.rank().over(window) - 1
        return F.when(place < 10, place.cast("string")).otherwise("##")

    return alt.select(
        "recname", one_digit(Window.partitionBy("recname").orderBy("fieldnum")).alias("indexid"),
        "subrecname",
        one_digit(Window.partitionBy("recname", "subrecname").orderBy("fieldnum")).alias(
            "subindexid"),
        "fieldname", "fieldnum",
    )


def derive_index_definitions(fields: DataFrame, indexes: DataFrame) -> DataFrame:
    """The indexes a record has, including those of its sub-records and of
    alternate search keys."""
    here = indexes.where(F.col("platform_ora") == 1).select(
        F.col("recname").alias("_rec"), F.col("indexid").alias("_id")
    )
    # a record has many fields of few origins
    origins = fields.select("recname", "subrecname").distinct()
    named = origins.join(
        here.where(~F.col("_id").between("0", "9")), F.col("subrecname") == F.col("_rec")
    ).select("recname", F.col("_id").alias("indexid"), F.col("recname").alias("subrecname"),
             F.col("_id").alias("subindexid")).distinct()
    alt = alternate_indexes(fields).where(F.col("indexid").between("0", "9"))
    alternates = alt.join(
        here, (F.col("subrecname") == F.col("_rec")) & (F.col("subindexid") == F.col("_id"))
    ).select("recname", "indexid", "subrecname", "subindexid").distinct()
    return named.unionByName(alternates)


def _declared_keys(fields, indexes, keys, definitions):
    """Key columns of the main ('_') and the lettered indexes with their rank, and the
    other columns of their definitions."""
    defs = definitions.where((F.col("indexid") == "_") | F.col("indexid").between("A", "Z"))
    custom = indexes.select(
        F.col("recname").alias("_ir"), F.col("indexid").alias("_ii"), "custkeyorder"
    )
    defs = defs.join(custom, (F.col("subrecname") == F.col("_ir")) & (
        F.col("subindexid") == F.col("_ii"))).drop("_ir", "_ii", "subrecname")
    columns = fields.select(
        F.col("recname").alias("_cr"), "fieldname", "fieldnum", F.col("subrecname").alias("_cs")
    )
    # fields that are keys first: only these meet the definitions
    found = columns.join(
        keys.select(F.col("recname").alias("_kr"), F.col("indexid").alias("_ki"),
                    F.col("fieldname").alias("_kf"), F.col("keyposn").alias("_kp")),
        (F.col("_cs") == F.col("_kr")) & (F.col("fieldname") == F.col("_kf")),
    ).join(defs, (F.col("_cr") == F.col("recname")) & (F.col("_ki") == F.col("subindexid")))
    per_index = Window.partitionBy("recname", "indexid")
    by_key = (F.col("indexid") != "_") | (F.col("custkeyorder") == 1)
    order = F.when(by_key, F.col("_kp")).otherwise(F.col("fieldnum"))
    others = [c for c in definitions.columns if c not in ("recname", "indexid", "subrecname", "subindexid")]
    return found.select(
        "recname", "indexid", F.rank().over(per_index.orderBy(order)).alias("keyposn"),
        "fieldname", F.rank().over(per_index.orderBy("fieldnum")).alias("fieldposn"), *others,
    )


def key_positions(
    fields: DataFrame, indexes: DataFrame, keys: DataFrame, definitions: DataFrame
) -> DataFrame:
    """The columns of every index in order (recname, indexid, keyposn, fieldname).

    An alternate key's index leads with its field, followed by the main key.
    Indexes with a custom key order take their positions from the declaration.

    What is known per index - its custom order, and for the main key the record's
    alternate indexes - is put to the definitions, so that key columns are ranked once.
    Definitions and alternate keys are read several times, so both are written first.
    """
    definitions = written(definitions, "index-definitions")
    custom = definitions.select("recname", "indexid").join(
        indexes.where(F.col("custkeyorder") == 1).select("recname", "indexid"),
        ["recname", "indexid"],
    ).distinct().withColumn("_custom", F.lit(True))
    alt = alternate_indexes(fields).select("recname", "indexid", "fieldname")
    alt = written(alt.join(custom, ["recname", "indexid"], "left"), "alternate-keys")
    # as many as a record has alternate keys
    behind = alt.groupBy(F.col("recname").alias("_ar")).agg(
        F.collect_list(F.struct("indexid", "_custom")).alias("_alts"))
    defs = definitions.join(custom, ["recname", "indexid"], "left")
    defs = defs.join(behind, (F.col("recname") == F.col("_ar")) & (F.col("indexid") == "_"), "left").drop("_ar")
    declared = _declared_keys(fields, indexes, keys, defs)
    own = F.array(F.struct("indexid", "_custom", F.col("keyposn").cast("int").alias("keyposn")))
    following = F.transform("_alts", lambda a: F.struct(
        a["indexid"].alias("indexid"), a["_custom"].alias("_custom"), (F.col("fieldposn") + 1).alias("keyposn")))
    rows = declared.select("recname", "fieldname", F.inline(F.when(
        F.col("_alts").isNull(), own).otherwise(F.concat(own, following))))
    leading = alt.select("recname", "fieldname", "indexid", "_custom", F.lit(1).alias("keyposn"))
    rows = rows.unionByName(leading)
    override = keys.select("recname", "indexid", "fieldname", F.col("keyposn").alias("_declared"))
    return rows.join(override, ["recname", "indexid", "fieldname"], "left").select(
        "recname", "indexid",
        F.when(F.col("_custom"), F.col("_declared")).otherwise(F.col("keyposn")).cast("long")
        .alias("keyposn"), "fieldname",
    )


def missing_objects(records: DataFrame, objects: DataFrame) -> DataFrame:
    """Declared records without a table or view."""
    built = _built(records).withColumn("object_name", F.col("base_table"))
    return built.join(objects, ["object_type", "object_name"], "left_anti").select(
        "rectype_desc", "recname", "sqltablename"
    )


def undeclared_objects(records: DataFrame, objects: DataFrame) -> DataFrame:
    """Tables and views without a record, temporary-table instances aside."""
    have = objects.select("object_type", "object_name")
    declared = _built(records).select("object_type", F.col("base_table").alias("object_name"))
    temp = with_base_table(records.where(F.col("rectype") == TEMP_TABLE)).select("base_table")
    tables = objects.where(F.col("object_type") == "TABLE").select("object_name")
    instances = prefix_name_join(tables, temp).select(
        F.lit("TABLE").alias("object_type"), "object_name"
    )
    return minus(have, declared, instances)


def excess_temp_instances(
    records: DataFrame, objects: DataFrame, instances: DataFrame, settings: DataFrame
) -> DataFrame:
    """Instance tables beyond the record's own number plus the global one."""
    temp = with_base_table(records.where(F.col("rectype") == TEMP_TABLE)).select(
        "recname", "base_table"
    )
    own = instances.select("recname", F.col("temptblinstances").alias("_own"))
    allowed = scalar_cross(
        temp.join(own, "recname", "left"), settings.select(
            F.col("temptblinstances").alias("_global"))
    ).select("recname", "base_table",
             (F.coalesce("_own", F.lit(0)) + F.col("_global")).alias("temptblinstances"))
    tables = objects.where(F.col("object_type") == "TABLE").select("object_name")
    found = prefix_name_join(tables, allowed, upto="9999")
    return found.where(F.col("instance") > F.col("temptblinstances")).select(
        "recname", F.col("object_name").alias("table_name"), "temptblinstances"
    )


def column_count_mismatch(records: DataFrame, fields: DataFrame, columns: DataFrame) -> DataFrame:
    """C4: another number of columns than declared."""
    declared = fields.groupBy("recname").agg(F.count(F.lit(1)).alias("pscols"))
    actual = columns.groupBy("table_name").agg(F.count(F.lit(1)).alias("dbcols"))
    return (
        _built(records).join(declared, "recname")
        .join(actual, F.col("base_table") == F.col("table_name"))
        .where(F.col("pscols") != F.col("dbcols"))
        .select("recname", "table_name", "pscols", "dbcols")
    )


def _existing(records: DataFrame, objects: DataFrame) -> DataFrame:
    built = _built(records).withColumn("object_name", F.col("base_table"))
    return built.join(objects, ["object_type", "object_name"], "left_semi")


def missing_columns(
    records: DataFrame, objects: DataFrame, fields: DataFrame, columns: DataFrame
) -> DataFrame:
    """Declared columns an existing table lacks."""
    declared = fields.select("recname", "fieldname").join(_existing(records, objects), "recname")
    actual = columns.select(F.col("table_name").alias("_t"), F.col("column_name").alias("_c"))
    lacks = declared.join(
        actual, (F.col("base_table") == F.col("_t")) & (F.col("fieldname") == F.col("_c")),
        "left_anti",
    )
    return lacks.select("rectype_desc", "recname", "fieldname", "sqltablename")


def undeclared_columns(
    records: DataFrame, objects: DataFrame, fields: DataFrame, columns: DataFrame
) -> DataFrame:
    """Columns of a record's table that are not declared."""
    actual = columns.join(_built(records), F.col("table_name") == F.col("base_table")).select(
        "rectype_desc", "recname", "column_name", "sqltablename"
    )
    declared = fields.select("recname", "fieldname").join(
        _existing(records, objects), "recname"
    ).select("rectype_desc", "recname", F.col("fieldname").alias("column_name"), "sqltablename")
    return minus(actual, declared)


REQUIRED = 256  # flag of required fields: fixed value
SYSTEM_ID_EXEMPT = ("PSSYSTEMID", "PTUPDSYSTEMID")  # record and field: fixed values


def _definition_rules(exempt_system_ids: bool, unfloored: bool) -> Mapping[str, Column]:
    kind, actual = F.col("fieldtype"), F.col("data_type")
    required = (has_flag_unfloored if unfloored else has_flag)("useedit", REQUIRED)
    nullable = F.col("nullable") == "Y"
    plain = kind.isin(0, 2, 3) & nullable
    if exempt_system_ids:
        is_system_id = F.coalesce(F.col("fieldname") == F.col("systemidfieldname"), F.lit(False)) | (
            (F.col("recname") == SYSTEM_ID_EXEMPT[0]) & (F.col("fieldname") == SYSTEM_ID_EXEMPT[1])
        )
        plain = plain & ~is_system_id
    short = F.col("length").between(1, 2000)

    def number(sign: int) -> Column:
        fits = (
            (actual == "NUMBER") & (F.col("data_scale") == F.col("decimalpos"))
            & ((F.col("data_precision") + sign == F.col("length")) | (F.col("data_scale") == 0))
        )
        return ~fits

    return {
        "required but nullable": required & nullable,
        "plain type but nullable": plain,
        "length": (actual == "VARCHAR2") & (kind == 0) & (
            F.col("data_length")
            != F.least(F.lit(4000), F.col("length") * F.col("unicode_factor"))
        ),
        "short long": (kind == 1) & short & (actual != "VARCHAR2"),
        "long": (kind == 1) & ~short & (F.col("format") == 0) & (actual != "LONG"),
        "raw long": (kind == 1) & (F.col("format") == 7) & (actual != "LONG RAW"),
        "number": (kind == 2) & number(1),
        "signed number": (kind == 3) & number(2),
        "date": kind.isin(4, 5, 6) & (actual != "DATE"),
        "image": (kind == 8) & (actual != "LONG RAW"),
        "image reference": (kind == 9) & ~((actual == "VARCHAR2") & (F.col("data_length") == 30)),
    }


def definition_mismatch(
    records: DataFrame, fields: DataFrame, field_types: DataFrame, columns: DataFrame,
    settings: DataFrame, unfloored_flags: bool = True,
) -> DataFrame:
    """Columns whose type, length, precision, scale or nullability differs
    from the declaration, with all reasons.

    settings is one row (unicode_enabled, toolsrel). System-id columns may be
    nullable from release 8.4 on. The flag test is the un-floored one unless
    unfloored_flags is off. (The older release's rebuild list has the exemption
    inverted; here report and rebuild list use the same rows.)
    """
    declared = fields.select("recname", "fieldname", "useedit").join(field_types, "fieldname")
    tables = with_base_table(records.where(F.col("rectype").isin(TABLE, TEMP_TABLE)))
    joined = declared.join(tables, "recname").join(
        columns,
        (F.col("base_table") == F.col("table_name")) & (F.col("fieldname") == F.col("column_name")),
    )
    status = settings.select(
        F.when(F.col("unicode_enabled") == 1, 3).otherwise(1).alias("unicode_factor"),
        (F.col("toolsrel").try_cast("double") >= 8.4).alias("_recent"),
    )
    joined = scalar_cross(joined, status)

    def reasons(exempt: bool) -> Column:
        marks = [F.when(cond, F.lit(name)) for name, cond in
                 _definition_rules(exempt, unfloored_flags).items()]
        return F.array_compact(F.array(*marks))

    checked = joined.withColumn(
        "reasons", F.when(F.col("_recent"), reasons(True)).otherwise(reasons(False))
    )
    return checked.where(F.size("reasons") > 0).select(
        decode_codes("rectype", {TABLE: "TABLE", TEMP_TABLE: "TEMP TABLE"}).alias("rectype_desc"),
        "recname", "column_name", "sqltablename", "data_type", "data_length", "data_precision",
        "data_scale", "nullable", decode_codes("fieldtype", FIELD_LABELS).alias("fieldtype_desc"),
        "length", "decimalpos", "reasons",
    )


def undefined_fields(records: DataFrame, raw_fields: DataFrame, field_types: DataFrame) -> DataFrame:
    """Fields that are neither defined nor a sub-record."""
    known = field_types.select("fieldname").unionByName(
        records.where(F.col("rectype") == SUBRECORD).select(F.col("recname").alias("fieldname"))
    )
    owners = records.where(F.col("rectype") != SUBRECORD).select("recname")
    return raw_fields.join(owners, "recname").join(known, "fieldname", "left_anti").select(
        "recname", "fieldname"
    )


def column_position_mismatch(
    records: DataFrame, fields: DataFrame, field_types: DataFrame, columns: DataFrame
) -> DataFrame:
    """Columns in another place though the numbers of columns agree."""
    declared = fields.groupBy("recname").agg(F.count(F.lit(1)).alias("_ps"))
    actual = columns.groupBy(F.col("table_name").alias("_t")).agg(F.count(F.lit(1)).alias("_db"))
    same = _built(records).join(declared, "recname").join(
        actual, F.col("base_table") == F.col("_t")
    ).where(F.col("_ps") == F.col("_db"))
    known = fields.join(field_types.select("fieldname"), "fieldname", "left_semi")
    return (
        known.join(same, "recname")
        .join(columns, (F.col("base_table") == F.col("table_name"))
              & (F.col("fieldname") == F.col("column_name")))
        .where(F.col("column_id") != F.col("fieldnum"))
        .select("rectype_desc", "recname", "column_name", "sqltablename", "column_id", "fieldnum")
    )


def _index_name() -> Column:
    return F.concat(F.lit("PS"), F.col("indexid"), F.col("recname"))


def index_count_mismatch(
    records: DataFrame, positions: DataFrame, index_columns: DataFrame
) -> DataFrame:
    """Indexes with another number of columns than declared."""
    declared = positions.groupBy("recname", "indexid").agg(F.count(F.lit(1)).alias("pscols"))
    actual = index_columns.groupBy("table_name", "index_name").agg(
        F.count(F.lit(1)).alias("dbcols")
    )
    named = declared.join(with_base_table(records), "recname").withColumn("_index", _index_name())
    return named.join(
        actual, (F.col("base_table") == F.col("table_name")) & (F.col("_index") == F.col("index_name"))
    ).where(F.col("pscols") != F.col("dbcols")).select(
        "recname", "indexid", "table_name", "index_name", "dbcols", "pscols"
    )


def index_position_mismatch(
    records: DataFrame, positions: DataFrame, index_columns: DataFrame
) -> DataFrame:
    """C11: index columns in another position than declared. Actual columns, the fewer
    rows, are given their records first, so that declared ones are shuffled once."""
    owners = with_base_table(records).select(F.col("recname").alias("_owner"), "base_table")
    actual = index_columns.join(owners, F.col("base_table") == F.col("table_name"))
    return positions.withColumn("_index", _index_name()).join(
        actual,
        (F.col("recname") == F.col("_owner")) & (F.col("_index") == F.col("index_name"))
        & (F.col("fieldname") == F.col("column_name")),
    ).where(F.col("keyposn") != F.col("column_position")).select(
        "recname", "indexid", "fieldname", "keyposn", "column_position"
    )


KEY, DUPLICATE_KEY = 1, 2  # flags of key fields: fixed values


def keys_not_first(
    records: DataFrame, fields: DataFrame, tables: DataFrame | None = None, enabled: bool = False
) -> DataFrame:
    """Key fields that follow a non-key field. Off unless enabled, as the
    standard it checks was given up. Neighbours are joined by position."""
    is_key = has_flag_unfloored("useedit", DUPLICATE_KEY) | has_flag("useedit", KEY)
    owners = records.where(F.col("rectype").isin(TABLE, TEMP_TABLE))
    marked = fields.select("recname", "fieldname", "fieldnum", "useedit", is_key.alias("_key"))
    before = marked.where(~F.col("_key")).select(
        F.col("recname").alias("_r"), (F.col("fieldnum") + 1).alias("_n")
    )
    late = marked.where(F.col("_key")).join(
        before, (F.col("recname") == F.col("_r")) & (F.col("fieldnum") == F.col("_n"))
    )
    named = with_base_table(owners.select("recname", "rectype", "sqltablename"))
    out = late.join(named, "recname").where(F.lit(enabled))
    out = out.withColumn(
        "rectype_desc", decode_codes("rectype", {TABLE: "TABLE", TEMP_TABLE: "TEMP TABLE"})
    ).withColumn("keytype", F.when(has_flag_unfloored("useedit", DUPLICATE_KEY), "Duplicate")
                 .otherwise("Unique"))
    if tables is None:
        return out.select("rectype_desc", "recname", "fieldnum", "fieldname", "keytype")
    lengths = tables.select(F.col("table_name").alias("_t"),
                            F.nullif(F.col("avg_row_len"), F.lit(0)).alias("avg_row_len"))
    return out.join(lengths, F.col("base_table") == F.col("_t"), "left").select(
        "rectype_desc", "recname", "fieldnum", "fieldname", "keytype", "avg_row_len"
    )


def rebuild_list(
    record_offenders: list[DataFrame], index_offenders: list[DataFrame], records: DataFrame,
    tables: DataFrame,
) -> DataFrame:
    """What to rebuild, as project items: object type 0 per record and 1
    per index. Records whose table has no tablespace (temporary or partitioned)
    are left out.

    Each audit is run by itself and its distinct offenders are written: a plan of all
    audits together takes the driver longer, and more memory, than the rows take the
    executors.
    """
    found = None
    parts = [part.select("recname", F.lit(None).cast("string").alias("indexid")) for part in record_offenders]
    parts += [part.select("recname", "indexid") for part in index_offenders]
    for part in parts:
        rows = written(part.distinct(), "offenders")
        found = rows if found is None else found.unionByName(rows)
    placeless = with_base_table(records.where(F.col("rectype").isin(TABLE, TEMP_TABLE))).join(
        tables.where(F.col("tablespace_name").isNull()).select("table_name"),
        F.col("base_table") == F.col("table_name"),
    ).select("recname")
    left = found.distinct().join(placeless, "recname", "left_anti")
    items = left.select(F.lit(0).alias("object_type"), "recname",
                        F.lit(" ").alias("indexid")).distinct()
    return items.unionByName(
        left.where(F.col("indexid").isNotNull())
        .select(F.lit(1).alias("object_type"), "recname", "indexid")
    )


def placement_drift(records: DataFrame, placements: DataFrame, tables: DataFrame) -> DataFrame:
    """C14: tables in another tablespace than declared. new_ddlspacename is the
    actual one, the value an update of the declaration should write (the
    original update writes the old value back)."""
    return (
        with_base_table(records.where(F.col("rectype").isin(TABLE, TEMP_TABLE)))
        .join(placements, "recname")
        .join(tables, F.col("base_table") == F.col("table_name"))
        .where(F.col("tablespace_name") != F.col("ddlspacename"))
        .select("recname", "ddlspacename", "table_name",
                F.col("tablespace_name").alias("new_ddlspacename"))
    )
