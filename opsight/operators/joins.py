"""Joins (J1-J19): star and label look-ups, as-of, interval, pattern and prefix
joins, and concurrency counting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from opsight.functions.timegrid import to_seconds
from opsight.operators.intervals import match_points, shift_right
from opsight.operators.scan import group_row_limit, last_before, null_safe, ordered_scan, row_number, running_sum
from opsight.session import stable


def star_join(
    samples: DataFrame, agents: DataFrame, systems: DataFrame, definitions: DataFrame,
    dbnames: Sequence[str] | None = None,
) -> DataFrame:
    """Samples with their agent, system and event definition. The filter on
    the system applies to the small side before samples are touched."""
    if dbnames is not None:
        systems = systems.where(F.col("dbname").isin(list(dbnames)))
    hosts = agents.join(systems, "pm_systemid")
    return samples.join(hosts, "pm_agentid").join(
        definitions, ["pm_event_defn_set", "pm_event_defn_id"]
    )


def with_metric_labels(
    definitions: DataFrame, metrics: DataFrame, key: Sequence[str], n: int = 7,
    id_prefix: str = "pm_metricid_", attributes: Sequence[str] = ("pm_metriclabel",),
) -> DataFrame:
    """The attributes of up to n metric ids of a definition, as numbered columns.

    Ids are unpivoted, joined once and pivoted back. This runs on definitions,
    so the samples need one join instead of n.
    """
    slots = F.array(*[F.col(f"{id_prefix}{i}") for i in range(1, n + 1)])
    long = definitions.select(*key, F.posexplode(slots).alias("_pos", "pm_metricid"))
    long = long.join(metrics.select("pm_metricid", *attributes), "pm_metricid", "left")
    wide = long.groupBy(*key).agg(
        *[F.max(F.when(F.col("_pos") == i, F.col(a))).alias(f"{a}{i + 1}")
          for i in range(n) for a in attributes]
    )
    return definitions.join(wide, list(key), "left")


def translate_labels(
    metrics: DataFrame, translate: DataFrame, fieldname: str = "PM_METRICTYPE",
    code: str = "pm_metrictype", label: str = "pm_metrictype_text",
) -> DataFrame:
    """Code -> text through the translate table; the constant half of its
    key is a filter before the join."""
    texts = translate.where(F.col("fieldname") == fieldname).select(
        F.col("fieldvalue").alias(code), F.col("xlatlongname").alias(label)
    )
    return metrics.join(texts, code, "left")


def transaction_detail(
    transactions: DataFrame, agents: DataFrame, systems: DataFrame, definitions: DataFrame,
    metrics: DataFrame, contexts: DataFrame, top_instance=None,
) -> DataFrame:
    """Transactions (of one tree, if its top is given) with host, definition,
    metric labels and three context labels."""
    if top_instance is not None:
        transactions = transactions.where(F.col("pm_top_inst_id") == top_instance)
    key = ["pm_trans_defn_set", "pm_trans_defn_id"]
    labelled = with_metric_labels(definitions, metrics, key)
    hosts = agents.join(systems, "pm_systemid")
    out = transactions.join(hosts, "pm_agentid").join(labelled, key)
    names = contexts.select("pm_contextid", "pm_contextlabel")
    for i in (1, 2, 3):
        ctx = names.select(F.col("pm_contextid").alias(f"pm_contextid_{i}"),
                           F.col("pm_contextlabel").alias(f"pm_contextlabel{i}"))
        out = out.join(ctx, f"pm_contextid_{i}", "left")
    return out


def find_groups_with_members(
    df: DataFrame, group: Sequence[str], wanted: Sequence[Mapping[str, object]]
) -> DataFrame:
    """Groups having, for every wanted entry, a row with its column values.

    One pass with a flag per entry instead of one self-join per entry; flags
    combine before the shuffle, so group size does not matter.
    """
    flags, any_hit = [], F.lit(False)
    for entry in wanted:
        hit = F.lit(True)
        for column, value in entry.items():
            hit = hit & (F.col(column) == F.lit(value))
        flags.append(hit)
        any_hit = any_hit | hit
    found = df.where(any_hit).groupBy(*group).agg(
        *[F.max(F.coalesce(f, F.lit(False))).alias(f"_f{i}") for i, f in enumerate(flags)]
    )
    everything = F.lit(True)
    for i in range(len(flags)):
        everything = everything & F.col(f"_f{i}")
    return found.where(everything).select(*group)


def semi_join(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key tuple is in other."""
    return df.join(other, list(on), "left_semi")


def anti_join(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key tuple is not in other (NOT EXISTS: NULL keys stay)."""
    return df.join(other, list(on), "left_anti")


def scalar_cross(df: DataFrame, settings: DataFrame) -> DataFrame:
    """The one settings row beside every row. More than one row is an error,
    not a product."""
    one = settings.limit(2).agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in settings.columns]
    )
    checked = one.where(
        F.when(F.col("_n") > 1, F.raise_error(F.lit("settings has several rows")).cast("boolean"))
        .otherwise(F.col("_n") == 1)
    ).drop("_n")
    return df.crossJoin(F.broadcast(checked))


def left_join_after_topn(top: DataFrame, definitions: DataFrame, on: Sequence[str]) -> DataFrame:
    """Names for rows that survived a top-n; the small side leads."""
    return top.join(definitions, list(on), "left")


def session_sample_snapshot_join(samples: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Samples with the snapshot they belong to."""
    return samples.join(
        snapshots, ["snap_id", "dbid", "instance_number"]
    )


def interval_join(
    points: DataFrame, intervals: DataFrame, on: Sequence[tuple[str, str]], ts: str,
    begin: str, end: str, as_of=None,
) -> DataFrame:
    """Points with the intervals of the same key that contain them.

    Intervals are filed by length class, see `intervals.match_points`, so a busy key is
    spread over its cells and long intervals are not copied along their length. An open
    end counts as as_of.
    """
    stop = F.col(end) if as_of is None else F.coalesce(
        F.col(end).cast("timestamp"), F.lit(as_of).cast("timestamp")
    )
    second = lambda c: to_seconds(c).cast("long")
    closed = intervals.withColumn("_stop", stop)
    return match_points(
        points, closed, on, [ts], second(ts), second(begin), second("_stop"),
        lambda own: own(ts).between(F.col(begin), F.col("_stop")),
    ).drop("_stop")


def sample_interval_join(
    samples: DataFrame, snapshots: DataFrame, processes: DataFrame, as_of, exact_tag: bool = False,
) -> DataFrame:
    """Session samples taken while a process ran, whose action names it.

    The tag test 'PI=<instance>%' also accepts longer instance numbers (PI=1
    takes PI=12); exact_tag asks for the number itself. Either way the instance
    is part of the join key: a sample is keyed by its number, or by each prefix
    of it.
    """
    with_snap = session_sample_snapshot_join(samples, snapshots)
    number = F.regexp_extract("action", r"^PI=([0-9]+)", 1)
    if exact_tag:
        named = with_snap.withColumn("_tag", number).where(
            F.col("action").rlike(r"^PI=[0-9]+(:|$)")
        )
    else:
        prefixes = F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1))),
            lambda n: F.substr(number, F.lit(1), n),
        )
        named = with_snap.withColumn("_tag", F.explode(prefixes))
    named = named.where(F.col("_tag") != "")
    tagged = processes.withColumn("_instance", F.col("prcsinstance").cast("string"))
    hits = interval_join(
        named, tagged, [("module", "prcsname"), ("_tag", "_instance")], "sample_time",
        "begindttm", "enddttm", as_of,
    )
    finish = F.coalesce(F.col("enddttm").cast("timestamp"), F.lit(as_of).cast("timestamp"))
    overlap = (F.col("end_interval_time") >= F.col("begindttm")) & (
        F.col("begin_interval_time") <= finish
    )
    return hits.where(overlap).drop("_tag", "_instance")


GRAM = 3
_LITERAL = r"(?:[^%_\\]|\\.)"  # of a LIKE pattern; '\' escapes


def _literal(run: Column) -> Column:
    return F.regexp_replace(run, r"\\(.)", "$1")


def _grams(value: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(value) - (GRAM - 1))
    grams = F.transform(places, lambda i: F.concat(F.lit("g:"), F.substr(value, i, F.lit(GRAM))))
    return F.when(F.length(value) >= GRAM, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def _prefix_key(value: Column, n: Column) -> Column:
    return F.concat(F.lit("p"), n.cast("string"), F.lit(":"), F.substr(value, F.lit(1), n))


def like_join(
    df: DataFrame, patterns: DataFrame, pairs: Sequence[tuple[str, str]], salts: int = 32,
    how: str = "inner", hot_texts: int = 200_000,
) -> DataFrame:
    """Rows with every pattern row whose LIKE patterns they match. pairs is
    [(text column, pattern column), ...], the first one gives the join key.

    LIKE alone is a nested loop. The key of a pattern is its literal prefix if that
    has three characters or more; else the three characters of its longest literal
    run that the fewest texts hold; else a shorter prefix. Texts are keyed by their
    prefixes of the lengths that occur and by all their three characters that are
    asked for, and LIKE is tested on pairs that share the key. Only patterns without
    any of these meet all texts. A key with more than hot_texts texts is dealt by
    salt, as are the texts of patterns without a key. Distinct texts and patterns
    meet; other columns are joined to the matches. how='left_patterns' also keeps
    patterns without a match.
    """
    text, pattern = F.col(f"_t_{pairs[0][0]}"), F.col(f"_p_{pairs[0][1]}")
    text_columns, pattern_columns = (list(dict.fromkeys(side)) for side in zip(*pairs, strict=True))
    texts = df.select(*[F.col(c).alias(f"_t_{c}") for c in text_columns]).na.drop().distinct()
    wanted = patterns.select(*[F.col(c).alias(f"_p_{c}") for c in pattern_columns]).na.drop().distinct()
    wanted = wanted.withColumn("_prefix", _literal(F.regexp_extract(pattern, f"^{_LITERAL}*", 0)))
    runs = F.transform(F.regexp_extract_all(pattern, F.lit(f"{_LITERAL}+"), F.lit(0)), _literal)
    longest = F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))))
    wanted = wanted.withColumn("_run", F.coalesce(longest["run"], F.lit("")))
    size = F.length("_prefix")
    by_prefix = (size >= GRAM) | ((size > 0) & (F.length("_run") < GRAM))
    keys = F.when(by_prefix, F.array(_prefix_key(F.col("_prefix"), size))).when(
        F.length("_run") >= GRAM, _grams(F.col("_run"))).otherwise(F.array(F.lit("all")))
    wanted = wanted.withColumn("_size", F.when(by_prefix, size)).withColumn("_keys", keys)
    names = [f"_p_{c}" for c in pattern_columns]
    candidates = wanted.select(*names, F.explode("_keys").alias("_key"))
    # as many lengths as the longest pattern has characters, at most
    asked = wanted.agg(
        F.coalesce(F.collect_set("_size"), F.array().cast("array<int>")).alias("sizes"),
        F.coalesce(F.bool_or(F.startswith(F.col("_keys")[0], F.lit("g:"))), F.lit(False)).alias("grams"),
    ).select(F.struct("sizes", "grams")).scalar()
    held = texts.withColumn("_asked", asked)
    prefixes = F.transform(F.filter("_asked.sizes", lambda n: n <= F.length(text)), lambda n: _prefix_key(text, n))
    grams = F.when(F.col("_asked.grams"), _grams(text)).otherwise(F.array().cast("array<string>"))
    held = held.withColumn("_key", F.explode(F.concat(prefixes, grams, F.array(F.lit("all"))))).drop("_asked")
    held = held.join(candidates.select("_key").distinct(), "_key", "left_semi")
    counts = held.groupBy(F.col("_key").alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    rated = candidates.join(counts, candidates["_key"] == counts["_k"], "left")
    # a pattern one of whose grams no text holds matches nothing
    chosen = rated.groupBy(*names).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_key").alias("key"))).alias("_c"))
    parts = F.when(F.col("_c.key") == "all", F.lit(salts)).otherwise(F.ceil(F.col("_c.n") / hot_texts)).cast("int")
    chosen = chosen.where("_c.n > 0").select(*names, F.col("_c.key").alias("_ckey"), parts.alias("_salts"))
    dealt = chosen.select(F.col("_ckey").alias("_dkey"), "_salts").distinct()
    met = held.join(dealt, held["_key"] == dealt["_dkey"]).withColumn(
        "_salt", F.pmod(F.xxhash64(*[f"_t_{c}" for c in text_columns]), F.col("_salts")).cast("int")).drop("_salts", "_dkey")
    chosen = chosen.withColumn("_csalt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    cond = (met["_key"] == chosen["_ckey"]) & (met["_salt"] == chosen["_csalt"])
    for t, p in pairs:
        cond = cond & F.expr(f"`_t_{t}` LIKE `_p_{p}`")
    matched = met.join(chosen, cond).select(*[f"_t_{c}" for c in text_columns], *names)
    same = F.lit(True)
    for c in text_columns:
        same = same & (df[c] == matched[f"_t_{c}"])
    found = df.join(matched, same).select(*df.columns, *names)
    same = F.lit(True)
    for c in pattern_columns:
        same = same & (found[f"_p_{c}"] == patterns[c])
    if how == "inner":
        return found.join(patterns, same).select(*df.columns, *patterns.columns)
    return patterns.join(found, same, "left").select(*df.columns, *patterns.columns)


def asof_join(
    df: DataFrame, other: DataFrame, keys: Sequence[str], ts: str, other_ts: str,
    carry: Sequence[str], tie: Sequence[str] = (), max_group_rows: int | None = None,
) -> DataFrame:
    """Each row with the latest row of `other` at or before its time.

    Both sides go into one ordered scan; nothing is paired, and long groups are
    cut into chunks by the scan.
    """
    right = other.select(
        *keys, F.col(other_ts).alias("_ts"), F.lit(0).alias("_kind"),
        F.struct(F.col(other_ts), *carry).alias("_right"),
    )
    left = df.withColumn("_ts", F.col(ts)).withColumn("_kind", F.lit(1))
    both = left.unionByName(right, allowMissingColumns=True)
    scanned = ordered_scan(
        both, keys, ["_ts", "_kind", *tie], [last_before("_match", "_right")], max_group_rows
    )
    return scanned.where(F.col("_kind") == 1).select(
        *df.columns, F.col(f"_match.{other_ts}").alias(other_ts),
        *[F.col(f"_match.{c}").alias(c) for c in carry],
    )


def effective_dated_lookup(
    df: DataFrame, dated: DataFrame, code: str, as_of, label: str = "xlatshortname",
    value: str = "fieldvalue", effdt: str = "effdt", status: str = "eff_status",
    name: str = "label",
) -> DataFrame:
    """The label of the latest entry at or before as_of, which then has to
    be active ('A'); otherwise 'Status:' and the code. as_of is a date or the
    name of a column of df."""
    missing = F.concat(F.lit("Status:"), F.col(code).cast("string"))
    if isinstance(as_of, str) and as_of in df.columns:
        entries = dated.select(F.col(value).alias(code), effdt, status, label)
        found = asof_join(df, entries, [code], as_of, effdt, [status, label], df.columns)
        found = found.withColumn(
            name, F.coalesce(F.when(F.col(status) == "A", F.col(label)), missing)
        )
        return found.select(*df.columns, name)
    known = dated.where(F.col(effdt) <= F.lit(as_of).cast("timestamp")).groupBy(
        F.col(value).alias("_code")
    ).agg(F.max_by(F.struct(status, label), effdt).alias("_e"))
    active = known.where(F.col(f"_e.{status}") == "A").select(
        "_code", F.col(f"_e.{label}").alias("_label")
    )
    return df.join(active, df[code] == active["_code"], "left").select(
        *df.columns, F.coalesce("_label", missing).alias(name)
    )


def _position(df: DataFrame, name: str) -> Column:
    """A long that never falls as the column rises: the integer part of a number, the
    microseconds of a time."""
    kind = dict(df.dtypes)[name]
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.floor(F.col(name)).cast("long")


def _assign_texts(df, ranges, value, low, high, max_group_rows):
    """`range_assign` of texts, by their places among all distinct texts of both sides.

    A place is a running number over the texts in order, so it does not matter how many
    texts begin alike.
    """
    texts = df.select(F.col(value).alias("_t")).unionByName(ranges.select(F.col(low).alias("_t"))).unionByName(
        ranges.select(F.col(high).alias("_t"))).where("_t IS NOT NULL").distinct()
    places = stable(ordered_scan(texts, [], ["_t"], [row_number("_at")], max_group_rows))
    place = lambda name: places.select(F.col("_t").alias(f"_t{name}"), F.col("_at").alias(f"_at{name}"))
    bounds = ranges.join(place("_lo"), F.col(low) == F.col("_t_lo")).join(place("_hi"), F.col(high) == F.col("_t_hi"))
    points = df.join(place("_p"), F.col(value) == F.col("_t_p"))
    return match_points(
        points, bounds, [], ["_at_p"], F.col("_at_p"), F.col("_at_lo"), F.col("_at_hi"), lambda own: F.lit(True))


def range_assign(
    df: DataFrame, ranges: DataFrame, value: str, low: str, high: str, max_group_rows: int | None = None,
) -> DataFrame:
    """Rows with all ranges [low, high] that contain their value; ranges may overlap.

    Ranges are filed by length class, see `intervals.match_points`. Values finer than
    `_position` are compared after that; texts get their place in the order of all.
    """
    named = ranges.where(F.col(low) <= F.col(high)).select(*[F.col(c).alias(f"_r_{c}") for c in ranges.columns])
    if dict(df.dtypes)[value] == dict(named.dtypes)[f"_r_{low}"] == dict(named.dtypes)[f"_r_{high}"] == "string":
        met = _assign_texts(df, named, value, f"_r_{low}", f"_r_{high}", max_group_rows)
    else:
        met = match_points(
            df, named, [], [value], _position(df, value), _position(named, f"_r_{low}"), _position(named, f"_r_{high}"),
            lambda own: own(value).between(F.col(f"_r_{low}"), F.col(f"_r_{high}")),
        )
    return met.select(*df.columns, *[F.col(f"_r_{c}").alias(c) for c in ranges.columns])


def asof_parent(
    df: DataFrame, session: Sequence[str] = ("database", "program", "pid", "line_id", "cursor"),
    line: str = "line_num", operation: str = "operation", ts: str = "timestamp",
    monotone: bool = False, max_group_rows: int | None = None,
) -> DataFrame:
    """For each Fetch the latest earlier statement line of its session and
    cursor whose time (to the second) is not later; -1 if there is none, 0 on other rows.

    A scan in line order finds the latest statement. Where its time passes the
    fetch's, as when times wrap at midnight, the sessions concerned are searched
    again, see `_parent_by_time`. monotone leaves the time test out, for logs whose
    times are known to rise with their lines. Statements are 'COM Stmt=' lines;
    'CEX Stmt=' counts too, though ingest strips it.
    """
    is_statement = F.col(operation).like("COM Stmt=%") | F.col(operation).like("CEX Stmt=%")
    is_fetch = F.col(operation) == "Fetch"
    parent = F.when(is_statement, F.struct(F.col(line).alias("line"), to_seconds(ts).alias("at")))
    scanned = ordered_scan(df, session, [line], [last_before("_parent", parent)], max_group_rows)
    late = is_fetch & (F.col("_parent.at") > to_seconds(ts))
    number = F.when(is_fetch, F.coalesce("_parent.line", F.lit(-1))).otherwise(0).cast("long")
    plain = scanned.withColumn("parent_line_num", number).withColumn("_late", F.coalesce(late, F.lit(False)))
    if monotone:
        return plain.drop("_parent", "_late")
    # written once, and counted on the way: most logs have no late fetch and end here
    seen = Observation()
    plain = stable(plain.drop("_parent").observe(seen, F.count_if("_late").alias("late")))
    if not seen.get["late"]:
        return plain.drop("_late")
    fetches = plain.where("_late").select(*df.columns)
    sessions = fetches.select(*[F.col(k).alias(f"_s_{k}") for k in session]).distinct()
    told = plain.where(is_statement).select(*df.columns)
    same = null_safe(told, sessions, [(k, f"_s_{k}") for k in session])
    again = _parent_by_time(told.join(sessions, same, "left_semi"), fetches, session, line, ts, max_group_rows)
    return plain.where(~F.col("_late")).drop("_late").unionByName(again)


TIME_LEVELS = 34  # 2^34 seconds reach past the year 2500


def _parent_by_time(told, asking, session, line, ts, max_group_rows):
    """Fetches with the latest earlier statement whose time is not later than theirs.

    A statement is filed under the dyadic block of every level that contains its
    second; [0, t] of a fetch is the union of at most one block per level. So each
    block needs one scan in line order and the answer is the largest of at most 35
    candidates.
    """
    second = to_seconds(ts)
    statements = told.select(
        *session, F.col(line).alias("_line"), F.lit(0).alias("_kind"),
        F.explode(_blocks_of(second, TIME_LEVELS + 1)).alias("_block"),
    )
    fetches = asking.select(
        *session, F.col(line).alias("_line"), F.lit(1).alias("_kind"),
        F.explode(_blocks_covering(F.lit(0).cast("long"), second, TIME_LEVELS + 1)).alias("_block"),
    )
    both = statements.unionByName(fetches)
    scanned = ordered_scan(
        both.select("*", F.col("_block.level").alias("_level"), F.col("_block.node").alias("_node"))
        .drop("_block"),
        [*session, "_level", "_node"], ["_line", "_kind"],
        [last_before("_seen", F.when(F.col("_kind") == 0, F.col("_line")))], max_group_rows,
    )
    best = scanned.where(F.col("_kind") == 1).groupBy(
        *[F.col(k).alias(f"_b_{k}") for k in session], F.col("_line").alias("_b_line")
    ).agg(F.max("_seen").alias("_parent"))
    cond = null_safe(asking, best, [(k, f"_b_{k}") for k in session]) & (asking[line] == best["_b_line"])
    return asking.join(best, cond, "left").select(
        *asking.columns, F.coalesce("_parent", F.lit(-1)).cast("long").alias("parent_line_num"))


def _blocks_of(value: Column, levels: int) -> Column:
    """The dyadic blocks containing an integer, one per level."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(levels - 1)),
        lambda n: F.struct(
            n.alias("level"), shift_right(value.cast("long"), n).alias("node")
        ),
    )


def _with_blocks(df: DataFrame, low: Column, high: Column, levels: Column) -> DataFrame:
    """df once per block of `_blocks_covering`, with its level and node."""
    rows = df.select("*", low.cast("long").alias("_low"), high.cast("long").alias("_past"), F.explode(F.sequence(F.lit(0), levels - 1)).alias("level"))
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))
    first, past = shift_right(F.col("_low") + size - 1, F.col("level")), shift_right(F.col("_past") + 1, F.col("level"))
    rows = rows.withColumns({"_first": first, "_past": past}).where("_first < _past")
    left, right = F.when(F.pmod("_first", F.lit(2)) == 1, F.col("_first")), F.when(F.pmod("_past", F.lit(2)) == 1, F.col("_past") - 1)
    return rows.select(*df.columns, "level", F.explode(F.array_compact(F.array(left, right))).alias("node"))


def _blocks_covering(low: Column, high: Column, levels: int) -> Column:
    """Disjoint dyadic blocks whose union is [low, high]: at most two per level.
    Needs 2^levels to exceed the length of the range."""

    def at_level(n: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), n)
        first = shift_right(low.cast("long") + size - 1, n)
        past = shift_right(high.cast("long") + 1, n)
        inside = first < past
        left = F.when(inside & (F.pmod(first, F.lit(2)) == 1),
                      F.struct(n.alias("level"), first.alias("node")))
        right = F.when(inside & (F.pmod(past, F.lit(2)) == 1),
                       F.struct(n.alias("level"), (past - 1).alias("node")))
        return F.array_compact(F.array(left, right))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), at_level))


SPAN_LEVELS = 62
#: Blocks asked for on a level up to which they are listed one by one.
FEW_BLOCKS = 64


def _filed_where_asked(running: DataFrame, asks: DataFrame) -> DataFrame:
    """running with level and node of its blocks, on the levels of asks; on levels with at most
    FEW_BLOCKS nodes, only those nodes. The list is a scalar of 62 * FEW_BLOCKS numbers at most."""
    first = Window.partitionBy("level").orderBy("node")  # cut to its first rows by each task
    some = asks.select("level", "node").distinct().withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= FEW_BLOCKS + 1)
    nodes = some.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.collect_list("node").alias("nodes"))
    few = F.when(F.col("n") <= FEW_BLOCKS, F.col("nodes"))
    levels = nodes.agg(F.collect_list(F.struct("level", few.alias("nodes")))).scalar()
    own = running.select("*", F.explode(levels).alias("_a"))
    own = own.select("*", F.col("_a.level").alias("level"), shift_right(F.col("_ts"), F.col("_a.level")).alias("node"))
    return own.where(F.col("_a.nodes").isNull() | F.array_contains("_a.nodes", F.col("node"))).drop("_a")


def concurrency(
    df: DataFrame, queue: Sequence[str], id_cols: Sequence[str], start: str | Column,
    end: str | Column, ts: str | None = None, max_group_rows: int | None = None,
) -> DataFrame:
    """Requests of the queue running when a request starts, itself included.
    id_cols identify a request.

    Without ts: every request b with b.start <= a.start <= b.end. Starts and
    ends are merged into one time line per queue and summed along it; no pairs
    are formed.

    With ts (the wall-clock time of the record): b must also have been recorded
    in [a.ts - ceil(a.end - a.start + 1) seconds, a.ts]. This guards against a
    restarted start/end clock; since the look-back is a's own duration, an
    early, long b can be missed. Both orders, of ts and of start and end, are cut into
    slices and counted there (`dominance`); a request is sent to a few of them, however
    far it looks back.
    """
    begin = F.col(start) if isinstance(start, str) else start
    finish = F.col(end) if isinstance(end, str) else end
    base = df.select(
        *queue, F.struct(*id_cols).alias("_id"), begin.alias("_start"), finish.alias("_end"),
        *([to_seconds(ts).alias("_ts")] if ts else []),
    )
    if ts:
        from opsight.operators import dominance  # the one operator that needs numpy and Arrow

        span = F.ceil(F.col("_end") - F.col("_start") + 1).cast("long")
        slice_rows = min(dominance.SLICE_ROWS, group_row_limit(df.sparkSession, max_group_rows))
        near, far = dominance.counted(base.withColumn("_low", F.col("_ts") - span), queue, slice_rows)
        per_id = lambda t, n: t.groupBy(F.struct(*queue, "_id").alias(f"_key{n}")).agg(F.sum("_n").alias(n))
        near, far = per_id(near, "_near"), per_id(far, "_far")
        live = near.join(far.hint("merge"), F.col("_key_near") == F.col("_key_far"), "left")
        return live.select(
            *[F.col(f"_key_near.{c}").alias(c) for c in queue], *[F.col(f"_key_near._id.{c}").alias(c) for c in id_cols],
            (F.col("_near") + F.coalesce("_far", F.lit(0))).alias("concurrent"),
        )
    group = list(queue)
    running = base.where(F.col("_end") >= F.col("_start")).drop("_id")
    edges = running.select(*group, F.inline(F.array(
        F.struct(F.col("_start").alias("_x"), F.lit(1).alias("_up"), F.lit(0).alias("_down")),
        F.struct(F.col("_end").alias("_x"), F.lit(0).alias("_up"), F.lit(1).alias("_down")),
    )))
    asks = base.select(*group, F.col("_start").alias("_x"), "_id")
    asked = asks.select(*group, "_x", F.lit(0).alias("_up"), F.lit(0).alias("_down"))
    # one row per time: however many start or end at once, the scan sees them summed
    line = edges.unionByName(asked).groupBy(*group, "_x").agg(F.sum("_up").alias("_up"), F.sum("_down").alias("_down"))
    scanned = ordered_scan(
        line, group, ["_x"], [running_sum("_sum", F.col("_up") - F.col("_down"))], max_group_rows,
    )
    # what ends at a time still runs at it
    live = scanned.select(*[F.col(k).alias(f"_l_{k}") for k in [*group, "_x"]],
                          (F.col("_sum") + F.col("_down")).alias("_live"))
    scanned = asks.join(live, null_safe(asks, live, [(k, f"_l_{k}") for k in [*group, "_x"]]))
    return scanned.select(
        *queue, *[F.col(f"_id.{c}").alias(c) for c in id_cols], F.col("_live").alias("concurrent")
    )


def resolve_instance_name(
    tables: DataFrame, records: DataFrame, table: str = "table_name", base: str = "base_table",
) -> DataFrame:
    """The record a table belongs to - by name, or for temporary records
    (rectype 7) by the name without its last one, then two characters. Adds
    recname, rectype and the instance suffix."""
    by_name = records.where(F.col("rectype").isin(0, 7)).select(
        F.col(base).alias("_n0"), F.struct("recname", "rectype").alias("_r0")
    )
    temp = records.where(F.col("rectype") == 7)
    one = temp.select(F.col(base).alias("_n1"), F.struct("recname", "rectype").alias("_r1"))
    two = temp.select(F.col(base).alias("_n2"), F.struct("recname", "rectype").alias("_r2"))
    t = F.col(table)
    size = F.length(t)
    cut = tables.withColumn("_k1", F.substr(t, F.lit(1), F.greatest(size - 1, F.lit(0)))
                            ).withColumn("_k2", F.substr(t, F.lit(1), F.greatest(size - 2, F.lit(0))))
    joined = (
        cut.join(by_name, F.col(table) == F.col("_n0"), "left")
        .join(one, F.col("_k1") == F.col("_n1"), "left")
        .join(two, F.col("_k2") == F.col("_n2"), "left")
    )
    found = F.coalesce("_r0", "_r1", "_r2")
    suffix = F.when(F.col("_r0").isNotNull(), None).when(
        F.col("_r1").isNotNull(), F.right(t, F.lit(1))
    ).when(F.col("_r2").isNotNull(), F.right(t, F.lit(2)))
    return joined.select(
        *tables.columns, found["recname"].alias("recname"), found["rectype"].alias("rectype"),
        suffix.alias("instance"),
    )


def numbered_instances(
    records: DataFrame, base: str = "base_table", instances: str = "instances",
) -> DataFrame:
    """The instance tables 1..n of each temporary record, for an equi-join."""
    return records.where(F.col(instances) >= 1).select(
        "*", F.explode(F.sequence(F.lit(1), F.col(instances).cast("int"))).alias("instance")
    ).withColumn("table_name", F.concat(F.col(base), F.col("instance").cast("string")))


def prefix_name_join(
    objects: DataFrame, bases: DataFrame, name: str = "object_name", base: str = "base_table",
    upto: str = "9999Z",
) -> DataFrame:
    """Objects named <base><suffix> with '1' <= suffix <= upto, compared as
    text. The suffix is normally an instance number, which is added as
    `instance` (NULL where the suffix is not a number).

    Every split of the name before a digit 1-9 gives one candidate base, so the
    join is on equal names; a name has few such digits.
    """
    splits = F.filter(
        F.sequence(F.lit(2), F.greatest(F.length(name), F.lit(2))),
        lambda i: F.substr(F.col(name), i, F.lit(1)).between("1", "9"),
    )
    cut = objects.withColumn("_at", F.explode(splits))
    cut = cut.withColumn("_base", F.substr(F.col(name), F.lit(1), F.col("_at") - 1)).withColumn(
        "_suffix", F.substr(F.col(name), F.col("_at"))
    ).where(F.col("_suffix") <= upto)
    return cut.join(bases, cut["_base"] == bases[base]).withColumn(
        "instance", F.col("_suffix").try_cast("int")
    ).drop("_at", "_base", "_suffix")
