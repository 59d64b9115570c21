"""Text expressions (P1-P3, P5, P8-P13, P15-P17). All are built from Spark functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def empty_to_null(value) -> Column:
    """The source database stores '' as NULL; do the same."""
    c = _col(value)
    return F.when(c != "", c)


def query_slots(value, n: int = 8, drop_first: bool = False) -> list[Column]:
    """The first n '&'-separated pieces; `query_rest` has what follows them.

    drop_first cuts the first character of slot 1, which removes a leading '?'
    (and, when the log has none, a real character: '-' then becomes NULL).
    """
    parts = F.split(_col(value), "&", -1)
    slots = [F.get(parts, F.lit(i)) for i in range(n)]
    if drop_first:
        slots[0] = F.substring(slots[0], 2, 2**31 - 1)
    return [empty_to_null(s) for s in slots]


def query_rest(value, n: int = 8) -> Column:
    """What follows the first n pieces, NULL if nothing does."""
    parts = F.split(_col(value), "&", -1)
    return empty_to_null(F.array_join(F.slice(parts, n + 1, F.size(parts)), "&"))


def split_query_string(
    df: DataFrame, col: str, n: int = 8, prefix: str = "query_string", drop_first: bool = False,
    rest: str = "query_rest",
) -> DataFrame:
    """P1 as an operator: adds prefix1..prefixN, and what is left of longer strings."""
    slots = query_slots(col, n, drop_first)
    return df.select("*", *[s.alias(f"{prefix}{i + 1}") for i, s in enumerate(slots)],
                     query_rest(col, n).alias(rest))


CODES = "(?:%[0-9A-Fa-f]{2})+"


def _decoded_once(value: Column) -> Column:
    """Every run of codes decoded, all else as it is."""
    plain = F.split(value, CODES, -1)
    runs = F.transform(F.regexp_extract_all(value, F.lit(CODES), F.lit(0)),
                       lambda run: F.coalesce(F.try_url_decode(run), run))
    both = F.zip_with(plain, runs, lambda p, r: F.concat(p, F.coalesce(r, F.lit(""))))
    return F.when(F.rlike(value, F.lit(CODES)), F.array_join(both, "")).otherwise(value)


def percent_decoded(value) -> Column:
    """%XX becomes its byte; '+' stays. Decoded text is decoded again until
    nothing is left to decode (so %2541 gives A). Each code is decoded by itself:
    a '%' that begins none stays, and so does what stands around it.

    Most texts are done after two rounds. The others go on until a round leaves no
    code: a code gives at most one '%', so that no more rounds than there are codes
    and 25s behind them can change anything, and once none is left the text is no
    longer looked at.
    """
    c = _col(value)
    twice = F.transform(F.transform(F.array(c), _decoded_once), _decoded_once)

    def rest(x: Column) -> Column:
        marks = F.regexp_extract_all(x, F.lit("%(?:25)*"), F.lit(0))
        rounds = F.aggregate(marks, F.lit(0), lambda a, m: a + F.length(m).cast("int"))
        state = lambda text: F.struct(text.alias("text"), F.rlike(text, F.lit(CODES)).alias("more"))
        further = lambda acc: F.get(F.transform(F.array(_decoded_once(acc["text"])), state), F.lit(0))
        return F.aggregate(
            F.sequence(F.lit(0), rounds), state(x), lambda acc, _: F.when(acc["more"], further(acc)).otherwise(acc))["text"]

    done = F.transform(twice, lambda x: F.when(F.rlike(x, F.lit(CODES)), rest(x)).otherwise(x))
    return F.when(F.contains(c, F.lit("%")), F.get(done, F.lit(0))).otherwise(c)


def percent_decode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P2 over named columns."""
    return df.withColumns({c: percent_decoded(c) for c in cols})


DOMAIN_RULES = (("%/F84D/%", "F84D"), ("%/HR88/%", "HR88"))  # fixed values


def classified(value, rules: Sequence[tuple[str, str]]) -> Column:
    """Label of the first LIKE pattern the upper-cased text matches, else NULL."""
    upper = F.upper(_col(value))
    out = None
    for pattern, label in rules:
        out = (
            F.when(upper.like(pattern), label)
            if out is None
            else out.when(upper.like(pattern), label)
        )
    return out


def classify_url_domain(
    df: DataFrame, col: str = "url", rules: Sequence[tuple[str, str]] = DOMAIN_RULES,
    name: str = "domain",
) -> DataFrame:
    return df.withColumn(name, classified(col, rules))


QUEUE_RULES = {  # fixed values: service -> queue
    ".GETSVC": "JREPQ", ".GETALL": "JREPQ", "SqlAccess": "SAMQ", "SqlQuery": "QRYQ",
    "SqlRequest": "QCKQ", "MgrClear": "QCKQ", "RamList": "QCKQ", "SamGetParmsSvc": "QCKQ",
}


def reassign_queue(
    df: DataFrame, rules: Mapping[str, str] = QUEUE_RULES, service: str = "service",
    queue: str = "queue",
) -> DataFrame:
    """The queue a service belongs to replaces the recorded one."""
    by_queue: dict[str, list[str]] = {}
    for name, target in rules.items():
        by_queue.setdefault(target, []).append(name)
    value = None
    for target, names in by_queue.items():
        hit = F.col(service).isin(names)
        value = F.when(hit, target) if value is None else value.when(hit, target)
    return df.withColumn(queue, value.otherwise(F.col(queue)))


def fingerprint(value) -> Column:
    """P5: statement text with literals masked, for grouping.

    Quoted strings and numbers that follow a blank or one of = < > + - * / ,
    become ':'; blanks around those symbols go; runs of blanks become one; a
    leading 'CEX Stmt=' is cut. This is the documented intent. The character
    loop it stands for differs in corner cases: it leaves 'x= :' for 'x = 5',
    ':.5' for 1.5, '::' for a doubled quote, and does not mask after '('.
    """
    c = F.regexp_replace(_col(value), "'(?:[^']|'')*'", ":")
    c = F.regexp_replace(c, " +", " ")
    c = F.regexp_replace(c, r" ?([=<>+\-*/,]) ?", "$1")
    c = F.regexp_replace(c, r"(^|[ =<>+\-*/,(])\d+(?:\.\d+)?(?![\w.])", "$1:")
    return F.regexp_replace(c, "^CEX Stmt=", "")


def fingerprint_sql(df: DataFrame, col: str = "operation", name: str = "fingerprint") -> DataFrame:
    return df.withColumn(name, fingerprint(col))


def rollup_by_fingerprint(df: DataFrame, col: str, duration: str) -> DataFrame:
    """P5: executions and time per statement shape. The shape is computed before
    the shuffle and partially aggregated, so a hot statement costs one row per task."""
    return (
        df.select(fingerprint(col).alias("fingerprint"), F.col(duration).alias("_d"))
        .groupBy("fingerprint")
        .agg(F.count(F.lit(1)).alias("executions"), F.sum("_d").alias("total_duration"),
             F.avg("_d").alias("avg_duration"), F.max("_d").alias("max_duration"))
    )


def decode_codes(value, mapping: Mapping, default=None) -> Column:
    """Code -> label."""
    c = _col(value)
    out = None
    for code, label in mapping.items():
        hit = c.eqNullSafe(F.lit(code))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(F.lit(default))


def nth_delimited_tail(value, sep: str = "=", n: int = 2) -> Column:
    """Text after the n-th separator; the whole text if there are fewer."""
    c = _col(value)
    parts = F.split(c, f"[{sep}]", n + 1)
    return empty_to_null(F.coalesce(F.get(parts, F.lit(n)), c))


def host_of(value, sep: str = ":") -> Column:
    """P10: text before the first separator; NULL without one."""
    c = _col(value)
    at = F.instr(c, sep)
    return F.when(at > 1, F.substring_index(c, sep, 1))


def port_of(value, sep: str = ":") -> Column:
    """P10: text after the first separator; the whole text without one."""
    c = _col(value)
    return empty_to_null(F.substr(c, F.instr(c, sep) + F.lit(1)))


def strip_instance_suffix(filename, instance) -> Column:
    """File name up to '-<instance>.'; NULL when that is absent or leads."""
    f, i = _col(filename), _col(instance).cast("string")
    at = F.position(F.concat(F.lit("-"), i, F.lit(".")), f)
    return empty_to_null(F.substr(f, F.lit(1), F.greatest(at - 1, F.lit(0))))


def statement_type_from_ascii(value) -> Column:
    """Control character at the end -> D (2) or S (4), anything else '_'."""
    code = F.ascii(F.right(_col(value), F.lit(1)))
    return F.when(code == 2, "D").when(code == 4, "S").otherwise("_")


def labelled_metric(n: int, label, value) -> Column:
    """P13: 'MetricN:label=value', NULL parts as empty text."""
    return F.concat(
        F.lit(f"Metric{n}:"), F.coalesce(_col(label), F.lit("")), F.lit("="),
        F.coalesce(_col(value).cast("string"), F.lit("")),
    )


def session_tag(*parts) -> Column:
    """Parts joined by '_' with blanks and dashes replaced."""
    return F.concat_ws("_", *[F.translate(_col(p).cast("string"), " -", "__") for p in parts])


def _cut(value: Column, size: int | None) -> Column:
    return value if size is None else F.substring(value, 1, size)


def status_comment(kind, name, instance, phase, user, size: int | None = None) -> Column:
    """P16: 'type, name, instance, Start|End, user', cut at `size` characters if given."""
    parts = [F.coalesce(_col(p).cast("string"), F.lit("")) for p in
             (kind, name, instance, phase, user)]
    return _cut(F.concat_ws(", ", *parts), size)


def action_tag(instance, text, size: int | None = None) -> Column:
    """P16: 'PI=<instance>:<text>', cut at `size` characters if given."""
    return _cut(F.concat(F.lit("PI="), _col(instance).cast("string"), F.lit(":"), _col(text)), size)


def text_chunks(value, size: int = 254, max_parts: int | None = None) -> Column:
    """Array of pieces of at most `size` characters.

    A full piece backs up to its last blank, which stays at its end; a full
    piece without a blank is kept whole. max_parts keeps the
    first pieces only (the message format has nine); None splits the whole text.

    One greedy expression states the rule: where at least `size` characters are
    left, up to the last blank among them, else all of them; then the rest.
    """
    pattern = f"(?s)(?=.{{{size}}}).{{0,{size - 1}}} |.{{{size}}}|.+"
    pieces = F.regexp_extract_all(_col(value), F.lit(pattern), F.lit(0))
    return pieces if max_parts is None else F.slice(pieces, 1, max_parts)


def chunk_text(
    df: DataFrame, col: str, size: int = 254, max_parts: int | None = None,
    seq: str = "parm_seq", piece: str = "message_parm",
) -> DataFrame:
    """P17 as an operator: one row per piece, numbered from 1. A row never moves
    to another task, so long texts stay where they were read."""
    others = [c for c in df.columns if c != col]
    return df.select(
        *others, F.posexplode(text_chunks(col, size, max_parts)).alias("_pos", piece)
    ).select(*others, (F.col("_pos") + 1).alias(seq), piece)
