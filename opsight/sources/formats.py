"""The five log formats (S1-S5): how a line becomes typed, checked columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsight.functions.text import empty_to_null

_UNIT = "\u0001"


@dataclass(frozen=True)
class LogFormat:
    """A record layout.

    cut:    line -> array of raw fields
    fields: raw array -> {column: (raw text or None, typed value)}; a raw text
            that gives no value is a failed conversion
    refine: raw array -> raw array with parts of fields (octets, query slots)
            cut further
    keep:   lines for which this is false are discarded, not rejected
    rules:  conditions on typed columns that a loaded row must meet
    """

    cut: Callable[[Column], Column]
    fields: Callable[[Column], Mapping[str, tuple[Column | None, Column]]]
    refine: Callable[[Column], Column] | None = None
    keep: Callable[[Column], Column] = lambda line: F.lit(True)
    rules: Mapping[str, Column] = field(default_factory=dict)


def _item(raw: Column, i: int) -> Column:
    return empty_to_null(F.trim(F.get(raw, F.lit(i))))


def _text(raw: Column) -> tuple[None, Column]:
    return None, raw


def _number(raw: Column, kind: str) -> tuple[Column, Column]:
    return raw, raw.try_cast(kind)


def _groups(pattern: str, n: int) -> Callable[[Column], Column]:
    """Cut a line by the groups of one anchored pattern, matched once; a line
    that does not match gives no fields."""
    template = _UNIT.join(f"${i}" for i in range(1, n + 1))

    def cut(line: Column) -> Column:
        parts = F.split(F.regexp_replace(line, pattern, template), _UNIT, -1)
        return F.when(F.size(parts) == n, parts)

    return cut


def _padded(parts: Column, n: int) -> Column:
    return F.slice(F.concat(parts, F.array(*[F.lit("")] * n)), 1, n)


def _access_parts(ip: int, query: Callable[[Column], Column], before: int, slots: int):
    """The first `before` raw fields, then 4 octets, the query slots and what is left of the query."""

    def refine(raw: Column) -> Column:
        octets = F.split(F.coalesce(F.get(raw, F.lit(ip)), F.lit("")), r"\.", 4)
        pieces = F.split(F.coalesce(query(raw), F.lit("")), "&", -1)
        rest = F.array_join(F.slice(pieces, slots + 1, F.size(pieces)), "&")
        return F.concat(_padded(raw, before), _padded(octets, 4), _padded(pieces, slots), F.array(rest))

    return refine


def _access_fields(raw: Column, octets: int, drop_first: bool, slots: int):
    """Octets and query slots. What follows the last slot is in query_rest;
    drop_first cuts the first character of the first slot."""
    out = {f"remote_host{i + 1}": _text(_item(raw, octets + i)) for i in range(4)}
    for i in range(slots):
        slot = F.get(raw, F.lit(octets + 4 + i))
        if i == 0 and drop_first:
            slot = F.substring(slot, 2, 2**31 - 1)
        out[f"query_string{i + 1}"] = _text(empty_to_null(slot))
    out["query_rest"] = _text(empty_to_null(F.get(raw, F.lit(octets + 4 + slots))))
    return out


def _access_rules(max_url: int | None) -> dict[str, Column]:
    required = ("timestamp", "duration", "bytes_sent", "url") + tuple(
        f"remote_host{i}" for i in range(1, 5)
    )
    rules = {f"{c} missing": F.col(c).isNotNull() for c in required}
    for i in range(1, 5):
        rules[f"remote_host{i} too long"] = F.length(f"remote_host{i}") <= 3
    rules["request_method too long"] = F.length("request_method") <= 8
    if max_url is not None:
        rules["url too long"] = F.length("url") <= max_url
    return rules


def pipe_access_log(
    drop_first: bool = True, slots: int = 8, bytes_digits: int = 7, max_url: int | None = None,
) -> LogFormat:
    """S1: '|'-separated access log. The fourth field is skipped; the tenth is
    the whole rest of the line, a query string. Sizes of more than bytes_digits
    digits and URLs longer than max_url are rejected."""

    def fields(raw):
        stamp, status = _item(raw, 0), F.nullif(_item(raw, 6), F.lit("-"))
        parts = _access_fields(raw, 9, drop_first, slots)
        return {
            "timestamp": (stamp, F.try_to_timestamp(stamp, F.lit("yyyy.MM.dd HH:mm:ss"))),
            "duration": _number(_item(raw, 1), "decimal(9,3)"),
            "bytes_sent": _number(_item(raw, 2), f"decimal({bytes_digits},0)"),
            **{c: v for c, v in parts.items() if c.startswith("remote")},
            "user_agent": _text(_item(raw, 5)),
            "return_status": _number(status, "decimal(3,0)"),
            "request_method": _text(_item(raw, 7)),
            "url": _text(_item(raw, 8)),
            **{c: v for c, v in parts.items() if c.startswith("query")},
        }

    return LogFormat(
        lambda line: F.split(line, r"\|", 10), fields,
        _access_parts(4, lambda raw: F.get(raw, F.lit(9)), 9, slots), rules=_access_rules(max_url),
    )


def w3c_access_log(
    drop_first: bool = True, slots: int = 8, bytes_digits: int = 7, max_url: int | None = None,
) -> LogFormat:
    """Blank- or tab-separated access log with '#' header lines, which are
    discarded. The time is columns 1-19. Since this log has no leading '?', the
    cut of the first character costs slot 1 a real one: drop_first=False keeps it.
    """

    def cut(line):
        return F.concat(
            F.array(F.translate(F.substring(line, 1, 19), "\t", " ")),
            F.regexp_extract_all(F.substring(line, 20, 2**31 - 1), F.lit(r'"[^"]*"|\S+'), F.lit(0)),
        )

    def fields(raw):
        stamp, status = _item(raw, 0), F.nullif(_item(raw, 6), F.lit("-"))
        parts = _access_fields(raw, 9, drop_first, slots)
        return {
            "timestamp": (stamp, F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss"))),
            "duration": _number(_item(raw, 1), "decimal(9,3)"),
            "bytes_sent": _number(_item(raw, 2), f"decimal({bytes_digits},0)"),
            **{c: v for c, v in parts.items() if c.startswith("remote")},
            "remote_dns": _text(_item(raw, 4)),
            "request_method": _text(_item(raw, 5)),
            "return_status": _number(status, "decimal(3,0)"),
            "user_agent": _text(empty_to_null(F.btrim(_item(raw, 7), F.lit('"')))),
            "url": _text(_item(raw, 8)),
            **{c: v for c, v in parts.items() if c.startswith("query")},
        }

    rest = _access_parts(3, lambda raw: F.array_join(F.slice(raw, 10, F.greatest(F.size(raw), F.lit(1))), " "), 9, slots)
    return LogFormat(cut, fields, rest, lambda line: ~F.startswith(line, F.lit("#")),
                     _access_rules(max_url))


def service_trace(queue: str, tz_shift_hours: int = 1, pid_digits: int = 6) -> LogFormat:
    """S3: '@' lines of a service trace. Times come as epoch seconds, shifted by
    a fixed number of hours, and as milliseconds. The fifth field (end date) is
    taken up by the constant queue."""

    def fields(raw):
        epoch = _item(raw, 2)
        shifted = F.timestamp_seconds(epoch.try_cast("long") + tz_shift_hours * 3600)
        start, end = _item(raw, 3), _item(raw, 5)
        return {
            "service": _text(empty_to_null(F.substring(_item(raw, 0), 2, 2**31 - 1))),
            "pid": _number(_item(raw, 1), f"decimal({pid_digits},0)"),
            "stimestamp": (epoch, shifted),
            "stime": (start, (start.try_cast("double") / 1000).cast("decimal(13,3)")),
            "queue": _text(F.lit(queue)),
            "etime": (end, (end.try_cast("double") / 1000).cast("decimal(13,3)")),
        }

    required = ("service", "pid", "stimestamp", "stime", "etime")
    rules = {f"{c} missing": F.col(c).isNotNull() for c in required}
    rules["service too long"] = F.length("service") <= 20
    return LogFormat(
        lambda line: F.split(F.trim(line), r"\s+", -1), fields,
        keep=lambda line: F.startswith(line, F.lit("@")), rules=rules,
    )


_TRACE_TAIL = (
    r"([^-\s]*)-(\S+)\s+(\S+)\s+(\S+)\s+[^#]*#([^.]*)\.(\S+)\s+[^=]*=(\S+)\s+[^=]*=(\S+)\s+([^&]*).*$"
)


def sql_trace(log_date: str, has_program: bool = True, max_text: int | None = None) -> LogFormat:
    """SQL trace. Server lines start with 'program.pid'; client lines lack it
    and get 'Client' and 0. Lines carry a time only; log_date gives the day.
    Statements are whole unless max_text gives a length to cut them at."""
    head = r"^\s*([^.\s]*)\.(\S+)\s+" if has_program else r"^()()\s*"

    def fields(raw):
        time = _item(raw, 4)
        operation = F.get(raw, F.lit(10))
        operation = empty_to_null(operation if max_text is None else F.substring(operation, 1, max_text))
        program, pid = _item(raw, 0), _item(raw, 1)
        return {
            "program": (program, F.coalesce(program, F.lit("Client"))),
            "pid": (pid, F.coalesce(pid, F.lit("0")).try_cast("double")),
            "line_id": _number(_item(raw, 2), "double"),
            "line_num": _number(_item(raw, 3), "double"),
            "timestamp": (time, F.try_to_timestamp(
                F.concat(F.lit(log_date + " "), time), F.lit("yyyy-MM-dd HH.mm.ss"))),
            "time_since_last": _number(_item(raw, 5), "double"),
            "cursor": _number(_item(raw, 6), "double"),
            "database": _text(_item(raw, 7)),
            "return_code": _number(_item(raw, 8), "double"),
            "duration": _number(_item(raw, 9), "double"),
            "operation": _text(operation),
        }

    required = ("line_id", "line_num", "timestamp", "time_since_last", "cursor", "database",
                "return_code", "duration", "operation")
    rules = {f"{c} missing": F.col(c).isNotNull() for c in required}
    rules["program too long"] = F.length("program") <= 12
    rules["database too long"] = F.length("database") <= 10
    return LogFormat(_groups(head + _TRACE_TAIL, 11), fields, rules=rules)


MESSAGE_FUNCTIONS = ("tpservice", "tpreturn")  # fixed values


def message_log(log_date: str, size_digits: int = 8) -> LogFormat:
    """Middleware message log. `service` keeps the '{"' and quotes of its
    token; for a tpreturn it holds the return code."""
    pattern = (
        r"^([^.]*)\.([^!]*)!([^.]*)\.([^:]*):\s*\S+\s+\S+\s+([^(]*)\(([^,]*),[^,]*,[^,]*,([^,]*).*$"
    )

    def fields(raw):
        time = _item(raw, 0)
        return {
            "timestamp": (time, F.try_to_timestamp(
                F.concat(F.lit(log_date + " "), time), F.lit("yyyy-MM-dd HHmmss"))),
            "nodename": _text(_item(raw, 1)),
            "prcsname": _text(_item(raw, 2)),
            "prcsid": _text(_item(raw, 3)),
            "funcname": _text(_item(raw, 4)),
            "service": _text(_item(raw, 5)),
            "msg_size": _number(_item(raw, 6), f"decimal({size_digits},0)"),
        }

    required = ("timestamp", "nodename", "prcsname", "prcsid", "funcname", "service")
    rules = {f"{c} missing": F.col(c).isNotNull() for c in required}
    rules.update({f"{c} too long": F.length(c) <= 20 for c in required if c != "timestamp"})
    rules["funcname not allowed"] = F.col("funcname").isin(list(MESSAGE_FUNCTIONS))
    return LogFormat(_groups(pattern, 7), fields, rules=rules)


def parsed(lines: DataFrame, fmt: LogFormat, line: str = "value") -> DataFrame:
    """Typed columns beside the line, with the raw texts of converted ones in `_raw`.

    Each step goes through a generator of one row. Spark would otherwise move
    the later filter on the route below the projections and repeat the cuts and
    conversions for every rule that mentions a column.
    """
    others = [c for c in lines.columns if c != line]
    cut = lines.select(line, *others, F.explode(F.array(fmt.cut(F.col(line)))).alias("_cut"))
    if fmt.refine is not None:
        cut = cut.select(
            line, *others, F.explode(F.array(fmt.refine(F.col("_cut")))).alias("_cut")
        )
    fields = fmt.fields(F.col("_cut"))
    raws = [raw.alias(name) for name, (raw, _) in fields.items() if raw is not None]
    return cut.select(
        line, *others,
        F.inline(F.array(F.struct(
            *[typed.alias(name) for name, (_, typed) in fields.items()],
            F.struct(*raws).alias("_raw"),
        ))),
    )
