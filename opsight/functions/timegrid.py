"""Time expressions (T1, T2, P14) on a grid anchored at midnight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def to_seconds(ts) -> Column:
    """Whole epoch seconds; the fraction is dropped."""
    return F.unix_seconds(_col(ts).cast("timestamp"))


def to_micros(ts) -> Column:
    return F.unix_micros(_col(ts).cast("timestamp"))


def seconds_of_day(ts) -> Column:
    return F.pmod(to_seconds(ts), F.lit(86400))


def _on_grid(ts, steps: Column, secs: Column) -> Column:
    midnight = to_seconds(ts) - seconds_of_day(ts)
    return F.timestamp_seconds(midnight + steps.cast("long") * secs)


def time_floor(ts, secs) -> Column:
    """Last grid point at or before ts."""
    s = F.lit(secs) if isinstance(secs, int) else _col(secs)
    return _on_grid(ts, F.floor(seconds_of_day(ts) / s), s)


def time_ceil(ts, secs) -> Column:
    """First grid point at or after ts; may be next midnight or, when the
    step does not divide a day, later than it."""
    s = F.lit(secs) if isinstance(secs, int) else _col(secs)
    return _on_grid(ts, F.ceil(seconds_of_day(ts) / s), s)


def time_round(ts, secs) -> Column:
    """Nearest grid point, halves up."""
    s = F.lit(secs) if isinstance(secs, int) else _col(secs)
    return _on_grid(ts, F.round(seconds_of_day(ts) / s, 0), s)


def linear(t1, v1, t2, v2, t) -> Column:
    """Value at t on the line through both points. NULL if anything is
    NULL, v1 if both points share a time."""
    a, b, x = to_micros(t1), to_micros(t2), to_micros(t)
    y1, y2 = _col(v1), _col(v2)
    slope = y1 + (x - a) * (y2 - y1) / F.nullif(b - a, F.lit(0))
    missing = a.isNull() | b.isNull() | x.isNull() | y1.isNull() | y2.isNull()
    return F.when(missing, None).when(a == b, y1).otherwise(slope)


def within_days(ts, as_of, days: int) -> Column:
    """Later than `days` days before as_of (always given, never the clock)."""
    limit = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    return _col(ts) > limit


def between_times(ts, start, end) -> Column:
    """Both ends included."""
    return _col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))


def elapsed_seconds(begin, end) -> Column:
    """Seconds between two times of second precision."""
    return to_seconds(end) - to_seconds(begin)
