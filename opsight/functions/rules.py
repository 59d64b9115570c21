"""Flag tests (P7) and row rules."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def has_flag(value, bit: int) -> Column:
    """The bit is set."""
    return _col(value).cast("long").bitwiseAND(F.lit(bit).cast("long")) != 0


def has_flag_unfloored(value, bit: int) -> Column:
    """The un-floored test (x / bit) mod 2 = 1, true only when the bit is
    set and every lower bit is clear."""
    return F.pmod(_col(value).cast("long"), F.lit(2 * bit).cast("long")) == bit


def failed_rules(rules: Mapping[str, Column]) -> Column:
    """Array of the names of rules that do not hold. A rule that is NULL holds,
    as a CHECK constraint does; NOT NULL has to be said with isNotNull()."""
    marks = [F.when(~F.coalesce(cond, F.lit(True)), F.lit(name)) for name, cond in rules.items()]
    return F.array_compact(F.array(*marks))


def check_rules(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row per violated rule, from a single pass over the rows."""
    return df.select("*", F.explode(failed_rules(rules)).alias("rule"))


def max_length(value, n: int) -> Column:
    return F.length(_col(value)) <= n
