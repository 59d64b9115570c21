"""Ordered scans (lag, lead, running sum, carry forward) that hold under skew.

A Spark window puts every row of one key into one task. That is the best plan
while groups fit a task, and it is what `ordered_scan` uses for them. Groups
above `max_group_rows` are cut into chunks by a range shuffle on (key, order, place
in the input), so that rows of equal order are cut as well; each chunk is scanned by
its own task and the few chunk edges - one row per key and chunk - carry the state
from one chunk to the next.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from opsight.session import stable

DEFAULT_MAX_GROUP_ROWS = 2_000_000
MAX_GROUP_ROWS_CONF = "spark.opsight.maxGroupRows"
COUNT_BUCKETS = 1 << 16


@dataclass(frozen=True)
class Scan:
    """One output of a scan: kind is lag, lead, sum or last."""

    name: str
    kind: str
    source: Column


def lag(name: str, source) -> Scan:
    """Value of the previous row."""
    return Scan(name, "lag", _col(source))


def lead(name: str, source) -> Scan:
    """Value of the next row."""
    return Scan(name, "lead", _col(source))


def running_sum(name: str, source) -> Scan:
    """Sum of the rows up to and including this one."""
    return Scan(name, "sum", _col(source))


def last_before(name: str, source) -> Scan:
    """Last non-null value among the rows strictly before this one."""
    return Scan(name, "last", _col(source))


def row_number(name: str) -> Scan:
    """1, 2, 3 ... in scan order."""
    return Scan(name, "sum", F.lit(1).cast("long"))


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def group_row_limit(spark, max_group_rows: int | None = None) -> int:
    if max_group_rows is not None:
        return max_group_rows
    return int(spark.conf.get(MAX_GROUP_ROWS_CONF, str(DEFAULT_MAX_GROUP_ROWS)))


def null_safe(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    cond = F.lit(True)
    for left_name, right_name in pairs:
        cond = cond & left[left_name].eqNullSafe(right[right_name])
    return cond


def all_fit(df: DataFrame, keys: Sequence[str], max_group_rows: int | None = None) -> bool:
    """Whether it is certain that no group is above the limit of a scan.

    Counts rows per hash bucket of the keys: what a task sends is bounded by the buckets,
    however many keys there are, and a group has at most the rows of its bucket. For
    callers whose rows are written already, as it reads them once more.
    """
    buckets = F.pmod(F.xxhash64(*keys), F.lit(COUNT_BUCKETS)).alias("_b")
    return largest_group(df, [buckets]) <= group_row_limit(df.sparkSession, max_group_rows)


def split_hot(df: DataFrame, keys: Sequence[str], limit: int):
    """(groups of at most limit rows, larger groups or None, rows in the larger).

    The counting pass reads only the key columns and combines before its
    shuffle. The hot keys stay a table; only the sum of their rows is read here.
    """
    if not keys:
        total = df.count()
        return (df, None, 0) if total <= limit else (None, df, total)
    seen = Observation()
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    hot = stable(hot.observe(seen, F.sum("_n").alias("rows")))
    rows = seen.get["rows"]
    if rows is None:
        return df, None, 0
    small = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    cond = null_safe(df, small, [(k, f"_hot_{k}") for k in keys])
    return df.join(small, cond, "left_anti"), df.join(small, cond, "left_semi"), rows


def largest_group(df: DataFrame, keys: Sequence) -> int:
    """Rows of the largest group."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.max("_n")).first()[0] or 0


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence,
    outputs: Sequence[Scan],
    max_group_rows: int | None = None,
    known_bounded: bool = False,
) -> DataFrame:
    """Add the scan outputs, computed per key in the given total order.

    known_bounded skips the counting of groups; it is for callers that have
    proved already that none exceeds the limit.
    """
    if known_bounded:
        return _scan_in_window(df, list(keys), [_col(o) for o in order], outputs)
    limit = group_row_limit(df.sparkSession, max_group_rows)
    order = [_col(o) for o in order]
    cold, hot, hot_rows = split_hot(df, keys, limit)
    parts = []
    if cold is not None:
        parts.append(_scan_in_window(cold, list(keys), order, outputs))
    if hot is not None:
        parts.append(_scan_in_chunks(hot, list(keys), order, outputs, hot_rows, limit))
    result = parts[0]
    for extra in parts[1:]:
        result = result.unionByName(extra)
    return result


def _local(scan: Scan, source: Column, window) -> Column:
    if scan.kind == "lag":
        return F.lag(source, 1).over(window)
    if scan.kind == "lead":
        return F.lead(source, 1).over(window)
    if scan.kind == "sum":
        return F.sum(source).over(window.rowsBetween(Window.unboundedPreceding, 0))
    if scan.kind == "last":
        return F.last(source, ignorenulls=True).over(
            window.rowsBetween(Window.unboundedPreceding, -1)
        )
    raise ValueError(f"unknown scan kind {scan.kind}")


def _scan_in_window(df, keys, order, outputs):
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.select("*", *[_local(s, s.source, window).alias(s.name) for s in outputs])


def _scan_in_chunks(df, keys, order, outputs, rows, limit):
    columns = df.columns
    chunks = max(2, math.ceil(2 * rows / limit))
    # the row's place in the input settles equal orders, so that chunks can end among them
    ranged = (
        df.select("*", *[s.source.alias(f"_src{i}") for i, s in enumerate(outputs)], F.monotonically_increasing_id().alias("_place"))
        .repartitionByRange(chunks, *keys, *order, "_place")
        .withColumn("_chunk", F.spark_partition_id())
    )
    ranged = stable(ranged)
    window = Window.partitionBy("_chunk", *keys).orderBy(*order, "_place")
    local = ranged.select(
        "*",
        *[_local(s, F.col(f"_src{i}"), window).alias(f"_loc{i}") for i, s in enumerate(outputs)],
        F.lag(F.lit(True), 1, False).over(window).alias("_not_first"),
        F.lead(F.lit(True), 1, False).over(window).alias("_not_last"),
    )
    # one first and one last row per key and chunk: at most hot keys + chunks rows each
    first = local.where(~F.col("_not_first"))
    last = local.where(~F.col("_not_last"))
    heads, tails = [], []
    for i, s in enumerate(outputs):
        if s.kind == "lead":
            heads.append(F.col(f"_src{i}").alias(f"_edge{i}"))
        elif s.kind == "lag":
            tails.append(F.col(f"_src{i}").alias(f"_edge{i}"))
        elif s.kind == "sum":
            tails.append(F.col(f"_loc{i}").alias(f"_edge{i}"))
        else:
            tails.append(F.coalesce(f"_src{i}", f"_loc{i}").alias(f"_edge{i}"))
    edges = last.select(*keys, "_chunk", *tails)
    if heads:
        head_rows = first.select(*[F.col(k).alias(f"_h_{k}") for k in keys],
                                 F.col("_chunk").alias("_h_chunk"), *heads)
        cond = null_safe(edges, head_rows, [(k, f"_h_{k}") for k in keys])
        cond = cond & (edges["_chunk"] == head_rows["_h_chunk"])
        edges = edges.join(head_rows, cond).drop("_h_chunk", *[f"_h_{k}" for k in keys])
    across = Window.partitionBy(*keys).orderBy("_chunk")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carries = []
    for i, s in enumerate(outputs):
        edge = F.col(f"_edge{i}")
        if s.kind == "lag":
            carry = F.lag(edge, 1).over(across)
        elif s.kind == "lead":
            carry = F.lead(edge, 1).over(across)
        elif s.kind == "sum":
            carry = F.sum(edge).over(before)
        else:
            carry = F.last(edge, ignorenulls=True).over(before)
        carries.append(carry.alias(f"_carry{i}"))
    carry = edges.select(*[F.col(k).alias(f"_c_{k}") for k in keys],
                         F.col("_chunk").alias("_c_chunk"), *carries)
    cond = null_safe(local, carry, [(k, f"_c_{k}") for k in keys])
    joined = local.join(carry, cond & (local["_chunk"] == carry["_c_chunk"]))
    final = []
    for i, s in enumerate(outputs):
        loc, car = F.col(f"_loc{i}"), F.col(f"_carry{i}")
        if s.kind == "lag":
            value = F.when(F.col("_not_first"), loc).otherwise(car)
        elif s.kind == "lead":
            value = F.when(F.col("_not_last"), loc).otherwise(car)
        elif s.kind == "sum":
            value = F.coalesce(loc + car, loc, car)
        else:
            value = F.coalesce(loc, car)
        final.append(value.alias(s.name))
    return joined.select(*columns, *final)
