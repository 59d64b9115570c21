"""Top-N, shares and cumulative shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsight.operators.scan import null_safe, ordered_scan, running_sum

MAX_BROADCAST_RANKS = 100_000


def sort_key(col: str, descending: bool = True) -> Column:
    """Sort order with the source database's NULL placement: last when
    ascending, first when descending (O1)."""
    c = F.col(col)
    return c.desc_nulls_first() if descending else c.asc_nulls_last()


def top_n_rank(
    df: DataFrame, order: str, n: int, rank: str = "rnk", descending: bool = True
) -> DataFrame:
    """Rows whose RANK by `order` is at most n; ties are kept, gaps follow them.

    The n best values come from a distributed top-n. The rank of each distinct
    one is 1 + the rows above it, known from those n values alone, so rows -
    also a huge set of ties - are ranked by a join with at most n values
    instead of being sorted in one task.
    """
    best = df.select(F.col(order).alias("_v")).orderBy(
        F.col("_v").desc_nulls_first() if descending else F.col("_v").asc_nulls_last()
    ).limit(n)
    per_value = best.groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    above = Window.orderBy(
        F.col("_v").desc_nulls_first() if descending else F.col("_v").asc_nulls_last()
    ).rowsBetween(Window.unboundedPreceding, -1)
    ranks = per_value.select(
        "_v", (F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1).cast("long").alias(rank)
    )
    if n <= MAX_BROADCAST_RANKS:
        ranks = F.broadcast(ranks)
    return df.join(ranks, df[order].eqNullSafe(ranks["_v"])).drop("_v")


def top_n_by_group(
    df: DataFrame, by: Sequence[str], order: str, n: int, rank: str = "rnk",
    descending: bool = True,
) -> DataFrame:
    """W1 per group. Spark cuts each task's rows to the first n ranks before the
    shuffle, so a hot group costs n rows (and ties) per task."""
    w = Window.partitionBy(*by).orderBy(sort_key(order, descending))
    return df.withColumn(rank, F.rank().over(w).cast("long")).where(F.col(rank) <= n)


def share(
    df: DataFrame, measures: Mapping[str, str], by: Sequence[str] = ()
) -> DataFrame:
    """Each value as a fraction of its (group) total; measures maps output
    to input column. A zero total gives NULL.

    Totals are combined per task before their shuffle and joined back, so rows
    of a large group are not gathered in one task as a window would.
    """
    sums = [F.sum(src).cast("double").alias(f"_t{i}") for i, src in enumerate(measures.values())]
    fractions = [
        (F.col(src) / F.nullif(F.col(f"_t{i}"), F.lit(0.0))).alias(out)
        for i, (out, src) in enumerate(measures.items())
    ]
    if not by:
        return df.crossJoin(F.broadcast(df.agg(*sums))).select(*df.columns, *fractions)
    totals = df.groupBy(*by).agg(*sums)
    totals = totals.select(*[F.col(k).alias(f"_b_{k}") for k in by],
                           *[f"_t{i}" for i in range(len(sums))])
    cond = null_safe(df, totals, [(k, f"_b_{k}") for k in by])
    return df.join(totals, cond).select(*df.columns, *fractions)


def cumulative_by_value(
    df: DataFrame, order: str, measures: Mapping[str, str], keys: Sequence[str] = (),
    max_group_rows: int | None = None, descending: bool = False,
) -> DataFrame:
    """Running sums over distinct values of `order`, one row per (keys, value)."""
    per_value = df.groupBy(*keys, order).agg(
        *[F.sum(src).alias(f"_m{i}") for i, src in enumerate(measures.values())]
    )
    outs = [running_sum(out, f"_m{i}") for i, out in enumerate(measures)]
    ordered = ordered_scan(per_value, keys, [sort_key(order, descending)], outs, max_group_rows)
    return ordered.select(*keys, order, *measures)


def cumulative(
    df: DataFrame, order: str, measures: Mapping[str, str], keys: Sequence[str] = (),
    max_group_rows: int | None = None, descending: bool = False,
) -> DataFrame:
    """Running sums in a RANGE frame - rows of equal order get the same
    value. Rows are summed per value first; only distinct values are scanned."""
    table = cumulative_by_value(df, order, measures, keys, max_group_rows, descending)
    table = table.select(*[F.col(c).alias(f"_b_{c}") for c in (*keys, order)], *measures)
    cond = null_safe(df, table, [(c, f"_b_{c}") for c in (*keys, order)])
    return df.join(table, cond).select(*df.columns, *measures)


def cumulative_share(
    df: DataFrame, order: str, measures: Mapping[str, str], keys: Sequence[str] = (),
    max_group_rows: int | None = None,
) -> DataFrame:
    """W2 + W3: running fraction of the total, peers included."""
    shares = share(df, {f"_s{i}": src for i, src in enumerate(measures.values())}, keys)
    running = cumulative(
        shares, order, {out: f"_s{i}" for i, out in enumerate(measures)}, keys, max_group_rows
    )
    return running.drop(*[f"_s{i}" for i in range(len(measures))])


def first_rows(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """O2: the first n rows in a stated order."""
    return df.orderBy(*order).limit(n)


def minus(first: DataFrame, *others: DataFrame) -> DataFrame:
    """O3: distinct rows of the first that are in none of the others."""
    for other in others:
        first = first.subtract(other)
    return first.distinct()


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Bag union by column name."""
    for other in others:
        first = first.unionByName(other)
    return first
