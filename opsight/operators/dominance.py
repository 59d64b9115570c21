"""Counts over pairs that agree in two orders, in slices of bounded size.

For requests with a time t, a start and an end, `counted` finds how many of the same
queue were recorded from `low` to t and ran at the start. That is the number of starts
up to it less the number of ends before it, among the rows between two places in the
order of time. The order of time is cut into slices and so is the order of starts and
ends, at any row, also among equal values. A row travels to its slice of time, where a
request meets the rows beside it; starts and ends travel to their slice of values, where
the few requests that reach over several slices of time meet the rows of these. What
lies in whole slices of both comes from a table of counts, one for each pair of slices.

A row is sent about four times, however far requests look back. Slices are counted by
numpy, in Python workers; nothing runs once per row.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsight.session import written

#: Rows of a slice, about.
SLICE_ROWS = 250_000
#: Slices of an order at most; the table of counts has a number for each pair.
MOST_SLICES = 1024
#: Rows looked at for the cuts, for each slice.
LOOKED_AT = 64
FIRST, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: What a row is in its slice of time: a row to be counted, the end of a look-back, its begin.
POINT, UPTO, FROM = 1, 2, 4
START, ASK, END = 0, 1, 2


def _numbers(value: Column, kind: T.DataType) -> list[Column]:
    """Columns, whole or floating, that order as value does, the first one first."""
    if isinstance(kind, T.DecimalType):
        if kind.precision <= 18:
            return [(value * F.lit(10**kind.scale)).cast("long")]
        whole = F.floor(value)
        return [whole.cast("long"), ((value - whole) * F.lit(10**kind.scale)).cast("long")]
    return [value if isinstance(kind, T.FractionalType) else value.cast("long")]


def _ints(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Whole numbers in the order of the values, for floating ones in Spark's order."""
    values = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    if values.dtype.kind != "f":
        return values.astype(np.int64)
    values = values.astype(np.float64) + 0.0
    bits = np.where(np.isnan(values), np.nan, values).view(np.int64)
    return np.where(bits < 0, bits ^ LAST, bits)


def _upto(marks: Sequence[np.ndarray], keys: Sequence[np.ndarray]) -> np.ndarray:
    """How many of the ordered marks are at or before each key; columns are compared from the first on."""
    size = len(marks[0])
    low, high = np.zeros(len(keys[0]), np.int64), np.full(len(keys[0]), size, np.int64)
    for _ in range(size.bit_length()):
        at = (low + high) >> 1
        before, equal = np.zeros(len(low), bool), np.ones(len(low), bool)
        for m, k in zip(marks, keys, strict=True):
            here = m[np.minimum(at, size - 1)]
            before |= equal & (here < k)
            equal &= here == k
        before |= equal
        more = low < high
        low, high = np.where(more & before, at + 1, low), np.where(more & ~before, at, high)
    return low


def _dominated(order: np.ndarray, rank: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each item, the weight of those earlier in `order` that have a lower rank.

    From the highest bit of the ranks to the lowest, items are kept in groups of equal
    higher bits, each in the given order: an item with the bit gets the weight of
    those without it that stand before it in its group.
    """
    ids, rank, weight = order, rank[order], weight[order]
    total, place = np.zeros(len(order), np.int64), np.arange(len(order))
    for bit in reversed(range(int(rank.max(initial=0)).bit_length())):
        group, has = rank >> (bit + 1), (rank >> bit) & 1 == 1
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[first, len(group)])
        lacking = np.where(has, 0, weight)
        seen, without = np.cumsum(lacking), np.cumsum(~has)
        total += np.where(has, seen - np.repeat(seen[first] - lacking[first], sizes), 0)
        begin = np.repeat(first, sizes)
        mine = without - np.repeat(without[first] - ~has[first], sizes)  # without the bit, up to here in the group
        all_mine = np.repeat(mine[np.r_[first[1:], len(group)] - 1], sizes)
        to = np.where(has, all_mine + place - mine, begin + mine - 1)
        moved = np.empty_like(place)
        moved[to] = place
        ids, rank, weight, total = ids[moved], rank[moved], weight[moved], total[moved]
    out = np.empty_like(total)
    out[ids] = total
    return out


def _names(prefix: str, found: Sequence[str]) -> list[str]:
    return [c for c in found if c.startswith(prefix) and c[len(prefix):].isdigit()]


def _frame(batch: pa.RecordBatch | pa.Table, rows: np.ndarray, names: Sequence[str], **more: np.ndarray) -> pa.Table:
    """The named columns of some rows, behind more columns."""
    own = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
    kept = own.select(names).take(pa.array(rows))
    return pa.table([*[pa.array(v) for v in more.values()], *kept.columns], names=[*more, *names])


def _slices(batch, cuts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the slices of time of itself, the end and the begin of its look-back."""
    queue, t, low, tie = (_ints(batch[c]) for c in ("_queue", "_t", "_low", "_tie"))
    return _upto(cuts, [queue, t, tie]), _upto(cuts, [queue, t, np.full(len(t), LAST)]), _upto(cuts, [queue, low, np.full(len(t), FIRST)])


def _value_slices(batch, cuts: Sequence[np.ndarray], prefix: str, kind: int) -> np.ndarray:
    values = [_ints(batch[c]) for c in _names(prefix, batch.schema.names)]
    tie = np.zeros(len(values[0]), np.int64) if kind == ASK else _ints(batch["_tie"])
    return _upto(cuts, [*values, np.full(len(tie), kind), tie])


def _of_time(cuts, names):
    """Rows for their slices of time."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, upto, since = _slices(batch, cuts)
            point, asks = (batch[c].to_numpy(zero_copy_only=False) for c in ("_point", "_asks"))
            role = asks * UPTO + (point & (own == upto)) * POINT + (asks & (since == upto)) * FROM
            parts = [(role > 0, upto, role), (point & (own != upto), own, None), (asks & (since != upto), since, None)]
            for (some, slices, roles), else_role in zip(parts, (0, POINT, FROM), strict=True):
                rows = np.flatnonzero(some)
                roles = roles[rows] if roles is not None else np.full(len(rows), else_role)
                yield from _frame(batch, rows, names, _slice=slices[rows].astype(np.int32), _role=roles.astype(np.int8)).to_batches()

    return file


def _in_time(keep):
    """(keep, _n) of the requests of a slice of time, by the rows in it."""

    def count(table: pa.Table) -> pa.Table:
        role = _ints(table["_role"])
        queue, t, low = (_ints(table[c]) for c in ("_queue", "_t", "_low"))
        point, upto, since = (np.flatnonzero(role & bit) for bit in (POINT, UPTO, FROM))
        by_time = np.lexsort((t[point], queue[point]))
        marks = [queue[point][by_time], t[point][by_time], np.zeros(len(point), np.int64)]
        rank = np.empty(len(point), np.int64)
        rank[by_time] = np.arange(len(point))
        bounds = [_upto(marks, [queue[rows], v[rows], np.full(len(rows), tie)]) for rows, v, tie in ((upto, t, 0), (since, low, -1))]
        starts, ends = ([_ints(table[c]) for c in _names(p, table.column_names)] for p in ("_s", "_e"))
        values = [np.concatenate([s[point], s[upto], s[since], e[point]]) for s, e in zip(starts, ends, strict=True)]
        sizes = (len(point), len(upto), len(since), len(point))
        order = np.lexsort((np.repeat((START, ASK, ASK, END), sizes), *values[::-1]))
        got = _dominated(order, np.concatenate([rank, *bounds, rank]), np.repeat((1, 0, 0, -1), sizes))
        n = np.zeros(len(role), np.int64)
        n[upto] += got[len(point):][: len(upto)]
        n[since] -= got[len(point) + len(upto):][: len(since)]
        rows = np.flatnonzero(role & (UPTO | FROM))
        return _frame(table, rows, keep, _n=n[rows]).select([*keep, "_n"])

    return count


def _of_values(time_cuts, value_cuts, keep):
    """Starts, ends, and requests that reach over several slices of time, for their slices of values."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, upto, since = _slices(batch, time_cuts)
            point, asks = (batch[c].to_numpy(zero_copy_only=False) for c in ("_point", "_asks"))
            names = batch.schema.names
            for prefix, kind, some in (("_s", START, point), ("_s", ASK, asks & (since < upto)), ("_e", END, point)):
                rows = np.flatnonzero(some)
                values = _names(prefix, names)
                slices = _value_slices(batch, value_cuts, prefix, kind)
                first, past = (since, upto) if kind == ASK else (own, own)
                out = _frame(batch, rows, [*values, *keep], _slice=slices[rows].astype(np.int32), _role=np.full(len(rows), kind, np.int8),
                             _first=first[rows].astype(np.int32), _past=past[rows].astype(np.int32))
                if kind != ASK:  # nobody asks who it is
                    for c in keep:
                        at = out.column_names.index(c)
                        out = out.set_column(at, c, pa.nulls(len(rows), out.schema.field(c).type))
                out = out.rename_columns(["_slice", "_role", "_first", "_past", *[f"_x{i}" for i in range(len(values))], *keep])
                yield from out.to_batches()

    return file


def _in_values(whole, keep):
    """(keep, _n) of the requests in a slice of values, by the rows of whole slices of time."""

    def count(table: pa.Table) -> pa.Table:
        role, first, past = (_ints(table[c]) for c in ("_role", "_first", "_past"))
        asks, rows = np.flatnonzero(role == ASK), np.flatnonzero(role != ASK)
        if not len(asks):
            return _frame(table, asks, keep, _n=np.zeros(0, np.int64)).select([*keep, "_n"])
        take = np.concatenate([rows, asks, asks])
        values = [_ints(table[c])[take] for c in _names("_x", table.column_names)]
        got = _dominated(np.lexsort((role[take], *values[::-1])), np.concatenate([first[rows], past[asks], first[asks]]),
                         np.r_[np.where(role[rows] == START, 1, -1), np.zeros(2 * len(asks), np.int64)])
        slice_ = table["_slice"][0].as_py()
        below = whole.value[:, slice_]
        n = got[len(rows):][: len(asks)] - got[len(rows) + len(asks):] + below[past[asks]] - below[first[asks]]
        return _frame(table, asks, keep, _n=n).select([*keep, "_n"])

    return count


def _cells(time_cuts, value_cuts, across):
    """Starts less ends in each pair of a slice of time and one of values."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _slices(batch, time_cuts)[0]
            point = batch["_point"].to_numpy(zero_copy_only=False)
            for prefix, kind, weight in (("_s", START, 1), ("_e", END, -1)):
                cells = (own * across + _value_slices(batch, value_cuts, prefix, kind))[point]
                cell, n = np.unique(cells, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n * weight)], names=["cell", "n"])

    return count


def _workers_find(spark) -> None:
    """Let Python workers find the package where it lies on the driver's path alone."""
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))


def _cuts(rows: list[tuple], pieces: int) -> list[np.ndarray]:
    """Places that cut ordered rows into that many pieces of about one size, by column."""
    rows = sorted(rows)
    found = sorted({rows[i * len(rows) // pieces] for i in range(1, pieces)}) if rows else []
    return [np.array([r[i] for r in found], np.int64) for i in range(len(rows[0]) if rows else 0)]


def counted(base: DataFrame, queue: Sequence[str], slice_rows: int = SLICE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Two written tables (queue, _id, _n) whose numbers add up to what a request counts.

    base has the queue's columns, a struct _id, the numbers _start and _end, and longs _ts
    and _low. Rows without a time, start or end neither count nor ask; those that end
    before they start are not counted, and those whose look-back ends before it begins do
    not ask. Queues are told apart by a hash of 64 bits.
    """
    spark = base.sparkSession
    _workers_find(spark)
    keep = [*queue, "_id"]
    kind = base.select(F.array("_start", "_end").alias("a")).schema["a"].dataType.elementType
    start, end = (F.col(c).cast(kind) for c in ("_start", "_end"))
    starts, ends = _numbers(start, kind), _numbers(end, kind)
    known = base.where("_ts IS NOT NULL AND _start IS NOT NULL AND _end IS NOT NULL AND _low IS NOT NULL")
    rows = known.select(
        F.xxhash64(F.lit("queue"), *queue).alias("_queue"), F.xxhash64("_id", "_ts", "_start", "_end").alias("_tie"), F.col("_ts").cast("long").alias("_t"),
        F.col("_low").cast("long").alias("_low"), *[c.alias(f"_s{i}") for i, c in enumerate(starts)], *[c.alias(f"_e{i}") for i, c in enumerate(ends)],
        (end >= start).alias("_point"), (F.col("_low") <= F.col("_ts")).alias("_asks"), *queue, "_id",
    )
    total = base.count()  # reads no column; that some may be null does not matter for a number of slices
    pieces = min(MOST_SLICES, math.ceil(total / slice_rows))
    time_cuts, value_cuts = [np.zeros(0, np.int64)] * 3, [np.zeros(0, np.int64)] * (len(starts) + 2)
    if pieces > 1:
        names = [*_names("_s", rows.columns), *_names("_e", rows.columns)]
        seen = rows.select("_queue", "_t", "_tie", *names).sample(min(1.0, pieces * LOOKED_AT / total), 7).toArrow()
        queues, times, ties = (_ints(seen[c]).tolist() for c in ("_queue", "_t", "_tie"))
        time_cuts = _cuts([*zip(queues, times, ties, strict=True)], pieces) or time_cuts
        values = [(p, k, zip(*[_ints(seen[c]).tolist() for c in _names(p, names)], strict=True)) for p, k in (("_s", START), ("_e", END))]
        value_cuts = _cuts([(*v, k, tie) for _, k, found in values for v, tie in zip(found, ties, strict=True)], pieces) or value_cuts
    fields = {f.name: T.StructField(f.name, f.dataType) for f in rows.schema}
    schema = lambda *own: T.StructType([*own, *[fields[c] for c in keep]])
    slice_, role = T.StructField("_slice", T.IntegerType()), T.StructField("_role", T.ByteType())
    result = T.StructType([*[fields[c] for c in keep], T.StructField("_n", T.LongType())])

    moved = ["_queue", "_t", "_low", *_names("_s", rows.columns), *_names("_e", rows.columns), *keep]
    filed = rows.mapInArrow(_of_time(time_cuts, moved), T.StructType([slice_, role, *[fields[c] for c in moved]]))
    near = written(filed.groupBy("_slice").applyInArrow(_in_time(keep), result), "look-back-near")

    across = len(value_cuts[0]) + 1
    whole = np.zeros((len(time_cuts[0]) + 2, across + 1), np.int64)
    cells = rows.mapInArrow(_cells(time_cuts, value_cuts, across), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    if pieces > 1:
        found = cells.toArrow()
        cell, n = (_ints(found[c]) for c in ("cell", "n"))
        np.add.at(whole, (cell // across + 1, cell % across + 1), n)
        whole = whole.cumsum(0).cumsum(1)
    held = spark.sparkContext.broadcast(whole)
    numbers = [T.StructField(f"_x{i}", rows.schema[f"_s{i}"].dataType) for i in range(len(starts))]
    places = [T.StructField("_first", T.IntegerType()), T.StructField("_past", T.IntegerType())]
    far = rows if pieces > 1 else rows.limit(0)
    far = far.mapInArrow(_of_values(time_cuts, value_cuts, keep), schema(slice_, role, *places, *numbers))
    return near, written(far.groupBy("_slice").applyInArrow(_in_values(held, keep), result), "look-back-far")
