"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

Entries are taken on a lattice, x = floor(steps * c) + shift, as whole numbers, so
sums over rows are exact. The fit list holds each distinct x vector once, in blocks of
rows, as a written table. With X the centred rows of that list, the bidiagonalisation
alternates u = X v - beta u' and v' = X'u - alpha v. A left vector is as long as the
list; it is kept as the short w with u = X w, so one pass over the blocks per step does
both products: from z it gives |X z|^2 and X'(X z), and the scalar products of X z with
all earlier left vectors are those of z with the X'u known from earlier passes. Left and
right vectors are orthogonalised against all earlier ones, twice. The singular value
decomposition of the small bidiagonal matrix on the driver gives components and
deviations; a component has converged when its residual is at rounding level. Where the
process ends early it goes on with a new vector, so equal eigenvalues are all found.

A pass sends one row of partial sums per task and entry to a grouped sum; the driver
gets as many numbers as a vector has entries. Nothing grows with the rows but the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsight.llm.common import free_name, ready, written

#: Bytes of one block of the fit list.
BLOCK_BYTES = 1 << 20
#: Entries a vector may have; the driver holds a few matrices of that many rows.
MAX_ENTRIES = 1 << 14
#: Residual, as a share of the largest singular value, at which a component has converged.
CONVERGED = 1e-14
#: Singular values below this share of the largest count as zero.
RANK = 1e-9


@dataclass(frozen=True)
class Model:
    """Centre, components and deviations of a fit list."""

    entries: int
    steps: int
    shift: int
    n: int
    sums: tuple[int, ...]
    components: np.ndarray  # entries x components
    values: np.ndarray  # eigenvalues of the covariance
    trace: float
    identity_error: float

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) for v in self.values]


def valid(vector: str | Column) -> Column:
    """Whether a vector is there and holds neither null nor non-finite entries."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return v.isNotNull() & ~F.coalesce(F.exists(v, bad), F.lit(False))


def lattice(column: pa.Array, entries: int, steps: int, shift: int) -> np.ndarray:
    """Vectors as rows of whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, entries)
    scaled = np.floor(steps * flat)
    if len(scaled) and max(scaled.max(), -scaled.min()) >= 2.0**52:
        raise OverflowError("an entry too large for the lattice")
    return scaled.astype(np.int64) + shift


def _centre(n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Whole part and remainder of the means: x - mean is (x - whole) - remainder / n."""
    return np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)


def _fit_list(rows: DataFrame, entries: int, steps: int, shift: int) -> DataFrame:
    """The distinct x vectors of rows(v) in blocks, as a written table."""

    def key(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = lattice(part.column(0), entries, steps, shift)
            offsets = pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * np.int32(8 * entries))
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(x), [None, offsets, pa.py_buffer(x.astype("<i8").tobytes())])], ["x"])

    def block(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in parts:
            for x in part.column(0).to_pylist():
                held.append(x)
                size += len(x)
                if size >= BLOCK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["rows"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["rows"])

    return written(rows.mapInArrow(key, "x binary").distinct().mapInArrow(block, "rows binary"), "whitening")


def _summed(blocks: DataFrame, entries: int, width: int, of: Callable[[np.ndarray], np.ndarray], whole: bool = False) -> np.ndarray:
    """Sum over all blocks of `width` numbers each. Adds up per task, then by place in a grouped sum."""
    kind = np.int64 if whole else np.float64

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(width, kind), False
        for part in parts:
            for raw in part.column(0):
                total += of(np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, entries))
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], ["i", "value"])

    sums = blocks.mapInArrow(run, f"i long, value {'long' if whole else 'double'}").groupBy("i").agg(F.sum("value").alias("value"))
    out = np.zeros(width, kind)
    for i, value in sums.collect():  # `width` rows
        out[i] = value
    return out


def _against(vector: np.ndarray, basis: list[np.ndarray], duals: list[np.ndarray]) -> np.ndarray:
    """vector less its parts along basis, measured by duals, twice."""
    if basis:
        b, d = np.array(basis), np.array(duals)
        for _ in range(2):
            vector = vector - (d @ vector) @ b
    return vector


def bidiagonal(entries: int, product: Callable[[np.ndarray], tuple[np.ndarray, float]], wanted: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest singular values of X and their right vectors, as columns.

    product(z) gives X'(X z) and |X z|^2; scale is the root of the sum of all squares.
    """
    rng = np.random.default_rng(20240601)
    right, left, duals, alphas, betas = [], [], [], [], []
    fresh = lambda: (r := _against(rng.standard_normal(entries), right, right)) / np.linalg.norm(r)
    v, beta = fresh(), 0.0
    while True:
        z = _against(v - beta * left[-1] if beta else v, left, duals)
        g, square = product(z)
        alpha = float(np.sqrt(max(square, 0.0)))
        right.append(v)
        if alpha <= 1e-12 * scale:  # X v lies in what the left vectors span
            alpha, w, h = 0.0, np.zeros(entries), np.zeros(entries)
        else:
            w, h = z / alpha, g / alpha
        left.append(w)
        duals.append(h)
        alphas.append(alpha)
        small = np.diag(alphas) + np.diag(betas, 1)
        p, s, qt = np.linalg.svd(small)
        if len(alphas) == entries:
            break
        r = _against(h - alpha * v, right, right)
        beta = float(np.linalg.norm(r))
        if beta <= 1e-12 * scale or alpha == 0.0:  # an invariant part is found: go on outside of it
            beta, v = 0.0, fresh()
        else:
            v = r / beta
            if len(s) > wanted and (beta * np.abs(p[-1, :wanted]) <= CONVERGED * s[0]).all():
                break
        betas.append(beta)
    return s[:wanted], (np.array(right).T @ qt.T)[:, :wanted]


def fit(df: DataFrame, vector: str = "embedding", components: int = 16, steps: int = 64, shift: int = 1_000_000) -> Model:
    """Centre and components of the distinct lattice vectors of df.

    Vectors that are null, hold null or non-finite entries, or are not as long as most
    others take no part. Components whose deviation is zero are left out, so one distinct
    vector or an empty table has none.
    """
    ready(df.sparkSession)
    rows = df.select(F.col(vector).cast("array<double>").alias("v")).where(valid("v"))
    entries = rows.agg(F.mode(F.size("v"), True)).first()[0] or 0
    if entries > MAX_ENTRIES:
        raise ValueError(f"vectors of {entries} entries; {MAX_ENTRIES} are the most")
    none = Model(entries, steps, shift, 0, (), np.zeros((entries, 0)), np.zeros(0), 0.0, 0.0)
    if not entries:
        return none
    blocks = _fit_list(rows.where(F.size("v") == entries), entries, steps, shift)
    first = _summed(blocks, entries, entries + 1, lambda x: np.r_[len(x), x.sum(axis=0)], whole=True)
    n, sums = int(first[0]), tuple(map(int, first[1:]))
    if not n:
        return none
    whole, rest = _centre(n, sums)
    centred = lambda x: (x - whole) - rest / n
    squares = float(_summed(blocks, entries, 1, lambda x: np.array([np.square(centred(x)).sum()]))[0])
    if squares == 0.0:
        return Model(entries, steps, shift, n, sums, np.zeros((entries, 0)), np.zeros(0), 0.0, 0.0)

    def product(z: np.ndarray) -> tuple[np.ndarray, float]:
        def both(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            u = c @ z
            return np.r_[c.T @ u, u @ u]

        out = _summed(blocks, entries, entries + 1, both)
        return out[:-1], float(out[-1])

    s, vectors = bidiagonal(entries, product, min(components, entries), float(np.sqrt(squares)))
    there = s > RANK * s[0]
    s, vectors = s[there], vectors[:, there]
    values = s**2 / n
    axes, k = vectors / np.sqrt(values), len(s)

    def moments(x: np.ndarray) -> np.ndarray:
        y = centred(x) @ axes
        return np.r_[y.sum(axis=0), (y.T @ y).ravel()]

    out = _summed(blocks, entries, k + k * k, moments) / n
    error = np.abs(out[k:].reshape(k, k) - np.outer(out[:k], out[:k]) - np.eye(k)).max(initial=0.0)
    return Model(entries, steps, shift, n, sums, vectors, values, squares / n, float(error))


def transform(df: DataFrame, model: Model, vector: str = "embedding", whitened: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """The rows of df whose vectors take part, with their whitened vector and their squared distance
    from the centre in units of 1 / n: the sum of (n x - S)^2, exact.

    Repeated rows each keep their own result; other columns are passed on; existing
    columns of these two names are replaced. A deviation beyond a long is an error.
    """
    keep = [c for c in df.columns if c not in (whitened, deviation)]
    schema = T.StructType([df.schema[c] for c in keep]).add(deviation, T.LongType()).add(whitened, T.ArrayType(T.DoubleType()))
    own = F.col(vector).cast("array<double>")
    rows = df.where(valid(own) & (F.size(own) == model.entries)).select(*keep, own.alias(free_name("__v", keep)))
    k = len(model.values)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not model.n:
            return
        whole, rest = _centre(model.n, model.sums)
        axes = model.components / np.sqrt(model.values)
        for part in parts:
            if not part.num_rows:
                continue
            x = lattice(part.column(len(keep)), model.entries, model.steps, model.shift) - whole
            if model.n * (float(np.abs(x).max()) + 1) * np.sqrt(model.entries) >= 2.0**31.5:
                off = [sum((model.n * a - b) ** 2 for a, b in zip(row, rest.tolist(), strict=True)) for row in x.tolist()]
                if max(off) >= 1 << 63:
                    raise OverflowError("a deviation beyond a long")
                off = np.array(off, np.int64)
            else:
                off = np.square(model.n * x - rest).sum(axis=1)
            y = (x - rest / model.n) @ axes
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(np.ascontiguousarray(y).ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(off), lists], [*keep, deviation, whitened])

    return rows.mapInArrow(run, schema)
