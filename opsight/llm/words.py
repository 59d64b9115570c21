"""Words of UTF-8 texts as 64-bit hashes, a whole batch at a time in numpy.

A word is a run of bytes that are none of space, tab, line feed, vertical tab, form
feed and carriage return. Its hash is a polynomial over a random value per byte,
taken from prefix sums modulo 2**64, and mixed. The constants are fixed, so equal
words have equal hashes on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_BASE = np.uint64(0xD1342543DE82EF95)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _inverse() -> np.uint64:
    return np.uint64(pow(int(_BASE), -1, 1 << 64))


def _table(base: np.uint64, n: int) -> np.ndarray:
    table = np.full(n, base, np.uint64)
    table[0] = 1
    return np.multiply.accumulate(table)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > SLICE:  # one very long text
        return tuple(_table(base, n) for base in (_BASE, _inverse()))
    if len(_powers[0]) < n:
        _powers[:] = [_table(base, SLICE) for base in (_BASE, _inverse())]
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """Words of several texts: hashes, byte ranges in `data`, and the first word of each text."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # one more entry than texts

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


#: Bytes hashed at once, which bounds the temporary arrays.
SLICE = 1 << 20


def words(data: np.ndarray, offsets: np.ndarray, fold: bool) -> Words:
    """Words of the texts data[offsets[i]:offsets[i + 1]]; fold takes A-Z as a-z."""
    parts, at = [], 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        base = offsets[at]
        hashes, starts, ends = _words(data[base : offsets[to]], offsets[at : to + 1] - base, fold)
        parts.append((hashes, starts + base, ends + base))
        at = to
    if not parts:
        parts.append(_words(data[:0], offsets[:1], fold))
    hashes, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets))


def _words(data: np.ndarray, offsets: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inner[:-1]
    starts = np.flatnonzero(inner & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inner[1:]
    ends = np.flatnonzero(inner & (~after | edge[1:])) + 1
    up, down = _power_tables(n)
    value = (_FOLDED if fold else _BYTE)[data]
    value *= up
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(value, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts, ends


def runs(hashes: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Hash of the `length` words from each position on (as many as fit)."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    rng = np.random.Generator(np.random.PCG64(7919 * length + salt))
    factors = rng.integers(0, 1 << 63, length, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    total = hashes[:n] * factors[0]
    for i in range(1, length):
        total += hashes[i : i + n] * factors[i]
    return mix(total)


def batches(column, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of an Arrow binary column: rows from and to, their bytes, and offsets into them.

    Nulls count as empty. A slice ends once it has `limit` bytes, so a longer text
    is in a slice of at most `limit` bytes more than its own.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    if column.null_count:
        column = pc.fill_null(column, b"")
    raw = column.buffers()
    n = len(column)
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(raw[1], kind)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(raw[2], np.uint8) if n and raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        end = min(end, n)
        yield start, end, data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end
