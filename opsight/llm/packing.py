"""Columns of numbers packed into compressed blocks, for shuffles of many small entries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

from opsight.llm.common import give_back


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length as one compressed block, each split into planes of equal bytes."""
    raw = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(len(columns[0]).to_bytes(8, "little") + raw)


def unpack(block: bytes, *kinds: type) -> list[np.ndarray]:
    """The columns of a block, given their types."""
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * size
    return out


def pieces_by(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each number that occurs, with its places in their given order."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for own in np.split(order, cuts):
        if len(own):
            yield int(part[own[0]]), own


def squeezed(text: Column) -> Column:
    """Binary texts compressed one by one, for shuffles and tables of many texts; null stays null."""

    @F.pandas_udf("binary")
    def squeeze(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compress = zstandard.ZstdCompressor(level=1).compress
        for texts in parts:
            yield pd.Series([None if t is None else compress(t) for t in texts], dtype=object)
        give_back()

    return squeeze(text)


def opened(block: bytes | None) -> bytes:
    """A text as it was before `squeezed`; null is empty."""
    return b"" if block is None else zstandard.ZstdDecompressor().decompress(block)
