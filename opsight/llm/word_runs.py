"""Periodic runs of words by a dictionary of basic factors.

A basic factor is the stretch of L words from a position on, for L = 1, 2, 4 ... Each
level names the factors of all positions: equal names, equal words. A factor twice as
long is named by the pair of its halves, so no words are compared again. Places of one
name whose successor lies within 2 L words form arithmetic progressions; the step of a
progression of three places or more is proposed as a period. With L from the period q
up to 2 q, a factor inside a run comes back after exactly q words, and a run of 4 q
words has room for three such places, so every run is proposed. A proposal is extended
to both sides as far as words q apart are equal; proposals inside a run already found
are passed over. A factor without a like one within a quarter of its text, the longest
period there is, cannot be part of a longer one that matters and is dropped, so in prose
few places are left after some levels.

The texts of a batch are laid out as one sequence with a symbol of its own behind each
text, so nothing crosses a border. Work needs some 60 bytes a word of one slice of
`SLICE` bytes, or of the longest text where that is longer.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsight.llm.common import free_name, give_back, ready
from opsight.llm.words import batches

#: Bytes of texts that are searched at once.
SLICE = 2 << 20
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20
_FAR = np.iinfo(np.int32).max
_SPACE = re.compile(rb"[\t-\r ]")

RUN = T.StructType([T.StructField(name, T.LongType(), False) for name in ("start", "length", "period")])
_RUN = pa.struct([pa.field(name, pa.int64(), False) for name in ("start", "length", "period")])


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded number of bytes at a time."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE)
        to = cut.start() if cut else len(text)
        yield text[at:to].split()
        at = to


def numbered(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers, each text followed by a number of its own, and where each text starts."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    parts, starts, at = [], [0], 0
    for text in texts:
        for own in pieces(text):
            parts.append(np.fromiter(map(number.__getitem__, own), np.int32, len(own)))
            at += len(own)
        parts.append(None)
        at += 1
        starts.append(at)
    ends = iter(range(len(number), len(number) + len(texts)))
    parts = [np.array([next(ends)], np.int32) if p is None else p for p in parts]
    return np.concatenate([*parts, np.zeros(0, np.int32)]), np.array(starts)


def proposals(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(period, place) of the progressions of all levels, sorted, each once. Texts begin at `starts`, the last of which is the end."""
    sizes = np.diff(starts)
    quarter = np.repeat((sizes // 4).astype(np.int32), sizes)
    longest = int(sizes.max(initial=0))
    found = [np.zeros((0, 2), np.int64)]
    names = np.full(len(words), -1, np.int32)
    places, size = np.arange(len(words), dtype=np.int32), 1
    name = np.repeat(np.arange(len(sizes)) * (int(words.max(initial=0)) + 1), sizes) + words  # names of a text are its own
    while len(places) > 2 and 2 * size <= longest:
        order = np.argsort(name, kind="stable")
        at, name = places[order], name[order]
        same = name[1:] == name[:-1]
        gap = np.full(len(at), _FAR, np.int32)
        gap[:-1][same] = np.diff(at)[same]
        first = np.r_[True, gap[1:] != gap[:-1]]
        third = np.r_[gap[1:] == gap[:-1], False]
        good = np.flatnonzero(first & third & (gap <= 2 * size) & (2 * gap > size))
        found.append(np.stack([gap[good], at[good]], 1).astype(np.int64))
        near = gap <= quarter[at]
        near[1:] |= near[:-1]
        names[at[near]] = np.cumsum(np.r_[0, ~same])[near]
        halves = np.sort(at[near])
        left = halves[halves < len(words) - size]
        left = left[names[left + size] >= 0]
        name = names[left].astype(np.int64) * len(at) + names[left + size]
        names[halves] = -1
        places, size = left, 2 * size
    return np.unique(np.concatenate(found), axis=0)


def _equal_until(words: np.ndarray, at: int, period: int) -> int:
    """The first place from `at` on whose word differs from the one a period later."""
    step, end = 64, len(words) - period
    while at < end:
        to = min(at + step, end)
        off = np.flatnonzero(words[at:to] != words[at + period : to + period])
        if len(off):
            return at + int(off[0])
        at, step = to, min(2 * step, 1 << 16)
    return end


def _equal_from(words: np.ndarray, at: int, period: int) -> int:
    """The first place of the stretch before `at` whose words equal those a period later."""
    step = 64
    while at > 0:
        to = max(at - step, 0)
        off = np.flatnonzero(words[to:at] != words[to + period : at + period])
        if len(off):
            return to + int(off[-1]) + 1
        at, step = to, min(2 * step, 1 << 16)
    return 0


def runs(words: np.ndarray, starts: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """(start, length, period) of every run of at least max(least, times * period) words, by start, then period.

    times is 4 or more: shorter runs need not be proposed.
    """
    if times < 4:
        raise ValueError("runs of fewer than four periods are not all proposed")
    out, own, end = [], 0, 0
    for period, place in proposals(words, starts).tolist():
        if period == own and place < end:
            continue
        start = _equal_from(words, place, period)
        end, own = _equal_until(words, place, period), period
        length = end + period - start
        if length >= max(least, times * period):
            out.append((start, length, period))
    return np.array(sorted(out), np.int64).reshape(-1, 3)


def _without(text: bytes, gone: np.ndarray) -> str:
    """The words of a text that are not gone, joined by one space."""
    at, kept = 0, []
    for own in pieces(text):
        drop = gone[at : at + len(own)]
        at += len(own)
        own = [w for w, d in zip(own, drop.tolist(), strict=True) if not d] if drop.any() else own
        if own:
            kept.append(b" ".join(own))
    return b" ".join(kept).decode("utf-8", "replace")


def search(texts: Sequence[bytes], least: int = 6, times: int = 4) -> Iterator[tuple[int, np.ndarray, str]]:
    """Number of words, runs, and the text without repeated periods, of each text."""
    words, starts = numbered(texts)
    sizes = np.diff(starts) - 1
    found = runs(words, starts, least, times)
    owner = np.searchsorted(starts, found[:, 0], "right") - 1
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    change = np.zeros(len(words) + 1, np.int32)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    gone = np.cumsum(change) > 0
    for i, text in enumerate(texts):
        own = found[edges[i] : edges[i + 1]] - [[starts[i], 0, 0]]
        yield int(sizes[i]), own, _without(text, gone[starts[i] : starts[i + 1]])


def find_runs(df: DataFrame, text: str = "text", least: int = 6, times: int = 4, keep: Sequence[str] | None = None) -> DataFrame:
    """df with n_words, runs (start, length, period by start, then period) and collapsed, the text in
    which each run is cut to its first period and words are joined by one space.

    A run is a stretch of words with smallest period q, of at least max(least, times * q)
    words, that no neighbouring word extends. Null and empty texts have no words, no runs
    and an empty collapsed text; repeated rows each keep their own result; a text of any
    length is searched whole. Other columns (or those in `keep`) are passed on; existing
    columns named n_words, runs or collapsed are replaced.
    """
    ready(df.sparkSession)
    made = ("n_words", "runs", "collapsed")
    keep = [c for c in (df.columns if keep is None else keep) if c not in made]
    schema = T.StructType([df.schema[c] for c in keep]).add("n_words", T.LongType()).add("runs", T.ArrayType(RUN, False)).add("collapsed", T.StringType())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for start, end, data, offsets in batches(part.column(len(keep)), SLICE):
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
                sizes, found, short = zip(*search(texts, least, times), strict=True)
                flat = np.concatenate(found)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *map(len, found)]), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], fields=list(_RUN)),
                )
                kept = part.slice(start, end - start)
                columns = [kept.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), lists, pa.array(short, pa.string())], [*keep, *made])
        give_back()

    return df.select(*keep, F.col(text).cast("binary").alias(free_name("__text", keep))).mapInArrow(run, schema)
