"""BPE encoding and decoding by a pair occurrence index.

The distinct pre-tokens of a batch are laid out as one array of symbols. An index
maps each adjacent pair that has a rank to all its positions. The ranks that occur
are taken in ascending order; applying one merges its pair at every position and
moves the neighbouring pairs in the index. Pre-tokens met before in the same Python
worker come from a bounded memory of results.

Vocabulary and merges are read once on the driver from the tokenizer file (a
parameter) and broadcast: their size is that of the file, checked against
`MAX_FILE_BYTES`.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from opsight.llm.common import give_back

MAX_FILE_BYTES = 64 << 20
#: Distinct pre-tokens a Python worker remembers.
MEMORY = 100_000

# Fixed value: the pattern that cuts text into pre-tokens before byte-level merges.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SHIFT = 32


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = iter(range(256, 512))
    known = set(shown)
    return [chr(b) if b in known else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """The parts of a byte-level BPE file that encoding and decoding need."""

    def __init__(self, path: str):
        if os.path.getsize(path) > MAX_FILE_BYTES:
            raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes, the bound for a broadcast")
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cut = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or cut["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("only byte-level BPE without a normalizer is supported")
        if cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError("only the standard pre-token pattern without a prefix space is supported")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in neighbours are not supported")
        symbols, ids = byte_symbols(), model["vocab"]
        self.first = np.array([ids[s] for s in symbols])
        self.merges = []
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.append((ids[left], ids[right], ids[left + right]))
        keys = np.array([left << _SHIFT | right for left, right, _ in self.merges], np.int64)
        self._order = np.argsort(keys)
        self._keys = keys[self._order]
        back = {s: b for b, s in enumerate(symbols)}
        of = {i: bytes(back[c] for c in token) for token, i in ids.items()} | {i: token.encode() for token, i in self.added.items()}
        every = [of.get(i) for i in range(max(of) + 1)]
        self.token_sizes = np.array([-1 if b is None else len(b) for b in every])
        self.token_starts = np.cumsum(np.maximum(self.token_sizes, 0)) - np.maximum(self.token_sizes, 0)
        self.token_bytes = np.frombuffer(b"".join(b or b"" for b in every), np.uint8)
        self.key = (path, os.path.getmtime(path), len(ids))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 if it has none."""
        asked = left << _SHIFT | right
        at = np.minimum(np.searchsorted(self._keys, asked), len(self._keys) - 1)
        return np.where(self._keys[at] == asked, self._order[at], -1)


def merge_all(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pre-tokens in a row and how many each has, by one pass over the occurrence index.

    `symbol` holds the symbols of all pre-tokens, `after` and `before` their living
    neighbours (n where there is none). The index maps the rank of a pair to the
    positions of its left symbol; positions whose pair has gone are passed over.
    """
    data = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n = len(data)
    symbol = np.r_[vocabulary.first[data], -1]
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    ends = np.cumsum(sizes)
    begins = (ends - sizes)[sizes > 0]
    before[begins], after[ends[sizes > 0] - 1] = n, n
    where: dict[int, list[int]] = {}
    inner = np.flatnonzero(after[:n] < n)
    ranks = vocabulary.rank(symbol[inner], symbol[inner + 1])
    inner, ranks = inner[ranks >= 0], ranks[ranks >= 0]
    order = np.argsort(ranks, kind="stable")
    edges = np.r_[np.flatnonzero(np.diff(ranks[order], prepend=-1)), len(order)]
    for at, to in zip(edges, edges[1:], strict=False):
        where[int(ranks[order[at]])] = inner[order[at:to]].tolist()
    active = list(where)
    heapq.heapify(active)
    while active:
        rank = heapq.heappop(active)
        left, right, new = vocabulary.merges[rank]
        at = np.array(where.pop(rank))
        if left == right:  # of overlapping places the leftmost counts
            at = _leftmost(np.sort(at), after, symbol, left)
        to = after[at]
        good = (symbol[at] == left) & (symbol[to] == right)
        at, to = at[good], to[good]
        symbol[at], symbol[to] = new, -2
        then = after[to]
        after[at], before[then] = then, at
        then, prior = after[at], before[at]
        # the pairs on either side of each merged one are new
        place = np.concatenate((at[then < n], prior[prior < n]))
        lefts = symbol[place]
        ranks = vocabulary.rank(lefts, symbol[after[place]])
        for r, p in zip(ranks.tolist(), place.tolist(), strict=True):
            if r >= 0:
                known = where.get(r)
                if known is None:
                    where[r] = [p]
                    heapq.heappush(active, r)
                else:
                    known.append(p)
    alive = symbol[:n] >= 0
    counts = np.diff(np.r_[0, np.cumsum(alive)][np.r_[0, ends]])
    return symbol[:n][alive].astype(np.int32), counts


def _leftmost(at: np.ndarray, after: np.ndarray, symbol: np.ndarray, own: int) -> np.ndarray:
    taken, out = set(), []
    for i in at.tolist():
        j = int(after[i])
        if i not in taken and symbol[i] == own and symbol[j] == own:
            taken.update((i, j))
            out.append(i)
    return np.array(out, np.int64)


def expand(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches flat[start:start + size] one after the other."""
    ends = np.cumsum(sizes)
    if not len(ends):
        return flat[:0]
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])]


class Memory:
    """Numbers of the pre-tokens met so far and the token ids of each, up to a bound."""

    def __init__(self, key):
        self.key = key
        self.clear()

    def clear(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__  # an unknown pre-token gets the next number
        self.ids, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, vocabulary: Vocabulary) -> None:
        """Encode the pre-tokens that have a number but no ids yet."""
        fresh = list(islice(self.number, len(self.sizes), None))
        if not fresh:
            return
        ids, sizes = merge_all([b"" if w in vocabulary.added else w.encode() for w in fresh], vocabulary)
        special = [(i, vocabulary.added[w]) for i, w in enumerate(fresh) if w in vocabulary.added]
        for i, token in special:
            ids = np.insert(ids, sizes[:i].sum(), token)
            sizes[i] = 1
        self.ids = np.r_[self.ids, ids]
        self.sizes = np.r_[self.sizes, sizes]
        self.starts = np.cumsum(self.sizes) - self.sizes


_memory: list[Memory] = []


def encode_texts(texts: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts in a row, and how many each text has."""
    if not _memory or _memory[0].key != vocabulary.key:
        _memory[:] = [Memory(vocabulary.key)]
    memory = _memory[0]
    if len(memory.sizes) > MEMORY:
        memory.clear()
    cut = regex.compile(PRE_TOKEN).findall
    added = vocabulary.added
    split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
    number = memory.number.__getitem__
    numbers = []
    for text in texts:
        if split is not None and split.search(text):
            own = []
            for part in split.split(text):
                own.extend([part] if part in added else cut(part))
        else:
            own = cut(text)
        numbers.append(np.fromiter(map(number, own), np.int32, len(own)))
    memory.learn(vocabulary)
    flat = np.concatenate([*numbers, np.zeros(0, np.int32)])
    sizes = memory.sizes[flat]
    ends = np.cumsum([0, *map(len, numbers)])
    counts = np.diff(np.r_[0, np.cumsum(sizes)][ends])
    return expand(memory.ids, memory.starts[flat], sizes), counts


def _slices(sizes: list[int], limit: int) -> Iterator[slice]:
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", keep: Sequence[str] | None = None,
           decoded: str | None = None, chars_at_once: int = 500_000) -> DataFrame:
    """df with a column of token ids for the whole text of each row.

    A null text counts as empty and has no ids; repeated rows each keep their own
    result; every other column (or those in `keep`) is passed on. `decoded` names a
    column for the text that the ids stand for, decoded in the same pass. Existing
    columns of these names are replaced.
    """
    held = df.sparkSession.sparkContext.broadcast(Vocabulary(path))
    keep = [c for c in (df.columns if keep is None else keep) if c not in (ids, decoded)]
    schema = T.StructType([df.schema[c] for c in keep]).add(ids, T.ArrayType(T.IntegerType()))
    if decoded is not None:
        schema = schema.add(decoded, T.StringType())
    columns_made = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = held.value
        for batch in batches:
            texts = [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            for part in _slices(list(map(len, texts)), chars_at_once):
                flat, counts = encode_texts(texts[part], vocabulary)
                ends = np.r_[0, np.cumsum(counts)].astype(np.int32)
                kept = batch.slice(part.start, part.stop - part.start)
                columns = [kept.column(kept.schema.get_field_index(c)) for c in keep]
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                if decoded is not None:
                    columns.append(pa.array(decode_ids(flat, counts, vocabulary), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, columns_made)
        give_back()

    return df.mapInArrow(run, schema)


def decode_ids(ids: np.ndarray, counts: np.ndarray, vocabulary: Vocabulary) -> list[str]:
    """Texts of the given numbers of ids each; what is no UTF-8 becomes U+FFFD."""
    sizes = vocabulary.token_sizes[ids]
    if len(sizes) and sizes.min() < 0:
        raise ValueError("an id that the vocabulary lacks")
    raw = expand(vocabulary.token_bytes, vocabulary.token_starts[ids], sizes).tobytes()
    ends = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(counts)]].tolist()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text that its token ids stand for.

    Bytes that are no UTF-8 become U+FFFD; null ids give an empty text; an id the
    vocabulary lacks is an error. An existing column of the name `text` is replaced.
    """
    held = df.sparkSession.sparkContext.broadcast(Vocabulary(path))
    schema = T.StructType([f for f in df.schema if f.name != text] + [T.StructField(text, T.StringType())])
    keep = [f.name for f in df.schema if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        for batch in batches:
            lists = pc.fill_null(batch.column(batch.schema.get_field_index(ids)), [])
            counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            for part in _slices(counts.tolist(), 200_000):
                kept = batch.slice(part.start, part.stop - part.start)
                own = lists.slice(part.start, part.stop - part.start).flatten().to_numpy(zero_copy_only=False)
                out = decode_ids(own, counts[part], v)
                columns = [kept.column(kept.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.string())], [*keep, text])
        give_back()

    return df.mapInArrow(run, schema)
