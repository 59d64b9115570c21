"""Repeated passages by prefix-partitioned suffix trees.

Suffixes are runs of words, cut at `length` words, since a repeat counts from that
depth on. They are split by variable-length prefixes into groups that fit a task:
first by their first 4 words; prefixes that are frequent in the corpus are lengthened
to 8 words and then to the whole run. In a group the suffixes are sorted by the label
of their path; the leaves below one internal node of depth `length` are then next to
each other, and all of them that belong to another document than the smallest one are
repeats. Overlapping repeats together give the maximal ones.

Suffixes travel packed: per chunk of text and group one compressed block of columns
(path label, document, position). Of suffixes with one label in a chunk only those of
the chunk's smallest document are sent, so that a passage in every document costs one
entry per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsight.llm.packing import opened, pack, pieces_by, squeezed, unpack
from opsight.llm.words import batches, runs, words

LENGTH = 13
#: Lengths of the prefixes, short of the whole run.
PREFIXES = (4, 8)
#: Suffixes that a group should have at most.
GROUP_SUFFIXES = 250_000
#: Bytes of text in a chunk, and of the documents in a bucket of the last step.
CHUNK_BYTES, BUCKET_BYTES = 6 << 20, 4 << 20
#: A prefix this often in a chunk is reported as possibly frequent.
REPORTED = 8


def _cat(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(p) for p in zip(*parts, strict=True)]


def _within(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in a sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _windows(data: np.ndarray, offsets: np.ndarray, length: int):
    """Word hashes and, for each place where a run of `length` words of one text starts, its place and text."""
    found = words(data, offsets, fold=False)
    n = len(found.hashes)
    text = np.repeat(np.arange(len(offsets) - 1), found.counts())
    starts = np.arange(max(n - length + 1, 0))
    starts = starts[text[starts] == text[starts + length - 1]] if len(starts) else starts
    return found, starts, text


def frequent_prefixes(texts: DataFrame, length: int, group: int) -> tuple[list[np.ndarray], int]:
    """For each prefix length the hashes of prefixes too frequent for a group, and the number of words.

    Every text is counted: chunks report the prefixes that are frequent in them, and
    the reports are summed. At most 8 prefixes of a length per group are kept.
    """
    sizes = [p for p in PREFIXES if p < length]

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for _, _, data, offsets in batches(batch.column(0), CHUNK_BYTES):
                found, starts, _ = _windows(data, offsets, length)
                out = [(-1, 0, len(found.hashes))]
                for i, size in enumerate(sizes):
                    h = np.sort(runs(found.hashes, size)[starts])
                    edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
                    n = np.diff(np.r_[edge, len(h)])
                    out += [(i, int(v), int(k)) for v, k in zip(h[edge[n >= REPORTED]].view(np.int64), n[n >= REPORTED], strict=True)]
                yield pa.RecordBatch.from_pydict({"level": pa.array([o[0] for o in out], pa.int32()), "prefix": pa.array([o[1] for o in out], pa.int64()), "n": pa.array([o[2] for o in out], pa.int64())})

    sums = texts.select("text").mapInArrow(count, "level int, prefix long, n long").groupBy("level", "prefix").agg(F.sum("n").alias("n"))
    kept = sums.where((F.col("level") < 0) | (F.col("n") > group // 8)).toPandas()
    total = int(kept.loc[kept["level"] < 0, "n"].sum())
    tables = [np.sort(kept.loc[kept["level"] == i, "prefix"].to_numpy(np.int64).view(np.uint64)) for i in range(len(sizes))]
    return tables, total


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, buckets: int = 1, group: int = GROUP_SUFFIXES) -> DataFrame:
    """Packed places of runs that also start in a document with a smaller key: bucket, place.

    `bucket` deals the documents by a hash of their key; `place` is a block of keys,
    word numbers and check values that `unpack_places` opens.
    """
    texts = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
    frequent, total = frequent_prefixes(texts, length, group)
    groups = max(1, -(-total // group))
    held = docs.sparkSession.sparkContext.broadcast(frequent)
    sizes = [p for p in PREFIXES if p < length]

    def places(keys: np.ndarray, position: np.ndarray, label: np.ndarray) -> Iterator[tuple[int, bytes]]:
        for b, own in pieces_by(bucket_of(keys, buckets)):
            yield b, pack(keys[own], position[own], check_of(label[own]))

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for start, end, data, offsets in batches(batch.column(1), CHUNK_BYTES):
                found, starts, text_of = _windows(data, offsets, length)
                if not len(starts):
                    continue
                label = runs(found.hashes, length)[starts]
                own = keys[start:end][text_of[starts]]
                position = (starts - found.first[text_of[starts]]).astype(np.uint32)
                route = runs(found.hashes, sizes[0])[starts] if sizes else label
                for i, table in enumerate(held.value):
                    often = _within(route, table)
                    if often.any():
                        longer = runs(found.hashes, sizes[i + 1])[starts] if i + 1 < len(sizes) else label
                        route = np.where(often, longer, route)
                order = np.lexsort((own, label))
                label, own, position, route = label[order], own[order], position[order], route[order]
                head = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
                least = np.repeat(own[head], np.diff(np.r_[head, len(label)]))
                known = own > least  # a smaller document is in this very chunk
                rows = [(0, int(p), pack(label[i].view(np.uint8).reshape(-1, 8)[:, 1:], own[i], position[i])) for p, i in pieces_by((route % np.uint64(groups)).astype(np.int64)[~known]) for i in [np.flatnonzero(~known)[i]]]
                rows += [(1, b % groups, b.to_bytes(8, "little") + block) for b, block in places(own[known], position[known], label[known])]
                yield pa.RecordBatch.from_pydict({"kind": pa.array([r[0] for r in rows], pa.int32()), "part": pa.array([r[1] for r in rows], pa.int64()), "block": pa.array([r[2] for r in rows], pa.binary())})

    def tree(rows: pd.DataFrame) -> pd.DataFrame:
        out = [(int.from_bytes(b[:8], "little"), b[8:]) for b in rows.loc[rows["kind"] == 1, "block"]]
        blocks = [unpack(b, "V7", np.int64, np.uint32) for b in rows.loc[rows["kind"] == 0, "block"]]
        if blocks:
            seven, own, position = _cat(blocks)
            label = np.zeros((len(seven), 8), np.uint8)
            label[:, 1:] = seven.view(np.uint8).reshape(-1, 7)
            label = label.reshape(-1).view(np.uint64)
            order = np.lexsort((own, label))
            label, own, position = label[order], own[order], position[order]
            # the leaves of a deep node stand together, the smallest document first
            head = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
            least = np.repeat(own[head], np.diff(np.r_[head, len(label)]))
            again = own > least
            out += places(own[again], position[again], label[again])
        return pd.DataFrame(out, columns=["bucket", "place"])

    packed = texts.mapInArrow(cut, "kind int, part long, block binary")
    return packed.groupBy("part").applyInPandas(tree, "bucket long, place binary")


def check_of(label: np.ndarray) -> np.ndarray:
    """Two bytes of a label, of the seven that groups get."""
    return (label >> np.uint64(8)).astype(np.uint16)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    h = keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """key, n_words, n_removed and the kept words (joined by one space) of every row of docs.

    A word goes if it is in a run of `length` words of its document that also starts
    in a document with a smaller key; runs are judged on the input. A null text has
    no words; a row with a null key is compared with nothing and keeps all. Rows with
    one key are no repeats of each other, and each is judged on its own text. The key
    is an integer; other columns are not carried on.
    """
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    flags = repeats(docs, key, text, length, buckets)

    @F.pandas_udf("long")
    def bucket(keys: pd.Series) -> pd.Series:
        return pd.Series(bucket_of(keys.to_numpy(np.int64), buckets))

    own = docs.select(F.col(key).cast("long").alias("key"), squeezed(F.col(text).cast("binary")).alias("text"))
    known = own.where("key IS NOT NULL").withColumn("bucket", bucket("key"))
    plain = own.where("key IS NULL").mapInPandas(lambda parts: (_kept(p, np.zeros(0, np.int64), None, None, length) for p in parts), _KEPT)

    def judge(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        blocks = [unpack(b, np.int64, np.uint32, np.uint16) for b in found["place"]]
        keys, position, check = _cat(blocks) if blocks else (np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.uint16))
        order = np.argsort(keys, kind="stable")
        return _kept(rows, keys[order], position[order], check[order], length)

    judged = known.groupBy("bucket").cogroup(flags.groupBy("bucket")).applyInPandas(judge, _KEPT)
    return judged.unionByName(plain).withColumnRenamed("key", key)


_KEPT = "key long, n_words long, n_removed long, kept binary"


def _kept(rows: pd.DataFrame, keys: np.ndarray, position, check, length: int) -> pd.DataFrame:
    out = []
    for key, block in zip(rows["key"], rows["text"], strict=True):
        raw = opened(block)
        parts = raw.split()  # of bytes: the six ASCII space characters
        n = len(parts)
        gone = np.zeros(n, bool)
        a, b = (np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")) if len(keys) else (0, 0)
        if b > a and n >= length:
            data = np.frombuffer(raw, np.uint8)
            label = check_of(runs(words(data, np.array([0, len(data)]), fold=False).hashes, length))
            at, want = position[a:b].astype(np.int64), check[a:b]
            fits = at < len(label)
            at, want = at[fits], want[fits]
            at = at[label[at] == want]  # another row of this key may have another text
            edges = np.zeros(n + 1, np.int64)
            np.add.at(edges, at, 1)
            np.add.at(edges, at + length, -1)
            gone = np.cumsum(edges[:-1]) > 0
        out.append((key if key == key else None, n, int(gone.sum()), b" ".join([p for p, g in zip(parts, gone.tolist(), strict=True) if not g] if gone.any() else parts)))
    return pd.DataFrame(out, columns=["key", "n_words", "n_removed", "kept"]).astype({"key": "Int64"})
