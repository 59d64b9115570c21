"""Token ids in files of independent zstandard frames with a seek table.

A file is a sequence of frames in the seekable zstandard layout:

* a skippable frame with the index: keys, numbers of ids, ids before this file;
* one frame per document (more for documents beyond `FRAME_IDS` ids), each with ids as
  little-endian unsigned integers of two or four bytes, in the order of keys;
* a skippable frame with the seek table: compressed size, raw size and checksum (lower
  half of XXH64 over the raw bytes) of every frame, the number of frames, and the mark
  that ends the file. A reader goes from the end to the table, and from there to the
  frames it was asked for; each is checked against its checksum.

Spark's text writer writes the files, one row each: its line end is the mark that ends
the seek table, so its committer deals with lost executors, on any store Spark writes to.
Files are read as binary files. Documents are dealt to tasks by ranges of (key, hash of
the text, row), so a hot key is spread as well, and file names ascend with the keys.

The tokenizer's file is a parameter, read by the driver and shipped with the tasks up to
`MAX_FILE_BYTES`. Texts are encoded by the tokenizers library. For a vocabulary whose
texts may be cut at white space, ASCII digits and the ends of ASCII words, each distinct
piece is encoded once and remembered, up to a bound per worker; others, and texts with
added tokens, are encoded as a whole.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from opsight.llm.bpe import expand
from opsight.llm.common import give_back, ready
from opsight.llm.words import batches

MAX_FILE_BYTES = 64 << 20
#: Bytes of frames after which a task begins its next file.
FILE_BYTES = 4 << 20
#: Ids in one frame at most.
FRAME_IDS = 1 << 20
#: Bytes of texts encoded at once.
SLICE = 1 << 20
#: Distinct pieces a Python worker remembers, some 200 bytes each.
MEMORY = 500_000
#: New pieces encoded as one text.
JOINED = 5_000
#: Keys a look-up may ask for.
MAX_KEYS = 100_000

# Marks of the seekable zstandard layout.
INDEX_MARK, TABLE_MARK, END_MARK = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
END = struct.pack("<I", END_MARK)

_HEAD = struct.Struct("<II4sBxxx")  # skippable frame: mark and size; kind, bytes an id
_KIND = b"IDS1"
_COUNTS = struct.Struct(">QQQ")  # ids of the file, ids before it in its part, documents
_ENTRY = np.dtype([("packed", "<u4"), ("raw", "<u4"), ("sum", "<u4")])
_SPACE = re.compile(rb"[\t-\r ]")

#: Where a text in lower case may be cut: after a run of ASCII letters or of other ASCII signs that
#: no apostrophe or longer character follows, and around digits; anything else stays together.
_PIECE = re.compile(rb"[a-z]++(?!['\x80-\xff])|[0-9]|[^\t-\r a-z0-9'\x80-\xff]++(?!['\x80-\xff])|[^\t-\r 0-9]+")

#: Fixed value: normalizer and pre-tokenizer under which such pieces are encoded alone.
_CUT_AT_SPACE = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pattern": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
}


def cut_apart(spec: dict) -> bool:
    """Whether ids of a text without added tokens are those of its pieces in a row, whatever the case of A-Z."""
    cut = spec.get("pre_tokenizer") or {}
    steps = cut.get("pretokenizers") or [{}]
    first = steps[0]
    return (
        spec.get("normalizer") == _CUT_AT_SPACE["normalizer"] and first.get("type") == "Split"
        and first.get("pattern") == {"Regex": _CUT_AT_SPACE["pattern"]} and first.get("behavior") == "Removed" and first.get("invert") is True
        and all(s.get("type") == "ByteLevel" and not s.get("add_prefix_space") and not s.get("use_regex", True) for s in steps[1:])
    )


class Encoder:
    """Ids of texts by the tokenizers library."""

    def __init__(self, file: str, apart: bool, added: Sequence[str]):
        self.library = Tokenizer.from_str(file)
        self.library.no_truncation()
        self.library.no_padding()
        self.apart = apart
        self.added = [t.encode().lower() for t in added]
        self.clear()

    @staticmethod
    def parts(path: str) -> tuple[str, bool, list[str]]:
        """What an encoder is made of, from a tokenizer's file: read once, by the driver."""
        if Path(path).stat().st_size > MAX_FILE_BYTES:
            raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes, the bound for a broadcast")
        file = Path(path).read_text(encoding="utf-8")
        spec = json.loads(file)
        return file, cut_apart(spec), [t["content"] for t in spec.get("added_tokens", [])]

    def clear(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.ids, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep the pieces that came more than once, half of the bound at most."""
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > MEMORY // 2:
            kept = np.sort(np.argpartition(self.uses, -(MEMORY // 2))[-(MEMORY // 2) :])
        known = list(self.number)
        words = [known[i] for i in kept.tolist()]
        ids, sizes, uses = expand(self.ids, self.starts[kept], self.sizes[kept]), self.sizes[kept], self.uses[kept]
        self.clear()
        self.number.update(zip(words, range(len(words)), strict=True))
        self.ids, self.sizes, self.uses, self.starts = ids, sizes, uses, np.cumsum(sizes) - sizes

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Encode the pieces that have a number but no ids yet, as one text per `JOINED` of them."""
        fresh = [w.decode() for w in islice(self.number, len(self.sizes), None)]
        made, counts = [self.ids], [self.sizes]
        for at in range(0, len(fresh), JOINED):
            part = fresh[at : at + JOINED]
            begins = np.cumsum([0, *(len(w) + 1 for w in part)])
            found = self.library.encode(" ".join(part), add_special_tokens=False)
            places = np.fromiter((o[0] for o in found.offsets), np.int64, len(found.ids))
            made.append(np.array(found.ids, np.uint32))
            counts.append(np.bincount(np.searchsorted(begins, places, "right") - 1, minlength=len(part)))
        self.ids, self.sizes = np.concatenate(made), np.concatenate(counts)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def encode_all(self, texts: Sequence[bytes]) -> list[np.ndarray]:
        """Ids of each whole text, a slice of texts, or of a text, at a time."""
        out: list[np.ndarray | None] = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if not self.apart or any(a in t.lower() for a in self.added)]
        for i in whole:
            out[i] = self._encode([texts[i].decode()])[0]
        left = [i for i in range(len(texts)) if out[i] is None]
        long = [i for i in left if len(texts[i]) > SLICE]
        for i in long:
            out[i] = np.concatenate([self._group([part])[0] for part in _cut(texts[i])])
        short = [i for i in left if len(texts[i]) <= SLICE]
        for own in _groups(short, [len(texts[i]) for i in short]):
            for i, ids in zip(own, self._group([texts[i] for i in own]), strict=True):
                out[i] = ids
        return out

    def _group(self, texts: Sequence[bytes]) -> list[np.ndarray]:
        """Ids of texts: their pieces as numbers, the new ones encoded, and all put in a row."""
        if len(self.sizes) > MEMORY:
            self._forget()
        number, numbers = self.number.__getitem__, []
        for text in texts:
            own = _PIECE.findall(text.lower())
            numbers.append(np.fromiter(map(number, own), np.int32, len(own)))
        self._learn()
        flat = np.concatenate(numbers)
        self.uses = np.bincount(flat, minlength=len(self.sizes)) + np.pad(self.uses, (0, len(self.sizes) - len(self.uses)))
        sizes = self.sizes[flat]
        ids = expand(self.ids, self.starts[flat], sizes)
        ends = np.r_[0, np.cumsum(sizes)][np.cumsum([0, *map(len, numbers)])].tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _cut(text: bytes) -> Iterator[bytes]:
    """A long text in slices that end before white space."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + SLICE)
        to = cut.start() if cut else len(text)
        yield text[at:to]
        at = to


def _groups(items: Sequence[int], sizes: Sequence[int]) -> Iterator[list[int]]:
    """Items in groups of about a slice."""
    group, total = [], 0
    for item, size in zip(items, sizes, strict=True):
        group.append(item)
        total += size
        if total >= SLICE:
            yield group
            group, total = [], 0
    if group:
        yield group


_encoders: dict[int, Encoder] = {}


def _encoder(parts: tuple[str, bool, list[str]]) -> Encoder:
    key = xxhash.xxh64_intdigest(parts[0])
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(*parts)
    return _encoders[key]


class FileMaker:
    """Frames, index and seek table of one file, up to its last mark."""

    def __init__(self, width: int, before: int):
        self.width, self.before, self.ids, self.bytes = width, before, 0, 0
        self.keys: list[int | None] = []
        self.sizes: list[int] = []
        self.frames: list[bytes] = []
        self.entries: list[tuple[int, int, int]] = []
        self.pack = zstandard.ZstdCompressor(level=3).compress

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.sizes.append(len(ids))
        self.ids += len(ids)
        for at in range(0, max(len(ids), 1), FRAME_IDS):
            raw = ids[at : at + FRAME_IDS].astype(f"<u{self.width}").tobytes()
            frame = self.pack(raw)
            self.frames.append(frame)
            self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.bytes += len(frame)

    def content(self) -> bytes:
        keys = np.array([k or 0 for k in self.keys], "<i8").tobytes()
        missing = np.array([k is None for k in self.keys], np.uint8).tobytes()
        body = _COUNTS.pack(self.ids, self.before, len(self.keys)) + keys + missing + np.array(self.sizes, "<i8").tobytes()
        index = _HEAD.pack(INDEX_MARK, len(body) + _HEAD.size - 8, _KIND, self.width) + body
        entries = np.array([(len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF), *self.entries], _ENTRY).tobytes()
        table = struct.pack("<II", TABLE_MARK, len(entries) + 9) + entries + struct.pack("<IB", len(self.entries) + 1, CHECKSUMS)
        return b"".join([index, *self.frames, table])


class FileReader:
    """One file: its index and seek table, and documents by their place."""

    def __init__(self, content: bytes, name: str = "file"):
        self.content, self.name = memoryview(content), name
        if len(content) < _HEAD.size + 9 or content[-4:] != END:
            raise ValueError(f"{name}: no seek table at its end")
        frames, flags = struct.unpack_from("<IB", content, len(content) - 9)
        if flags != CHECKSUMS:
            raise ValueError(f"{name}: a seek table without checksums")
        at = len(content) - 9 - frames * _ENTRY.itemsize
        if at < 8 or struct.unpack_from("<II", content, at - 8) != (TABLE_MARK, frames * _ENTRY.itemsize + 9):
            raise ValueError(f"{name}: a broken seek table")
        self.entries = np.frombuffer(content, _ENTRY, frames, at)
        self.at = np.r_[0, np.cumsum(self.entries["packed"].astype(np.int64))]
        mark, size, kind, self.width = _HEAD.unpack_from(content)
        if (mark, kind) != (INDEX_MARK, _KIND) or size + 8 != self.entries["packed"][0] or self.at[-1] != at - 8:
            raise ValueError(f"{name}: index and seek table do not fit each other")
        self.ids, self.before, n = _COUNTS.unpack_from(content, _HEAD.size)
        at = _HEAD.size + _COUNTS.size
        self.keys = np.frombuffer(content, "<i8", n, at)
        self.missing = np.frombuffer(content, np.uint8, n, at + 8 * n).astype(bool)
        self.sizes = np.frombuffer(content, "<i8", n, at + 9 * n)
        count = np.maximum(-(-self.sizes // FRAME_IDS), 1)
        self.first = 1 + np.cumsum(count) - count
        self.count = count
        self.open = zstandard.ZstdDecompressor().decompress

    def document(self, place: int) -> np.ndarray:
        """The ids of one document; no other frame is touched."""
        parts = []
        for i in range(int(self.first[place]), int(self.first[place] + self.count[place])):
            raw = self.open(self.content[self.at[i] : self.at[i + 1]], max_output_size=int(self.entries["raw"][i]))
            if len(raw) != self.entries["raw"][i] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.entries["sum"][i]:
                raise ValueError(f"{self.name}: frame {i} does not have its checksum")
            parts.append(np.frombuffer(raw, f"<u{self.width}"))
        out = np.concatenate(parts).astype("<u4")
        if len(out) != self.sizes[place]:
            raise ValueError(f"{self.name}: document {place} has {len(out)} ids and not {self.sizes[place]}")
        return out


def write(df: DataFrame, path: str, vocabulary: str, key: str = "doc_id", text: str = "text", end: int | None = None) -> None:
    """Encode every whole text and write its ids, and `end` behind them, in ascending order of the key.

    The key is a whole number. Null keys come first; rows with one key follow one
    another by a hash of their text; a null text counts as empty; repeated rows are
    all written; other columns are not. An empty table leaves a folder without ids.
    """
    spark = ready(df.sparkSession)
    parts = Encoder.parts(vocabulary)
    held = spark.sparkContext.broadcast(parts)
    most = max(Tokenizer.from_str(parts[0]).get_vocab(with_added_tokens=True).values())
    width = 2 if max(most, end or 0) < 1 << 16 else 4
    tail = np.array([] if end is None else [end], np.uint32)

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, made = _encoder(held.value), FileMaker(width, 0)
        for part in batches_:
            keys = part.column(0).to_pylist()
            for start, to, data, offsets in batches(part.column(1), SLICE):
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
                for k, ids in zip(keys[start:to], encoder.encode_all(texts), strict=True):
                    made.add(k, np.concatenate([ids, tail]))
                    if made.bytes >= FILE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([made.content()], pa.binary())], ["content"])
                        made = FileMaker(width, made.before + made.ids)
        if made.keys:
            yield pa.RecordBatch.from_arrays([pa.array([made.content()], pa.binary())], ["content"])
        give_back()

    rows = df.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    rows = rows.withColumns({"h": F.xxhash64("t"), "r": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange("k", "h", "r").sortWithinPartitions("k", "h", "r").select("k", "t")
    files = dealt.mapInArrow(run, "content binary").select(F.col("content").cast("string"))
    files.write.option("encoding", "ISO-8859-1").option("lineSep", END.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = ready(spark).read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")
    return files.select(F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("long").alias("part"), "path", "content")


def _big_endian(content: Column | str, at: int) -> Column:
    return F.conv(F.hex(F.substring(content, at + 1, 8)), 16, 10).cast("long")


def read(spark: SparkSession, path: str, keys: Sequence[int] | None = None, ids: bool = True) -> DataFrame:
    """key, start (ids of all documents before it), n_ids, ids_crc32 (of the ids as little-endian unsigned
    32-bit integers) and ids of every document, or of those with one of `keys`, whose frames alone are opened.

    A frame that does not match its checksum, or a file without its seek table, is an error.
    `ids` False leaves that column out. At most `MAX_KEYS` keys are asked for at once.
    """
    wanted = None if keys is None else np.unique(np.array(list(keys), np.int64))
    if wanted is not None and len(wanted) > MAX_KEYS:
        raise ValueError(f"more than {MAX_KEYS} keys")
    schema = "part long, key long, at long, n_ids long, ids_crc32 long" + (", ids array<long>" if ids else "")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for number, name, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                file = FileReader(content.as_py(), name)
                places = np.arange(len(file.keys)) if wanted is None else np.flatnonzero(np.isin(file.keys, wanted) & ~file.missing)
                at = file.before + np.cumsum(file.sizes) - file.sizes
                for own in np.array_split(places, max(1, -(-int(file.sizes[places].sum()) // FRAME_IDS))):
                    if not len(own):
                        continue
                    found = [file.document(i) for i in own]
                    columns = [
                        pa.array(np.full(len(own), number, np.int64)), pa.array(file.keys[own], mask=file.missing[own]), pa.array(at[own]),
                        pa.array(file.sizes[own]), pa.array([zlib.crc32(x) for x in found], pa.int64()),
                    ]
                    if ids:
                        flat = np.concatenate(found).astype(np.int64)
                        columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(flat)))
                    yield pa.RecordBatch.from_arrays(columns, ["part", "key", "at", "n_ids", "ids_crc32", "ids"][: len(columns)])
        give_back()

    files = _files(spark, path)
    # one row per task of the writer, which bounds what the window and the broadcast take
    totals = files.groupBy("part").agg(F.sum(_big_endian("content", _HEAD.size)).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    found = files.mapInArrow(run, schema).join(F.broadcast(bases), "part")
    return found.select("key", (F.col("base") + F.col("at")).alias("start"), "n_ids", "ids_crc32", *(["ids"] if ids else []))
