"""WARC archives: writing with segments and revisits, reading by segment reassembly.

Writing turns each page into a `response` record whose block is an HTTP message with
a chunked body, or into a `revisit` record if an equal payload is written by another
page. A block over the segment limit is cut: the first part is the `response`, the
others are `continuation` records with the identifier of the first as origin, a
segment number, and the total length in the last. Records go out through Spark's
text writer with the record end as line end, one gzip file per task or part of it.

Reading takes the files as bytes, cuts them by Content-Length, groups the segments
by origin, orders them by number, verifies numbers and total length, and decodes the
chunk framing. A revisit keeps the HTTP head with the length of its payload.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsight.llm.common import written

#: Bytes of a block in one record.
SEGMENT_BYTES = 32 << 10
#: Bytes of payload in one chunk of the HTTP body.
CHUNK_BYTES = 8 << 10
#: Least bytes of a payload that may be replaced by a revisit.
LEAST_SHARED = 1000
#: Parts a group of equal payloads is dealt to.
SALTS = 32
#: Records in one archive file, which bounds its size by that many segments.
FILE_RECORDS = 5_000
_END = "\r\n"


def with_targets(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """pages with __digest, __bytes and __refers: the largest key of the same payload, if that is another's.

    The groups are found by a pre-aggregated maximum; the join back is salted, as a
    payload may be that of a third of all rows. Null keys write responses of their own.
    """
    own = pages.withColumns({
        "__digest": F.sha1(F.coalesce(F.col(payload), F.lit(b""))),
        "__bytes": F.coalesce(F.octet_length(payload), F.lit(0)).cast("long"),
    })
    shared = (
        own.where((F.col("__bytes") >= LEAST_SHARED) & F.col(key).isNotNull())
        .groupBy("__digest").agg(F.max(key).alias("__last"), F.count(F.lit(1)).alias("__n"))
        .where("__n > 1").select("__digest", "__last", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("__salt"))
    )
    salted = own.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    joined = salted.join(shared, ["__digest", "__salt"], "left")
    return joined.withColumn("__refers", F.when(F.col("__last") != F.col(key), F.col("__last"))).drop("__salt", "__last")


def _record_id(key: Column, part: Column) -> Column:
    """A UUID made from the page's identifier and the segment number."""
    hexa = F.md5(F.concat_ws("/", key.cast("string"), part.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(hexa, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _joined(parts: Column) -> Column:
    """The bytes of an array of binaries, in one copy; casting to string and back leaves bytes alone."""
    return F.array_join(F.transform(parts, lambda x: x.cast("string")), "").cast("binary")


def _chunked(payload: Column, size: Column) -> Column:
    """Bytes with the framing of chunked transfer."""
    pieces = F.when(size > 0, F.sequence(F.lit(0).cast("long"), size - 1, F.lit(CHUNK_BYTES).cast("long"))).otherwise(F.array().cast("array<long>"))
    framed = F.transform(pieces, lambda at: F.concat(
        F.lower(F.hex(F.least(F.lit(CHUNK_BYTES).cast("long"), size - at))).cast("binary"), F.lit(_END.encode()),
        F.substring(payload, (at + 1).cast("int"), F.lit(CHUNK_BYTES)), F.lit(_END.encode())))
    return F.concat(_joined(framed), F.lit(b"0\r\n\r\n"))


def records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """One row per WARC record (column `record`, text without the two line ends that close it).

    The payload is the column in UTF-8, null counting as empty. Repeated keys write
    a record each; line breaks in a URL are dropped, and a null URL is written
    without a target.
    """
    source = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(payload).cast("binary").alias("body"))
    told = with_targets(source, "key", "body")
    body = F.coalesce(F.col("body"), F.lit(b""))
    # two rows may have one key: the row's own digest and a number keep identifiers apart
    own = told.withColumn("row", F.monotonically_increasing_id()).withColumn("ident", F.concat_ws("/", F.coalesce(F.col("key").cast("string"), F.lit("")), F.col("__digest"), F.col("row").cast("string")))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), F.when(F.col("__refers").isNull(), F.lit("Transfer-Encoding: chunked\r\n")).otherwise(F.concat(F.lit("Content-Length: "), F.col("__bytes").cast("string"), F.lit(_END))), F.lit(_END)).cast("binary")
    block = F.when(F.col("__refers").isNull(), F.concat(head, _chunked(body, F.col("__bytes")))).otherwise(head)
    whole = own.select("key", "url", "ident", "__digest", "__refers", block.alias("block")).withColumn("total", F.length("block").cast("long"))
    last = F.floor((F.col("total") - 1) / F.lit(SEGMENT_BYTES)) + 1
    cut = whole.withColumn("segments", last.cast("int")).withColumn("segment", F.explode(F.sequence(F.lit(1), F.col("segments"))))
    part = F.substring("block", (F.col("segment") - 1) * SEGMENT_BYTES + 1, F.lit(SEGMENT_BYTES))
    line = lambda name, value: F.concat(F.lit(name + ": "), value.cast("string"), F.lit(_END))
    first, many = F.col("segment") == 1, F.col("segments") > 1
    kind = F.when(~first, "continuation").when(F.col("__refers").isNotNull(), "revisit").otherwise("response")
    digest = F.concat(F.lit("sha1:"), F.col("__digest"))
    headers = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", kind), line("WARC-Record-ID", _record_id(F.col("ident"), F.col("segment"))),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")), F.lit("")),
        F.coalesce(line("X-Page-Key", F.col("key")), F.lit("")),
        F.when(first, line("WARC-Payload-Digest", digest)).otherwise(""),
        F.when(first & F.col("__refers").isNotNull(), F.concat(
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
            line("X-Refers-To-Key", F.coalesce(F.col("__refers"), F.lit(0))))).otherwise(""),
        F.when(many, line("WARC-Segment-Number", F.col("segment"))).otherwise(""),
        F.when(many & ~first, line("WARC-Segment-Origin-ID", _record_id(F.col("ident"), F.lit(1)))).otherwise(""),
        F.when(many & (F.col("segment") == F.col("segments")), line("WARC-Segment-Total-Length", F.col("total"))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.length(part)), F.lit(_END),
    ).cast("binary")
    # the bytes are handed on as they are: the text writer does not decode them
    return cut.select(F.concat(headers, part).cast("string").alias("record"))


def write(pages: DataFrame, path: str, **names: str) -> None:
    """Write the pages as gzip WARC files into the folder `path`."""
    records(pages, **names).write.option("lineSep", _END + _END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(file: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of one archive, plain or of gzip members; inflates as it goes."""
    buffer = bytearray()
    feed = _inflated(file)
    ended = False

    def fill(n: int) -> bool:
        nonlocal ended
        while len(buffer) < n and not ended:
            piece = next(feed, None)
            if piece is None:
                ended = True
            else:
                buffer.extend(piece)
        return len(buffer) >= n

    while True:
        at, looked = -1, 0
        while at < 0:
            at = buffer.find(b"\r\n\r\n", max(0, looked - 3))
            looked = len(buffer)
            if at < 0 and not fill(looked + 1):
                break
        if at < 0:
            if bytes(buffer).strip():
                raise ValueError("archive ends within a record")
            return
        lines = bytes(buffer[:at]).decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:60]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        if not fill(at + 4 + size + 4) or buffer[at + 4 + size : at + 8 + size] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield headers, bytes(buffer[at + 4 : at + 4 + size])
        del buffer[: at + 8 + size]


def _inflated(file: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    if file[:2] != b"\x1f\x8b":
        for at in range(0, len(file), step):
            yield file[at : at + step]
        return
    rest = file
    while rest:
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            piece = inflate.decompress(rest, step)
            rest = inflate.unconsumed_tail
            if piece:
                yield piece
            elif not rest and not inflate.eof:
                raise ValueError("gzip file ends early")
        rest = inflate.unused_data.lstrip(b"\0")


def payload_of(block: bytes) -> bytes:
    """Body of an HTTP message, with chunked transfer undone."""
    at = block.find(b"\r\n\r\n")
    if at < 0:
        raise ValueError("HTTP message without an end of its head")
    head, body = block[:at].lower(), block[at + 4 :]
    if b"\r\ntransfer-encoding: chunked" not in head:
        return body
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk without a size")
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        piece = body[end + 2 : end + 2 + size]
        if len(piece) < size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("chunk shorter than its size")
        out.append(piece)
        at = end + 4 + size


def opened(block: bytes, kind: str, digest: str, texts: bool) -> tuple[int, str, str | None]:
    """Length, SHA-1 and text of the payload of a whole record, checked against its digest.

    A revisit has no body: its length is that of the HTTP head, its digest the record's.
    """
    if kind == "revisit":
        m = re.search(rb"(?i)\r\ncontent-length: *(\d+)", block)
        if not m or not digest.startswith("sha1:"):
            raise ValueError("revisit without length or digest")
        return int(m[1]), digest[5:], None
    body = payload_of(block)
    sha1 = hashlib.sha1(body).hexdigest()
    if digest != "sha1:" + sha1:
        raise ValueError(f"payload does not match its digest {digest}")
    return len(body), sha1, body.decode("utf-8", "replace") if texts else None


_FIELDS = "kind string, key string, url string, digest string, refers string, bytes long, sha1 string, text string"
_PARTS = f"origin string, segment int, total long, block binary, {_FIELDS}"


def read_parts(spark: SparkSession, path: str, texts: bool = True) -> DataFrame:
    """One row per record or segment of the archives in a folder; whole records are decoded, segments keep their block."""

    def row(h: dict[str, str], block: bytes) -> tuple:
        number, kind, digest = int(h.get("warc-segment-number", 0)), h["warc-type"], h.get("warc-payload-digest", "")
        told = opened(block, kind, digest, texts) if not number else (None, None, None)
        return (
            h.get("warc-segment-origin-id", h["warc-record-id"]), number,
            int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, block if number else None,
            kind, h.get("x-page-key"), h.get("warc-target-uri"), digest, h.get("x-refers-to-key"), *told,
        )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _PARTS.split(", ")]
        for batch in batches:
            for file in batch["content"]:
                rows, size = [], 0
                for h, block in parse(file):
                    rows.append(row(h, block))
                    size += len(block)
                    if size > 8 << 20:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(cut, _PARTS)


def read(spark: SparkSession, path: str, texts: bool = True) -> DataFrame:
    """The pages in the archives of a folder, whatever file their segments are in.

    Columns: key, url, record_type, payload_bytes, payload_digest (lower-case hex
    SHA-1 of the payload as decoded), refers_to and, if asked for, payload (UTF-8;
    null for a revisit). Missing or repeated segments, a wrong total length and a
    wrong digest are errors. An empty folder gives no rows.
    """

    @F.pandas_udf("bytes long, sha1 string, text string")
    def decode(blocks: pd.Series, kinds: pd.Series, digests: pd.Series) -> pd.DataFrame:
        told = [opened(*x, texts) for x in zip(blocks, kinds, digests, strict=True)]
        return pd.DataFrame(told, columns=["bytes", "sha1", "text"])

    parts = written(read_parts(spark, path, texts), "warc-parts")
    fields = [x.split()[0] for x in _FIELDS.split(", ")]
    # a record's segments are bounded by its length, so they may meet in one row
    joined = (
        parts.where("segment > 0").groupBy("origin")
        .agg(F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("p"), F.max("total").alias("total"),
             *(F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in fields[:5]))
        .withColumn("block", _joined(F.col("p.block")))
    )
    right = (F.transform("p", lambda x: x["segment"]) == F.sequence(F.lit(1), F.size("p"))) & (F.col("total") == F.length("block"))
    fault = F.raise_error(F.concat(F.lit("segments missing, repeated or of wrong length: "), F.col("origin"))).cast("binary")
    joined = joined.withColumn("block", F.when(F.coalesce(right, F.lit(False)), F.col("block")).otherwise(fault))
    decoded = joined.withColumn("d", decode("block", "kind", "digest")).select(*fields[:5], "d.*")
    every = parts.where("segment = 0").select(*fields).unionByName(decoded)
    out = every.select(
        "key", "url", F.col("kind").alias("record_type"), F.col("bytes").alias("payload_bytes"),
        F.col("sha1").alias("payload_digest"), F.col("refers").alias("refers_to"), F.col("text").alias("payload"),
    )
    return out if texts else out.drop("payload")


def dangling(pages: DataFrame) -> DataFrame:
    """Revisits among the rows of `read` whose record is not among them as a response of the same digest."""
    responses = pages.where("record_type = 'response'").select(F.col("key").alias("refers_to"), "payload_digest")
    return pages.where("record_type = 'revisit'").join(responses, ["refers_to", "payload_digest"], "left_anti")
