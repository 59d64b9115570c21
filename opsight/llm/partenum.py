"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its word n-grams. Sets are put into bands of similar size.
Within a band, similar sets differ in at most k elements. The domain is dealt by a
hash to groups of two partitions, with so many groups that one has at most one of the
k differences; then one of the two subsets that leave a partition out is untouched.
Every such subset gives a signature (a hash of the elements in it), and sets that are
similar enough share one. A set close to the edge of its band signs in the next one
as well.

Sets that meet are compared first by parity sketches: the number of differing bits is
at most the number of differing elements, so no similar pair is ruled out. Of the
pairs left each document verifies one on the texts, with the smallest neighbour it finds in
a few of its signatures; after joining these into components, all pairs left between
components are verified too, in all signatures. Nothing is lost, and pairs within a
component need not be looked at. A pair that shares many signatures is told by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsight.llm.common import give_back, written
from opsight.llm.components import components
from opsight.llm.packing import opened, pack, pieces_by, squeezed, unpack
from opsight.llm.words import batches, mix, runs, words

#: Largest over smallest size in a band.
BAND = 1.5
CHUNK_BYTES = 2 << 20
#: Signatures in a group of the join, and members compared in one block.
GROUP_SIGNATURES, BLOCK = 250_000, 2_048
#: Rows that a group of the join hands on at once.
PIECE_ROWS = 30_000
#: Smallest signatures of a row: those it looks for a neighbour in first, and by which a pair tells that it met before.
LEAST = 8
#: 64-bit words of sketches compared, and bits of sketches made, at once.
PAIR_WORDS, SKETCH_BITS = 1 << 20, 1 << 20


@dataclass(frozen=True)
class Rule:
    """Two sets link if den * shared >= num * united elements."""

    n: int = 5
    num: int = 80
    den: int = 100

    def holds(self, a: np.ndarray, b: np.ndarray) -> bool:
        shared = len(np.intersect1d(a, b, assume_unique=True))
        return bool(shared) and self.den * shared >= self.num * (len(a) + len(b) - shared)

    def differences(self, sizes):
        """Most elements in which two sets with this sum of sizes may differ."""
        return sizes * (self.den - self.num) // (self.den + self.num)


def bands(rule: Rule, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First size, differences, partitions and sketch bits of each band up to a size."""
    low, k, parts, bits = [], [], [], []
    at = 1
    while not low or low[-1] <= largest * rule.den // rule.num + 1:
        top = max(at, int(at * BAND))
        d = rule.differences(2 * top)
        groups = d // 2 + 1
        low.append(at)
        k.append(d)
        # some groups more, so that groups with an empty partition do no harm
        parts.append(2 * (groups + groups // 16 + 1) if d else 1)
        bits.append(max(64, 1 << (4 * d - 1).bit_length()) if d else 64)
        at = top + 1
    return tuple(np.array(x, np.int64) for x in (low, k, parts, bits))


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, as text numbers and hashes, sorted; A-Z count as a-z."""
    found = words(data, offsets, fold=True)
    counts = found.counts()
    text = np.repeat(np.arange(len(counts)), counts)
    h = runs(found.hashes, n)
    inside = text[: len(h)] == text[n - 1 :] if len(h) else np.zeros(0, bool)
    owner, h = text[: len(h)][inside], h[inside]
    few = np.flatnonzero((counts > 0) & (counts < n))
    if len(few):  # the whole text is its one shingle
        whole = [runs(found.hashes[found.first[i] : found.first[i + 1]], int(counts[i]))[0] for i in few]
        owner, h = np.r_[owner, few], np.r_[h, np.array(whole, np.uint64)]
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
    return owner[new], h[new]


#: Added to the band of a signature of an empty partition: of a set that has it, of one that asks for it.
HELD, ASKED = 1 << 8, 1 << 9
_GOLD, _TAG, _VOID = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def signatures(owner: np.ndarray, h: np.ndarray, texts: int, rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(signatures, text numbers, band and mark) of the sets, band by band."""
    size = np.bincount(owner, minlength=texts)
    if not len(h):
        return
    low, k, parts, _ = bands(rule, int(size.max()))
    own = np.searchsorted(low, size, "right") - 1
    reach = np.searchsorted(low, size * rule.den // rule.num, "right") - 1
    for band in range(len(low)):
        sign = np.flatnonzero((size > 0) & (own <= band) & (reach >= band))
        if not len(sign):
            continue
        place = np.full(texts, -1)
        place[sign] = np.arange(len(sign))
        mine = place[owner] >= 0
        row, value, m = place[owner[mine]], h[mine], int(parts[band])
        slot = row * m + (value % np.uint64(m)).astype(np.int64)
        sums = np.zeros(len(sign) * m, np.uint64)
        np.add.at(sums, slot, value)
        filled = np.bincount(slot, minlength=len(sums)) > 0
        tag = (np.array([band + 1], np.uint64) * _GOLD + np.arange(m, dtype=np.uint64) * _TAG)[np.arange(len(sums)) % m]
        at = np.flatnonzero(filled)
        yield mix(sums[at] + tag[at]), sign[at // m], band
        if k[band]:
            # two sets may agree in an empty partition alone: it is signed with the size of the set ...
            at = np.flatnonzero(~filled)
            yield mix(tag[at] + size[sign[at // m]].astype(np.uint64) * _VOID), sign[at // m], band + HELD
            # ... and asked for at every size in reach by sets with too few groups without one:
            # the differences to a set in reach leave fewer than that untouched
            both = filled.reshape(len(sign), -1, 2).all(axis=2).sum(axis=1)
            top = low[band + 1] - 1 if band + 1 < len(low) else size.max() * rule.den
            most = np.minimum(size[sign] * rule.den // rule.num, top)
            for i in np.flatnonzero(both <= rule.differences(size[sign] + most) // 2):
                s = int(size[sign[i]])
                others = np.arange(-(-s * rule.num // rule.den), most[i] + 1, dtype=np.uint64)
                empty = np.flatnonzero(~filled[i * m : (i + 1) * m]) + i * m
                asked = mix((tag[empty][:, None] + others[None, :] * _VOID).reshape(-1))
                yield asked, np.full(len(asked), sign[i]), band + ASKED


def _sketches(owner: np.ndarray, h: np.ndarray, texts: int, bits: int) -> np.ndarray:
    """Parity of the number of elements at each of `bits` places, as words of 64 bits."""
    flips = np.bincount(owner * bits + (h & np.uint64(bits - 1)).astype(np.int64), minlength=texts * bits) & 1
    return np.packbits(flips.astype(np.uint8).reshape(texts, bits), axis=1, bitorder="little").view(np.uint64)


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))


def _sets(source: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys of the texts of a chunk, and their shingles."""
    for batch in source:
        keys = batch.column(0)
        for start, end, data, offsets in batches(batch.column(1), CHUNK_BYTES):
            owner, h = shingles(data, offsets, rule.n)
            yield keys.slice(start, end - start), owner, h
    give_back()


#: Columns of `_meetings`.
MET = ["kind", "key", "other", "sig", "band", "size"]


def _told(kind: str, key: np.ndarray, **others: np.ndarray) -> Iterator[pd.DataFrame]:
    """Rows of `_meetings` in small pieces: each is a batch of its own on its way to the JVM."""
    for at in range(0, len(key), PIECE_ROWS):
        own = {n: v[at : at + PIECE_ROWS] for n, v in others.items()}
        yield pd.DataFrame({"kind": kind, "key": key[at : at + PIECE_ROWS]} | dict.fromkeys(MET[2:], 0) | own)[MET]


def _meetings(texts: DataFrame, rule: Rule, groups: int) -> DataFrame:
    """Who shares a signature: kind, key, other, sig, band, size.

    `copy`: key has the same set as the smaller key `other` of its chunk, and takes no
    further part. `same`: likewise among chunks. `member`: key is one of `size` that
    share a signature; `sig` stands for all signatures of a band with these members.
    """

    def sign(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, owner, h in _sets(source, rule):
            keys = keys.to_numpy(zero_copy_only=False)
            n = np.bincount(owner, minlength=len(keys))
            total = np.zeros(len(keys), np.uint64)
            np.add.at(total, owner, mix(h))
            whole = mix(total + n.astype(np.uint64) * _GOLD)
            order = np.lexsort((keys, whole))
            order = order[n[order] > 0]
            if not len(order):
                continue
            head = np.r_[True, whole[order][1:] != whole[order][:-1]]
            first = keys[order][np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
            again = ~head & (keys[order] != first)
            rows = [(1, p, pack(keys[order][again][i], first[again][i])) for p, i in pieces_by(keys[order][again] % groups)]
            keep = np.zeros(len(keys), bool)
            keep[order[head]] = True
            stays = keep[owner]
            found = [(whole[order[head]], order[head], np.full(int(head.sum()), -1))]
            found += [(s, t, np.full(len(s), b)) for s, t, b in signatures(owner[stays], h[stays], len(keys), rule)]
            sig, who, band = (np.concatenate(x) for x in zip(*found, strict=True))
            by_sig = np.argsort(sig, kind="stable")
            sig, who, band = sig[by_sig], keys[who[by_sig]], band[by_sig].astype(np.int16)
            rows += [(0, p, pack(sig[i], who[i], band[i])) for p, i in pieces_by((sig % np.uint64(groups)).astype(np.int64))]
            yield pa.RecordBatch.from_pydict({"kind": pa.array([r[0] for r in rows], pa.int32()), "part": pa.array([r[1] for r in rows], pa.int64()), "block": pa.array([r[2] for r in rows], pa.binary())})

    def meet(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = []
        for rows in parts:
            for block in rows.loc[rows["kind"] == 1, "block"]:
                key, other = unpack(block, np.int64, np.int64)
                yield from _told("copy", key, other=other)
            blocks += [unpack(b, np.uint64, np.int64, np.int16) for b in rows.loc[rows["kind"] == 0, "block"]]
        if blocks:
            sig, key, band = (np.concatenate(x) for x in zip(*blocks, strict=True))
            blocks.clear()
            order = np.lexsort((-band, key, sig))  # who asks counts as one who asks
            sig, key, band = sig[order], key[order], band[order]
            new = np.r_[True, (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])]
            sig, key, band = sig[new], key[new], band[new]
            head = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
            size = np.diff(np.r_[head, len(sig)])
            first, size = np.repeat(key[head], size), np.repeat(size, size)
            same = (band < 0) & (key != first)
            # an empty partition matters only where a set asked for it
            asked = np.repeat(np.logical_or.reduceat(band >= ASKED, head), np.diff(np.r_[head, len(sig)]))
            some = (band >= 0) & (size > 1) & ((band < HELD) | asked)
            band = band & (HELD - 1)
            # near copies share many signatures: those with the same members are one from here on
            number = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(sig)]))
            alike = np.add.reduceat(mix(key.view(np.uint64) + _TAG), head) + (band[head].astype(np.uint64) + np.uint64(1)) * _GOLD
            alike = mix(alike + size[head].astype(np.uint64) * _VOID)
            once = np.zeros(len(head), bool)
            some_heads = np.flatnonzero(np.logical_or.reduceat(some, head))
            once[some_heads[np.unique(alike[some_heads], return_index=True)[1]]] = True
            some &= once[number]
            sig = alike[number]
            yield from _told("same", key[same], other=first[same])
            yield from _told("member", key[some], sig=sig[some].view(np.int64), band=band[some], size=size[some])
        give_back()

    packed = texts.where("key IS NOT NULL AND text IS NOT NULL").mapInArrow(sign, "kind int, part long, block binary")
    return packed.groupBy("part").applyInPandas(meet, "kind string, key long, other long, sig long, band int, size long")


def _described(texts: DataFrame, rule: Rule) -> DataFrame:
    """n_shingles and parity sketch of every row."""

    def describe(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, owner, h in _sets(source, rule):
            n = np.bincount(owner, minlength=len(keys))
            sketch: list[bytes] = [b""] * len(keys)
            low, _, _, bits = bands(rule, int(n.max()) if len(n) else 1)
            # wide enough for the highest band the set signs in; lower ones fold it
            band = np.searchsorted(low, n * rule.den // rule.num, "right") - 1
            width = np.where(n > 0, bits[np.maximum(band, 0)], 0)
            value = mix(h)
            for b in np.unique(width[width > 0]):
                own = np.flatnonzero(width == b)
                step = max(1, SKETCH_BITS // int(b))
                for at in range(0, len(own), step):
                    some = own[at : at + step]
                    place = np.full(len(keys), -1)
                    place[some] = np.arange(len(some))
                    mine = place[owner] >= 0
                    for i, s in zip(some, _sketches(place[owner[mine]], value[mine], len(some), int(b)), strict=True):
                        sketch[i] = s.tobytes()
            yield pa.RecordBatch.from_pydict({"key": keys.cast(pa.int64()), "n": pa.array(n, pa.int64()), "sketch": pa.array(sketch, pa.binary())})

    return texts.mapInArrow(describe, "key long, n long, sketch binary")


def _fold(sketch: bytes, words_wanted: int) -> np.ndarray:
    own = np.frombuffer(sketch, np.uint64)
    while len(own) > words_wanted:
        own = own[: len(own) // 2] ^ own[len(own) // 2 :]
    return own


#: No signature.
NONE = int(np.iinfo(np.int64).max)


def _first_shared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest number that two rows share, or NONE."""
    first = np.full(len(left), NONE)
    for i in range(right.shape[1]):
        one = right[:, i]
        first = np.where((left == one[:, None]).any(axis=1), np.minimum(first, one), first)
    return first


def _close(members: DataFrame, rule: Rule, every: bool) -> DataFrame:
    """Pairs (a < b) of members of one signature and of different components whose sketches allow a link.

    With `every` all of them, told in the smallest signature that both have among their
    least (in each they share, if there is none). Else the signatures among the least
    alone, and for each b the smallest a in its block and in the first one.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    own = F.pmod(F.xxhash64("key"), blocks)
    # a signature with many members is compared as pairs of blocks, each in a task of its own
    others = F.sequence(F.lit(0).cast("long"), blocks - 1)
    if not every:
        members = members.where(F.array_contains("least", F.col("sig"))).drop("least")
        others = F.when(own == 0, others).otherwise(F.array(F.lit(0).cast("long"), own))
    dealt = members.withColumn("own", own).withColumn("other", F.explode(others))
    dealt = dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    keys = ["sig", "size", "lo", "hi"]
    columns = [*keys, "own", "key", "band", "n", "sketch", "component", *(["least"] if every else [])]

    def compare(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for part in source:
            part = part if rest is None else pd.concat([rest, part], ignore_index=True)
            ids = part[keys].to_numpy()
            cut = len(part) - int((ids[::-1] == ids[-1]).all(axis=1).argmin() or len(part)) if len(part) else 0
            rest, part = part.iloc[cut:], part.iloc[:cut]
            yield from pairs(part)
        if rest is not None:
            yield from pairs(rest)
        give_back()

    def pairs(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        # of a key with several texts, those too small to have this signature
        _, _, _, bits = bands(rule, 1 << 30)
        part = part[part["sketch"].str.len().to_numpy() >= bits[part["band"].to_numpy()] // 8]
        if len(part) < 2:
            return
        ids = part[keys].to_numpy()
        head = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)])
        size = np.diff(np.r_[head, len(part)])
        width = bits[part["band"].to_numpy()] // 64
        key, n, comp, sig, own = (part[c].to_numpy() for c in ("key", "n", "component", "sig", "own"))
        across = (part["lo"] != part["hi"]).to_numpy()
        sketch = part["sketch"].to_numpy()
        least = np.stack(part["least"].to_numpy()) if every else None
        first_of = []
        for w in np.unique(width):
            groups = np.flatnonzero((width[head] == w) & (size > 1))
            rows = np.concatenate([np.arange(head[g], head[g] + size[g]) for g in groups]) if len(groups) else np.zeros(0, np.int64)
            if not len(rows):
                continue
            folded = np.stack([_fold(s, int(w)) for s in sketch[rows]])
            # each row meets those after it in its group
            after = np.concatenate([np.arange(size[g] - 1, -1, -1) for g in groups])
            at, most = 0, max(1, PAIR_WORDS // int(w))
            while at < len(rows):
                to = at + max(1, int(np.searchsorted(np.cumsum(after[at : at + most]), most, "right")))
                left = np.repeat(np.arange(at, min(to, len(rows))), after[at:to])
                first = np.cumsum(after[at:to]) - after[at:to]
                right = left + 1 + np.arange(len(left)) - np.repeat(first, after[at:to])
                a, b = rows[left], rows[right]
                good = (comp[a] != comp[b]) & (rule.den * np.minimum(n[a], n[b]) >= rule.num * np.maximum(n[a], n[b]))
                good &= ~across[a] | (own[a] != own[b])  # those of one block meet where it is alone
                left, right, a, b = left[good], right[good], a[good], b[good]
                apart = np.bitwise_count(folded[left] ^ folded[right]).sum(axis=1, dtype=np.int64)
                good = apart <= rule.differences(n[a] + n[b])
                a, b = a[good], b[good]
                if every:
                    told = _first_shared(least[a], least[b])
                    good = (told == NONE) | (told == sig[a])
                    a, b = a[good], b[good]
                found = pd.DataFrame({"a": np.minimum(key[a], key[b]), "b": np.maximum(key[a], key[b])})
                if every:
                    yield found
                else:
                    first_of.append(found.groupby("b", as_index=False)["a"].min())
                at = to
        if first_of:
            yield pd.concat(first_of).groupby("b", as_index=False)["a"].min()[["a", "b"]]

    laid = dealt.select(*columns).repartition(*keys).sortWithinPartitions(*keys, "key")
    return laid.mapInPandas(compare, "a long, b long")


def _verified(pairs: DataFrame, kept: DataFrame, rule: Rule) -> DataFrame:
    """pairs with `linked`, decided on the (squeezed) texts of either key."""

    @F.pandas_udf("boolean")
    def linked(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def own(blocks: np.ndarray) -> list[np.ndarray]:
            raw = [np.frombuffer(opened(b), np.uint8) for b in blocks]
            return [shingles(data, np.array([0, len(data)]), rule.n)[1] for data in raw]

        for left, right in parts:
            yield pd.Series([any(rule.holds(p, q) for p in own(x) for q in own(y)) for x, y in zip(left, right, strict=True)])
        give_back()

    a, b = (kept.select(F.col("key").alias(c), F.col("texts").alias(f"texts_{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", linked("texts_a", "texts_b").alias("linked"))


def join(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """n_shingles and component_id of every row of docs, under the name of its key.

    component_id is the smallest key that links reach from the row's, itself
    included. A text with fewer words than n has its whole sequence as one shingle;
    a null text or one without words has none and is linked with nothing. Rows that
    share a key count as one document with all their links; a row with a null key
    takes no part and has a null component. The key is an integer; other columns are
    not carried on.
    """
    texts = _texts(docs, key, text)
    told = written(_described(texts, rule), "join-sizes")
    total = told.agg(F.sum("n").alias("n")).first()["n"] or 0
    met = written(_meetings(texts, rule, max(1, total // (3 * GROUP_SIGNATURES))), "join-met")
    # equal sets: a copy leads to the first of its chunk, that one to the first of all
    same = met.where("kind = 'same'").select("key", F.col("other").alias("class"))
    copies = met.where("kind = 'copy'").select("key", F.col("other").alias("first"))
    far = copies.join(same.select(F.col("key").alias("first"), F.col("class").alias("to")), "first", "left")
    classes = written(same.unionByName(far.select("key", F.coalesce("to", "first").alias("class"))), "join-classes")
    member = met.where("kind = 'member'").join(same, "key", "left")
    member = member.select("sig", "band", "size", F.coalesce("class", "key").alias("key")).dropDuplicates(["sig", "size", "key"])
    # short rows hold their first one again, so that all are of one length; a key of several texts meets
    # by signatures of each, which do not tell of the others, so it has none
    some = member.groupBy("key").agg(F.slice(F.sort_array(F.collect_set("sig")), 1, LEAST).alias("least"))
    filled = F.concat("least", F.array_repeat(F.element_at("least", 1), F.lit(LEAST) - F.size("least")))
    known = told.where("n > 0").distinct().withColumn("texts", F.count(F.lit(1)).over(Window.partitionBy("key"))).join(some, "key")
    least = F.when(F.col("texts") == 1, filled).otherwise(F.array_repeat(F.lit(NONE), LEAST))
    known = written(known.select("key", "n", "sketch", least.alias("least")), "join-known")
    sketched = member.join(known, "key")
    # texts of all that meet anyone, gathered once
    few = texts.select("key", squeezed(F.col("text")).alias("text"))
    kept = written(few.join(member.select("key").distinct(), "key").groupBy("key").agg(F.collect_set("text").alias("texts")), "join-texts")
    nearest = _close(sketched.withColumn("component", F.col("key")), rule, every=False).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    tried = written(_verified(nearest, kept, rule), "join-tried")
    first = written(components(tried.where("linked").select("a", "b")), "join-components")
    rest = sketched.join(first.select("key", F.col("component").alias("c")), "key", "left").withColumn("component", F.coalesce("c", "key")).drop("c")
    left = _close(rest, rule, every=True).distinct().join(tried, ["a", "b"], "left_anti")
    last = written(_verified(left, kept, rule), "join-left")
    links = tried.where("linked").select("a", "b").unionByName(last.where("linked").select("a", "b"))
    every = written(components(links), "join-components")
    # a class that joins no other is its own component; a shared key may be in several
    edges = classes.join(every.select(F.col("key").alias("class"), "component"), "class", "left").select("key", F.coalesce("component", "class").alias("component"))
    whole = every.unionByName(edges).groupBy("key").agg(F.min("component").alias("component"))
    found = told.select("key", "n").join(whole, "key", "left")
    return found.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"))
