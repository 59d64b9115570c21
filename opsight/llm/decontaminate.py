"""Benchmark decontamination by pigeonhole edit matching.

Each benchmark item may differ from a passage by an error budget of k edits. Cut into
k + 1 pieces, at least one piece must then stand in the passage unchanged. All pieces
go into one Aho-Corasick automaton; each hit fixes where the item would lie, and the
text there is compared with Myers' bit-parallel edit distance.

Text is compared in lower case with runs of white space as one space. Items are
broadcast in blocks of bounded size; more items mean more blocks, not larger ones.
"""

from __future__ import annotations

import uuid
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsight.llm.common import give_back

#: Edits allowed per 100 characters of an item.
ERROR_PERCENT = 5
#: Items with fewer characters are matched without errors and only as whole words.
LEAST_CHARS = 20
#: Characters of the items in one broadcast block (about: items are dealt by a hash).
BLOCK_CHARS = 4 << 20
#: Letters of scripts without spaces: Thai, Lao, Tibetan, Burmese, Khmer, kana and ideographs.
UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def spaced(c: str) -> bool:
    """Whether c belongs to a word of a script that puts spaces between words."""
    return c.isalnum() and not UNSPACED.match(c)


def apart(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] neither begins nor ends inside a word."""
    return not any(0 < at < len(text) and spaced(text[at - 1]) and spaced(text[at]) for at in (start, end))


def budget(length: int, percent: int = ERROR_PERCENT) -> int:
    return length * percent // 100


def pieces(item: str, errors: int) -> Iterator[tuple[int, str]]:
    """Offset and text of errors + 1 pieces of nearly equal length."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield a, item[a:b]


def myers(pattern_bits: dict[str, int], length: int, text: str) -> int:
    """Least edit distance between the pattern and any part of text; bit vectors of any length."""
    ones = (1 << length) - 1
    top = 1 << (length - 1)
    plus, minus, score = ones, 0, length
    best = score
    for c in text:
        eq = pattern_bits.get(c, 0)
        x = eq | minus
        d0 = ((((x & plus) + plus) ^ plus) | x) & ones
        h_plus = minus | (~(d0 | plus) & ones)
        h_minus = plus & d0
        if h_plus & top:
            score += 1
        elif h_minus & top:
            score -= 1
        h_plus = (h_plus << 1) & ones  # a match may begin anywhere
        h_minus = (h_minus << 1) & ones
        plus = h_minus | (~(d0 | h_plus) & ones)
        minus = h_plus & d0
        if score < best:
            best = score
    return best


def bits(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


@dataclass
class Item:
    key: object
    text: str
    errors: int
    bits: dict[str, int]
    short: bool


class Matcher:
    """The automaton over the pieces of a block of items."""

    def __init__(self, items: Iterable[tuple[object, str]], percent: int, least: int):
        self.items: list[Item] = []
        where: dict[str, list[tuple[int, int]]] = {}
        for key, raw in items:
            text = normal(raw)
            if not text:
                continue
            short = len(text) < least
            errors = 0 if short else budget(len(text), percent)
            for offset, piece in pieces(text, errors):
                where.setdefault(piece, []).append((len(self.items), offset))
            self.items.append(Item(key, text, errors, bits(text), short))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def find(self, raw: str | None) -> list[tuple[object, int]]:
        """Key and least distance of each item that the text holds within its budget, by order of the items."""
        if not raw or not self.items:
            return []
        text = normal(raw)
        best: dict[int, int] = {}
        tried: dict[int, set[int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for i, offset in places:
                if best.get(i) == 0:
                    continue
                item = self.items[i]
                start = end + 1 - size - offset
                if item.short:  # its one piece is the whole item
                    if apart(text, start, end + 1):
                        best[i] = 0
                    continue
                if start in (seen := tried.setdefault(i, set())):
                    continue
                seen.add(start)
                if start >= 0 and text.startswith(item.text, start):
                    best[i] = 0
                    continue
                window = text[max(0, start - item.errors) : start + len(item.text) + item.errors]
                found = myers(item.bits, len(item.text), window)
                if found <= item.errors and found < best.get(i, item.errors + 1):
                    best[i] = found
        return [(self.items[i].key, best[i]) for i in sorted(best)]


def blocks(benchmark: DataFrame, key: str, text: str, limit: int) -> Iterator[list[tuple]]:
    """The items in blocks of about `limit` characters, each small enough to broadcast."""
    items = benchmark.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    total = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-total // limit))
    for i in range(n):
        own = items.where(F.pmod(F.xxhash64("key", "text"), F.lit(n)) == i) if n > 1 else items
        yield sorted((tuple(r) for r in own.collect()), key=repr)


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", hits: str = "hits", item_key: str = "item_id",
            item_text: str = "text", percent: int = ERROR_PERCENT, least: int = LEAST_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with an array of (item, distance) for the items that each whole text holds.

    Items of fewer than `least` characters are held where they stand unchanged and
    as whole words. Null and empty texts and items match nothing; an empty benchmark gives
    empty arrays. Items with equal keys count apart. Repeated rows of docs keep one
    result each; a column of the name `hits` is replaced.
    """
    kind = benchmark.schema[item_key].dataType
    schema = T.ArrayType(T.StructType([T.StructField("item", kind), T.StructField("distance", T.IntegerType())]))

    def finder(held):
        @F.pandas_udf(schema)
        def find(texts: pd.Series) -> pd.Series:
            matcher = _matcher(held)
            found = pd.Series([[{"item": k, "distance": d} for k, d in matcher.find(t if isinstance(t, str) else None)] for t in texts], dtype=object)
            give_back()
            return found

        return find

    found = []
    for items in blocks(benchmark, item_key, item_text, block_chars):
        held = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, items, percent, least))
        found.append(finder(held)(F.col(text)))
    return docs.withColumn(hits, F.concat(*found) if len(found) > 1 else found[0])


#: Automata a Python worker keeps; the least recently used one goes.
KEPT_BLOCKS = 4
_built: dict[str, Matcher] = {}


def _matcher(held) -> Matcher:
    """The automaton of a block, built once per Python worker, under the name that its broadcast carries."""
    name, *parts = held.value
    matcher = _built.pop(name, None) or Matcher(*parts)
    while len(_built) >= KEPT_BLOCKS:
        _built.pop(next(iter(_built)))
    _built[name] = matcher
    return matcher
