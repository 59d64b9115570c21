"""Secret scan by assignment-aware lexing.

Three token patterns give the base spans. Beside them source and configuration
syntax is read as pairs of a name and an expression: `name = "literal"`, `name: literal`,
`"name" => 'literal'`, strings of one or several lines, YAML blocks (`name: |`), markup
(`<name>literal</name>`, `<add key="name" value="literal"/>`), and sums of strings and
names. Names in an expression, and `${name}`, `$name`, `{{ name }}` or `#{name}` in a
string, are constants: they are followed, over any number of steps, to the literals of
the nearest binding before their use, or else of the first one after it. A bare dotted
name, a call, and a bare name of several words beside a spaced `=` are no literals. A
pair is scored by how sensitive the words of its name are and how much the joined
literals look like a value; at or above the threshold the literals are spans of kind
`named`.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsight.llm.common import give_back

# The base patterns, with the least lengths put into them.
KINDS = ("assign", "access", "hex", "named")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6
#: One of these stands in every text in which ASSIGN can match.
ASSIGN_HINTS = ("passw", "secret", "token", "api")

#: How far each word of a target name speaks for a secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.6, "private": 0.5, "access": 0.4, "key": 0.5, "signature": 0.5,
}
#: Words that speak for a secret only beside another word.
SENSITIVE_BESIDE = {"pass": 0.9, "pw": 0.9, "pin": 0.6}
#: Words that tell of a name about a secret rather than the secret.
HARMLESS = {"length": 0.8, "name": 0.5, "id": 0.3, "file": 0.5, "path": 0.6, "type": 0.8, "count": 0.8, "public": 0.6, "url": 0.5}
PLACEHOLDERS = ("[secret]", "example", "changeme", "placeholder", "redacted", "none", "null", "true", "false", "your_", "xxxx", "****")
THRESHOLD = 0.5
#: Characters of the parts, each half over the next, in which a long literal's variety is looked for.
PART = 256

_TARGET = re.compile(r"""(?<![A-Za-z0-9_.-])([A-Za-z_][A-Za-z0-9_.-]*+)["']?([ \t]*+)(:=|=>|=(?!=)|:(?!:))([ \t]*+)""")
#: One operand of an expression: strings of several lines, strings, a reference, a bare word.
_OPERAND = re.compile(
    r"""(?:[rRbBuUfF]{1,2}(?=["']))?(?:"{3}((?:[^"\\]|\\[\s\S]|"(?!""))*+)"{3}|'{3}((?:[^'\\]|\\[\s\S]|'(?!''))*+)'{3}"""
    r"""|"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`((?:[^`\\\n]|\\.)*+)`)|(\$\{[^{}\n]*+\})|([^\s"',;#(){}\[\]<>]++)"""
)
_LINES, _REFERENCE, _BARE = (1, 2), 6, 7
#: Between operands; in parentheses lines may end there. Strings may also just follow each other.
_JOIN = re.compile(r"""[ \t]*+(?:\+|\.(?=[ \t"'])|(?=["']))[ \t]*+""")
_JOIN_INSIDE = re.compile(r"""\s*+(?:\+|\.(?=[\s"'])|(?=["']))\s*+""")
_OPEN = re.compile(r"\(\s*+")
_BLOCK = re.compile(r"[|>][0-9+-]*+[ \t]*+(?:#[^\n]*+)?\n")
_TAG = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]*+)([^<>]*+)>(?:([^<>]++)</)?")
_ATTRIBUTE = re.compile(r"""([A-Za-z_][A-Za-z0-9_.:-]*+)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)')""")
_IN_STRING = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_.]*+)[^{}\n]*+\}|\$([A-Za-z_][A-Za-z0-9_]*+)|\{\{[ \t]*+([A-Za-z_][A-Za-z0-9_.]*+)[ \t]*+\}\}|#\{([A-Za-z_][A-Za-z0-9_.]*+)\}")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*")
#: A name made of words, and one made of several.
_WORDY = re.compile(r"_*(?:[A-Z]?[a-z]{2,}|[A-Z]{2,})(?:_?(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}))*_*[0-9]{0,2}")
_SEVERAL = re.compile(r"[A-Za-z]_+[A-Za-z]|[a-z][A-Z]")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> float:
    words = [w.lower() for w in _WORDS.findall(name)]
    joined = "".join(words)
    known = SENSITIVE | SENSITIVE_BESIDE if len(words) > 1 else SENSITIVE
    weights = [known.get(w, 0.0) for w in words] + [SENSITIVE["apikey"] * ("apikey" in joined)]
    most, rest = max(weights, default=0.0), 1.0
    if sum(w > 0 for w in weights) > 1:  # several hints make up for weak ones
        most = min(1.0, sum(sorted(weights)[-2:]))
    for w in words:
        rest *= 1 - HARMLESS.get(w, 0.0)
    return most * rest


def entropy(value: str) -> float:
    """Bits a character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def literal_score(value: str) -> float:
    """0 for what can be no secret, rising with length and with the variety of characters."""
    low = value.lower()
    if len(value) < LEAST_VALUE or any(p in low for p in PLACEHOLDERS) or value[:1] in "$%{<":
        return 0.0
    # the whole literal and each part of it, so that no uniform stretch hides what stands before or behind it
    parts = [value] + ([value[i : i + PART] for i in range(0, len(value) - PART // 2, PART // 2)] if len(value) > PART else [])
    return min(1.0, 0.4 + max(map(entropy, parts)) / 5)


@dataclass(frozen=True)
class Part:
    """A literal of an expression, or with `maybe` a bare name that may stand for one."""

    start: int
    end: int
    value: str
    maybe: bool = False
    spaced: bool = False


def _expression(text: str, at: int, spaced: bool) -> tuple[list[Part], int]:
    """The parts of the expression at a place, and where to read on."""
    parts: list[Part] = []
    inside = _OPEN.match(text, at)
    join, at = (_JOIN_INSIDE, inside.end()) if inside else (_JOIN, at)
    last, on = 0, at
    while m := _OPERAND.match(text, at):
        kind, end = m.lastindex, m.end()
        (start, to), value = m.span(kind), m[kind]
        if kind == _BARE:
            if value.endswith("+") and text[end : end + 1] in ('"', "'"):  # a + stands right before a string
                value, end, to = value[:-1], end - 1, to - 1
            if parts and not _NAME.fullmatch(value):
                break
            if text[end : end + 1] in ("(", "["):  # a call or an element is no literal
                return parts, end
            parts.append(Part(start, to, value, bool(_NAME.fullmatch(value)), spaced))
        elif parts and last not in (0, _REFERENCE, _BARE) and not parts[-1].maybe and kind != _REFERENCE:
            before = parts.pop()  # joined strings are one literal
            parts.append(Part(before.start, to, before.value + value))
        else:
            parts.append(Part(start, to, value))
        # what stands in a string of several lines is read too
        on = start if kind in _LINES and last == 0 else end
        more = join.match(text, end)
        if not more or (kind == _BARE and (not parts[-1].maybe or more[0].isspace() or not more[0])):
            break
        last, at = kind, more.end()
    return parts, on


def _yaml_block(text: str, name: int, at: int) -> Part | None:
    """The lines that are indented deeper than the line of the name."""
    head = text[text.rfind("\n", 0, name) + 1 : name]
    if head.strip(" \t-\"'"):
        return None
    start = end = at
    while end < len(text):
        to = text.find("\n", end) + 1 or len(text)
        line = text[end:to]
        if line.strip() and len(line) - len(line.lstrip(" \t")) <= len(head.rstrip("\"'")):
            break
        end = to
    body = text[start:end]
    start += len(body) - len(body.lstrip())
    return Part(start, start + len(body.strip()), body.strip()) if body.strip() else None


def assignments(text: str) -> list[tuple[int, str, list[Part]]]:
    """Place, name and expression of all assignments, by place."""
    found, at = [], 0
    while m := _TARGET.search(text, at):
        block = _BLOCK.match(text, m.end()) if m[3] == ":" else None
        body = _yaml_block(text, m.start(1), block.end()) if block else None
        if body:
            parts, at = [body], block.end()
        else:
            parts, at = _expression(text, m.end(), m[3] in ("=", ":=") and bool(m[2]) and bool(m[4]))
        at = max(at, m.end())
        if parts:
            found.append((m.start(1), m[1], parts))
    for m in _TAG.finditer(text) if "<" in text else ():
        own = {a[1].lower(): a for a in _ATTRIBUTE.finditer(text, m.start(2), m.end(2))}
        names = [m[1].rpartition(":")[2]] + [a[2] or a[3] or "" for k in ("key", "name", "id") if (a := own.get(k))]
        spans = [own["value"].span(own["value"].lastindex)] if "value" in own else []
        if m[3] and m[3].strip():
            start = m.start(3) + len(m[3]) - len(m[3].lstrip())
            spans.append((start, start + len(m[3].strip())))
        found += [(m.start(), n, [Part(a, b, text[a:b])]) for n in names if n for a, b in spans]
    return sorted(found, key=lambda f: f[0])


def _is_name(part: Part) -> bool:
    """Whether a bare word reads as a name of something else rather than as a value."""
    steps = part.value.split(".")
    if not all(map(_WORDY.fullmatch, steps)):
        return False
    return len(steps) > 1 or (part.spaced and bool(_SEVERAL.search(part.value)))


def named_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, float]]:
    """Spans of literals that sensitive names stand for, with their scores.

    Constants are followed to a fixed point; a circle of names ends where it meets
    itself. A literal that several names stand for has its highest score.
    """
    found = assignments(text)
    bound: dict[str, list[int]] = {}
    for i, (_, name, _) in enumerate(found):
        bound.setdefault(name, []).append(i)

    def binding(name: str, user: int) -> int | None:
        places = bound.get(name, ())
        before = bisect.bisect_left(places, user)
        others = [p for p in (*places[max(0, before - 1) : before], *places[before : before + 2]) if p != user]
        return others[0] if others else None

    own: list[list[Part]] = []  # literals of each assignment, and the assignments that it names
    uses: list[list[int]] = []
    for i, (_, _, parts) in enumerate(found):
        kept, used = [], []
        for p in parts:
            names = [p.value] if p.maybe else [m[m.lastindex] for m in _IN_STRING.finditer(p.value)] if "$" in p.value or "{" in p.value else []
            known = {n: at for n in names if (at := binding(n, i)) is not None}
            if p.maybe:
                value = "" if known or _is_name(p) else p.value
            else:
                value = _IN_STRING.sub(lambda m: "" if m[m.lastindex] in known else m[0], p.value) if known else p.value
            if any(map(str.isalnum, value)):
                kept.append(Part(p.start, p.end, value))
            used += known.values()
        own.append(kept)
        uses.append(used)

    ends: dict[int, int] = {}

    def end_of(at: int) -> int:
        """The assignment behind a chain of mere names."""
        path: dict[int, None] = {}
        while at not in ends and at not in path and not own[at] and len(uses[at]) == 1:
            path[at] = None
            at = uses[at][0]
        at = ends.get(at, at)
        ends.update(dict.fromkeys(path, at))
        return at

    # what stands in a sensitive expression is as sensitive; the highest weight comes first
    scores = [name_score(name) for _, name, _ in found]
    weight = [0.0] * len(found)
    for first in sorted(range(len(found)), key=lambda i: -scores[i]):
        if scores[first] < threshold or not scores[first]:
            break
        todo = [first]
        while todo:
            i = todo.pop()
            if not weight[i]:
                weight[i] = scores[first]
                todo += uses[i]
    best: dict[tuple[int, int], float] = {}
    alone: dict[int, float] = {}

    def best_alone(i: int) -> float:
        if i not in alone:
            alone[i] = max((literal_score(p.value) for p in own[i] if len(p.value) >= LEAST_VALUE), default=0.0)
        return alone[i]

    for i in range(len(found)):
        if not weight[i]:
            continue
        behind = list(dict.fromkeys(end_of(at) for at in uses[i]))
        parts = own[i] + [p for at in behind for p in own[at]]
        value = max(map(best_alone, (i, *behind)))
        if parts and all(len(p.value) < LEAST_VALUE for p in parts):
            value = literal_score("".join(p.value for p in parts))
        for p in parts if weight[i] * value >= threshold else ():
            best[p.start, p.end] = max(weight[i] * value, best.get((p.start, p.end), 0.0))
    return sorted((*span, score) for span, score in best.items())


def scan(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of one text, by start and then by the order of KINDS; offsets in code points."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [("assign", m.start(), m.end(), 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    found += [("access", m.start(), m.end(), 1.0) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), 1.0) for m in HEX.finditer(text)]
    if "=" in text or ":" in text or "</" in text:
        found += [("named", *span) for span in named_spans(text, threshold)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()),
]))


def find_secrets(df: DataFrame, text: str = "text", spans: str = "spans", threshold: float = THRESHOLD) -> DataFrame:
    """df with an array of spans (kind, start, end, score) for the whole text of each row.

    A null or empty text has an empty array. Repeated rows keep one result each;
    a column of the name `spans` is replaced, all others pass through.
    """

    @F.pandas_udf(SPANS)
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in scan(t if isinstance(t, str) else None, threshold)] for t in texts], dtype=object)
        give_back()

    return df.withColumn(spans, find(F.col(text)))


def redact(df: DataFrame, text: str = "text", mark: str = "[secret]", threshold: float = THRESHOLD) -> DataFrame:
    """df with every span replaced by mark; spans that touch or overlap become one mark.

    Null stays null, a text without a span stays as it is.
    """

    def covered(spans: list[tuple[str, int, int, float]]) -> Iterator[tuple[int, int]]:
        start = end = -1
        for _, a, b, _ in spans:
            if a > end:
                if end >= 0:
                    yield start, end
                start, end = a, b
            end = max(end, b)
        if end >= 0:
            yield start, end

    def clean(t: str) -> str:
        at, out = 0, []
        for start, end in covered(scan(t, threshold)):
            out += [t[at:start], mark]
            at = end
        return "".join([*out, t[at:]]) if out else t

    @F.pandas_udf("string")
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([clean(t) if isinstance(t, str) else None for t in texts], dtype=object)
        give_back()

    return df.withColumn(text, cut(F.col(text)))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
