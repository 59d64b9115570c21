"""Language identification: multinomial naive Bayes over hashed character n-grams.

Text is folded to lower case, everything that is no letter becomes a space, and each
1-, 2- and 3-gram of code points is hashed to one of `BUCKETS` columns. Training sums
the counts per language on the executors; the matrix of log probabilities (languages
x buckets, a fixed size) is broadcast. A batch of texts is scored in numpy: one
look-up of matrix rows per n-gram, summed per text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsight.llm.common import free_name, give_back, share

BUCKETS = 1 << 16
#: Labelled rows that training reads at most (about: rows are picked by a hash).
MAX_ROWS = 20_000
#: Most languages a model may have; more is an error, as the matrix is broadcast.
MAX_LANGUAGES = 500
UNKNOWN = "und"
#: Code points scored at once.
SLICE = 1 << 18

_SPACE = 32
_MULTIPLIERS = tuple(np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263, 374761393, 1640531527))
_fold_table: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """For each code point its lower case if it is a letter, else a space."""
    if not _fold_table:
        table = np.full(sys.maxunicode + 1, _SPACE, np.uint32)
        for c in range(sys.maxunicode + 1):
            char = chr(c)
            if char.isalpha():
                low = char.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _fold_table.append(table)
    return _fold_table[0]


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of the texts, each followed by two spaces, and where each begins."""
    joined = "  ".join([*texts, ""])
    points = fold_table()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    return points, np.cumsum([0, *(len(t) + 2 for t in texts)])


def grams(points: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of the 1-, 2- and 3-grams that start at each but the last two points."""
    a, b, c = points[:-2], points[1:-1], points[2:]
    p = _MULTIPLIERS
    drop = np.uint32(16)
    yield (a * p[0]) >> drop
    yield (a * p[1] + b * p[2]) >> drop
    yield (a * p[3] + b * p[4] + c * p[5]) >> drop


@dataclass
class Model:
    languages: list[str]
    #: log P(bucket | language), buckets x languages
    log_p: np.ndarray
    log_prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior of each text; UNKNOWN and 0 without text, letter or model."""
        languages, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        start = size = 0
        for i in range(len(texts) + 1):
            if i == len(texts) or size >= SLICE:
                self._predict(texts[start:i], languages, scores, start)
                start, size = i, 0
            if i < len(texts):
                size += len(texts[i] or "")
        return languages, scores

    def _predict(self, texts, languages, scores, first) -> None:
        if not texts or not self.languages:
            return
        points, begins = folded([t or "" for t in texts])
        total = np.tile(self.log_prior, (len(texts), 1))
        letters = np.zeros(len(texts), np.int64)
        for at in range(0, len(points) - 2, SLICE):
            part = points[at : at + SLICE + 2]
            lo = np.searchsorted(begins, at, "right") - 1
            hi = np.searchsorted(begins, at + len(part) - 2, "left")
            own = np.arange(lo, hi)
            cuts = np.maximum(begins[lo:hi] - at, 0)
            is_letter = part[:-2] != _SPACE
            letters[own] += np.add.reduceat(is_letter, cuts, dtype=np.int64)
            for bucket in grams(part):
                total[own] += np.add.reduceat(self.log_p[bucket], cuts, axis=0, dtype=np.float64)
        best = total.argmax(axis=1)  # languages are sorted, so a tie goes to the first name
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        top = odds.max(axis=1) / odds.sum(axis=1)
        for i in np.flatnonzero(letters):
            languages[first + i], scores[first + i] = self.languages[best[i]], top[i]


def fit(docs: DataFrame, learn: Column, label: str = "lang", text: str = "text", key: str = "doc_id",
        max_rows: int = MAX_ROWS) -> Model:
    """Learn from the rows where `learn` holds and label and text are not null.

    At most about max_rows of them are read, picked by a hash of the key. No such
    row gives a model without languages, which predicts UNKNOWN for every text.
    """
    fit_rows = docs.where(learn & F.col(label).isNotNull() & F.col(text).isNotNull())
    found = fit_rows.count()
    picked = fit_rows.where(share(F.col(key), max_rows, found)).select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            for name, group in batch.groupby("label"):
                own = sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                rows[name] = rows.get(name, 0) + len(group)
                for one in group["text"]:
                    points, _ = folded([one])
                    for bucket in grams(points):
                        own += np.bincount(bucket, minlength=BUCKETS)
            if len(sums) > MAX_LANGUAGES:
                raise ValueError(f"more than {MAX_LANGUAGES} languages")
        give_back()
        for name, own in sums.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"label": name, "bucket": np.r_[at, -1], "n": np.r_[own[at], rows[name]]})

    sums = picked.mapInPandas(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sums["label"].unique())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    place = {name: i for i, name in enumerate(languages)}
    counts, prior = np.zeros((BUCKETS, len(languages))), np.zeros(len(languages))
    column = sums["label"].map(place).to_numpy(dtype=np.int64)
    bucket, n = sums["bucket"].to_numpy(), sums["n"].to_numpy()
    prior[column[bucket < 0]] = n[bucket < 0]
    counts[bucket[bucket >= 0], column[bucket >= 0]] = n[bucket >= 0]
    smooth = counts + 0.5
    log_p = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)
    return Model(languages, np.ascontiguousarray(log_p), np.log(prior / max(prior.sum(), 1)))


def predict(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its posterior (0 to 1) for every whole text.

    A null text or one without a letter is UNKNOWN with score 0. Ties go to the
    first language by name. Repeated rows keep one result each; columns of the
    names given are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            languages, scores = held.value.predict([t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame({"lang": languages, "score": scores})
        give_back()

    judged = free_name("judged", docs.columns)
    out = docs.drop(lang, score).withColumn(judged, judge(F.col(text)))
    return out.withColumns({lang: F.col(judged)["lang"], score: F.col(judged)["score"]}).drop(judged)
