"""URL filter: rules first, then the ratio of two character language models.

Both models are variable-order Markov models: the probability of a character after
its longest known context is interpolated with that after ever shorter contexts.
One is fitted on accepted and one on rejected URLs. A URL's score is the difference
of the two log-likelihoods divided by its length; the threshold is the one with the
best balanced accuracy on a part of the labelled URLs that the models did not see.
Counts and threshold come from every distinct labelled URL and are made by Spark. Small
models are held by the driver and the workers; larger ones stay tables, and the scores
come from joins with them, so every count enters as it is at any size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsight.llm.common import free_name, share, written
from opsight.operators.scan import lead, ordered_scan, row_number, running_sum

#: Longest context, in characters.
ORDER = 4
#: Different pairs of context and character up to which models are held by the driver and the workers.
MAX_PAIRS = 2_000_000
#: Classes, by remainder of the key, that contexts and pairs share in a model that was asked to be smaller; a prime.
CLASSES = 4_194_301
#: Characters that are counted or judged at once, about.
SLICE = 1 << 19
#: Weight of the shorter context in the interpolation.
SHRINK = 1.0
ALPHABET = 256


@dataclass(frozen=True)
class Rule:
    """A host, with all its subdomains, and the start of a path; verdict is allow or block."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        head, slash, tail = self.text.partition("/")
        return slash + tail


def host(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z in lower case; else empty."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), upper, lower), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: Iterable[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, both null if none does."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        at_host = (host == rule.host) | host.endswith("." + rule.host)
        fits = at_host & path.startswith(rule.path)
        text = F.when(fits, rule.text).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def _contexts(urls: Sequence[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Characters of all URLs, a key of the context at each order, and where each URL begins."""
    raw = [u.encode() + b"\n" for u in urls]
    chars = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    begins = np.cumsum([0, *map(len, raw)])[:-1]
    at = np.arange(len(chars)) - np.repeat(begins, [len(r) for r in raw])
    keys = [np.zeros(len(chars), np.uint64)]
    for order in range(1, ORDER + 1):
        before = np.zeros(len(chars), np.uint64)
        before[order:] = chars[: len(chars) - order] + np.uint64(1)
        before[at < order] = 0  # before the start
        keys.append((keys[-1] << np.uint64(9)) | before)
    return chars, [k | np.uint64(order) << np.uint64(40) for order, k in enumerate(keys)], begins


def _slices(urls: Iterable[str | None]) -> Iterator[list[str]]:
    """URLs in lists of about SLICE characters; null as an empty text."""
    part, size = [], 0
    for u in urls:
        part.append(u if isinstance(u, str) else "")
        size += len(part[-1]) + 1
        if size >= SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


class Markov:
    """Counts of (context, character) and of contexts, as sorted arrays.

    With `classes`, keys stand for their remainders by it, and those of one remainder share a count.
    """

    classes = 0

    def __init__(self, urls: Sequence[str]):
        chars, keys, _ = _contexts(urls)
        contexts = np.concatenate(keys)
        self.context, self.context_n = np.unique(contexts, return_counts=True)
        both = (contexts << np.uint64(8)) | np.tile(chars, len(keys))
        self.pair, self.pair_n = np.unique(both, return_counts=True)

    @classmethod
    def of_counts(cls, context: pd.DataFrame, pair: pd.DataFrame, classes: int = 0) -> Markov:
        """From tables (key, n) of contexts and pairs."""
        made = cls.__new__(cls)
        context, pair = context.sort_values("key"), pair.sort_values("key")
        made.context, made.context_n = context["key"].to_numpy(np.uint64), context["n"].to_numpy(np.int64)
        made.pair, made.pair_n = pair["key"].to_numpy(np.uint64), pair["n"].to_numpy(np.int64)
        made.classes = classes
        return made

    def _look(self, keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(asked))
        if self.classes:
            asked = asked % np.uint64(self.classes)
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return np.where(keys[at] == asked, values[at], 0)

    def log_p(self, chars: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
        p = np.full(len(chars), 1 / ALPHABET)
        for key in keys:
            seen = self._look(self.context, self.context_n, key)
            hit = self._look(self.pair, self.pair_n, (key << np.uint64(8)) | chars)
            hit = np.minimum(hit, seen)  # pairs of a shared class may be more than their context
            p = (hit + SHRINK * p) / (seen + SHRINK)
        return np.log(p)


@dataclass
class Model:
    accepted: Markov
    rejected: Markov
    threshold: float = 0.0

    def scores(self, urls: Sequence[str | None]) -> np.ndarray:
        """Log-likelihood under `accepted` less that under `rejected`, per character; null counts as empty."""
        if not len(urls):
            return np.zeros(0)
        chars, keys, begins = _contexts([u or "" for u in urls])
        diff = self.accepted.log_p(chars, keys) - self.rejected.log_p(chars, keys)
        lengths = np.diff(np.r_[begins, len(chars)])
        return np.add.reduceat(diff, begins) / lengths


def calibrated(good: np.ndarray, bad: np.ndarray) -> float:
    """The threshold t with the most balanced accuracy of `score >= t is good`; 0 if a side is empty.

    Of equal ones the one nearest 0 is taken, halfway between two scores.
    """
    if not len(good) or not len(bad):
        return 0.0
    every = np.unique(np.r_[good, bad])
    cuts = np.r_[every[0] - 1, (every[1:] + every[:-1]) / 2, every[-1] + 1]
    good, bad = np.sort(good), np.sort(bad)
    right = (1 - np.searchsorted(good, cuts) / len(good)) + np.searchsorted(bad, cuts) / len(bad)
    best = cuts[right >= right.max() - 1e-12]
    return float(best[np.abs(best).argmin()])


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for name, group in batch.groupby("verdict"):
            for part in _slices(group["url"]):
                own = Markov(part)
                yield pd.DataFrame({"verdict": name, "key": own.pair.astype(np.int64), "n": own.pair_n})


def _counted(urls: DataFrame) -> DataFrame:
    """pairs(verdict, key, n) of context and character in urls(verdict, url), written; every URL counts."""
    counted = urls.mapInPandas(_pairs, "verdict string, key long, n long").groupBy("verdict", "key")
    return written(counted.agg(F.sum("n").alias("n")), "url_pairs")


def _contexts_of(pairs: DataFrame) -> DataFrame:
    """contexts(verdict, key, n) of a table of pairs."""
    return pairs.withColumn("key", F.shiftright("key", 8)).groupBy("verdict", "key").agg(F.sum("n").alias("n"))


def _models(pairs: DataFrame, classes: int = 0) -> Model:
    """Both models, as `_counted` made them, in the driver's memory; with `classes`, those of one remainder share a count."""
    contexts = _contexts_of(pairs)
    if classes:
        shared = F.pmod("key", F.lit(classes)).alias("key")
        pairs, contexts = (t.groupBy("verdict", shared).agg(F.sum("n").alias("n")) for t in (pairs, contexts))
    pairs, contexts = pairs.toPandas(), contexts.toPandas()
    return Model(*[Markov.of_counts(contexts[contexts["verdict"] == v], pairs[pairs["verdict"] == v], classes) for v in ("allow", "block")])


def threshold_of(scored: DataFrame) -> float:
    """`calibrated` over a table of any size: scored(verdict, score), verdicts allow and block."""
    side = lambda name: F.count_if(F.col("verdict") == name)
    line = written(scored.groupBy("score").agg(side("allow").alias("_good"), side("block").alias("_bad")), "url_scores")
    good, bad, low, high = line.agg(F.sum("_good"), F.sum("_bad"), F.min("score"), F.max("score")).first()
    if not good or not bad:
        return 0.0
    summed = ordered_scan(line, [], ["score"], [running_sum("_below", "_good"), running_sum("_under", "_bad"), lead("_next", "score")])
    right = (1 - F.col("_below") / good) + F.col("_under") / bad
    cuts = summed.where("_next IS NOT NULL").select(((F.col("score") + F.col("_next")) / 2).alias("cut"), right.alias("right"))
    ends = scored.sparkSession.createDataFrame([(low - 1, 1.0), (high + 1, 1.0)], "cut double, right double")
    cuts = cuts.unionByName(ends)
    best = cuts.groupBy("right").agg(F.min(F.struct(F.abs("cut").alias("far"), "cut")).alias("c"))
    top = best.agg(F.max("right")).first()[0]
    return best.where(F.col("right") >= top - 1e-12).agg(F.min("c")["cut"]).first()[0]


def _numbered(labelled: DataFrame, url: str, verdict: str, max_urls: int | None) -> tuple[DataFrame, DataFrame]:
    """(verdict, url) of the distinct URLs for the models and of those that only calibrate, as `fit` says."""
    known = labelled.where(F.col(verdict).isin("allow", "block") & F.col(url).isNotNull())
    known = known.select(F.col(verdict).alias("verdict"), F.col(url).alias("url"))
    if max_urls is not None:
        distinct = known.select("verdict", F.xxhash64("url").alias("h")).dropDuplicates()
        counts = {r[0]: r[1] for r in distinct.groupBy("verdict").count().collect()}
        wanted = [(F.col("verdict") == name) & share(F.col("url"), max_urls, counts.get(name, 0)) for name in ("allow", "block")]
        known = known.where(wanted[0] | wanted[1])
    numbered = ordered_scan(known.dropDuplicates(), ["verdict"], ["url"], [row_number("_n")])
    numbered = written(numbered, "labelled_urls")
    calibrates = F.col("_n") % 4 == 1
    return numbered.where(~calibrates).drop("_n"), numbered.where(calibrates).drop("_n")


def fit(labelled: DataFrame, url: str = "url", verdict: str = "verdict", max_urls: int | None = None, max_pairs: int | None = None) -> Model:
    """Fit on all distinct URLs whose verdict is allow or block; max_urls, if given, bounds them (about) per verdict.

    Of the URLs of a verdict in order, the first and every fourth after it only
    calibrate. Without rows of one verdict the models fall back on uniform
    characters, so that the other side still scores. The driver holds the model. With
    max_pairs, models of more different pairs share counts by remainder, which is an
    approximation; `filter_urls` does not use it.
    """
    fitted, calibrating = _numbered(labelled, url, verdict, max_urls)
    pairs = _counted(fitted)
    model = _models(pairs, CLASSES if max_pairs is not None and pairs.count() > max_pairs else 0)
    model.threshold = threshold_of(score(calibrating, model).select("verdict", "score"))
    return model


def score(df: DataFrame, model: Model, url: str = "url", out: str = "score") -> DataFrame:
    """df with the length-normalised log-likelihood difference of each URL (null counts as empty)."""
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(urls: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([*[held.value.scores(part) for part in _slices(urls)], np.zeros(0)]))

    return df.withColumn(out, judge(F.col(url)))


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pair of the longest context for each character of texts(h1, h2, text)."""
    for batch in batches:
        done = 0
        for part in _slices(batch["text"]):
            chars, keys, begins = _contexts(part)
            at = done + np.repeat(np.arange(len(part)), np.diff(np.r_[begins, len(chars)]))
            pair = ((keys[ORDER] << np.uint64(8)) | chars).astype(np.int64)
            yield pd.DataFrame({"h1": batch["h1"].to_numpy()[at], "h2": batch["h2"].to_numpy()[at], "key": pair})
            done += len(part)


def _ids(text: Column) -> tuple[Column, Column]:
    """Two hashes that stand for a text."""
    return F.xxhash64(text), F.xxhash64(F.lit("url"), text, F.length(text))


def score_by_joins(df: DataFrame, pairs: DataFrame, url: str = "url", out: str = "score") -> DataFrame:
    """What `score` gives under the models of a table of pairs, which nobody has to hold.

    The probability after a context depends on its last ORDER characters alone, so it
    is computed once for each different window of ORDER + 1 characters, from the
    shortest context to the longest, and each URL sums those of its windows.
    """
    text = F.coalesce(F.col(url), F.lit(""))
    first, second = _ids(text)
    texts = df.select(first.alias("h1"), second.alias("h2"), text.alias("text")).dropDuplicates(["h1", "h2"])
    asked = written(texts.mapInPandas(_windows, "h1 long, h2 long, key long"), "url_windows")
    side = lambda name: F.coalesce(F.sum(F.when(F.col("verdict") == name, F.col("n"))), F.lit(0))
    counts = lambda t, at, *names: t.groupBy(F.col("key").alias(at)).agg(*[side(v).alias(n) for v, n in zip(("allow", "block"), names, strict=True)])
    hits, seen = counts(pairs, "_pair", "_hit_a", "_hit_r"), counts(_contexts_of(pairs), "_context", "_seen_a", "_seen_r")
    windows = written(asked.select("key").distinct(), "url_distinct_windows")
    context = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 9 * ORDER) - 1))
    last = F.col("key").bitwiseAND(F.lit(255))
    pair_of = lambda k: F.shiftleft(F.shiftright(context, 9 * (ORDER - k)).bitwiseOR(F.lit(k << 40)), 8).bitwiseOR(last)
    chances = None
    for k in range(ORDER + 1):
        own = windows.select(pair_of(k).alias("pair"), *([pair_of(k - 1).alias("_shorter")] if k else [])).distinct()
        if k:
            own = own.join(chances.withColumnRenamed("pair", "_shorter"), "_shorter")
        else:
            own = own.withColumns({"a": F.lit(1 / ALPHABET), "r": F.lit(1 / ALPHABET)})
        own = own.join(hits, F.col("pair") == F.col("_pair"), "left").join(seen, F.shiftright("pair", 8) == F.col("_context"), "left")
        p = lambda v: (F.coalesce(f"_hit_{v}", F.lit(0)) + SHRINK * F.col(v)) / (F.coalesce(f"_seen_{v}", F.lit(0)) + SHRINK)
        chances = written(own.select("pair", p("a").alias("a"), p("r").alias("r")), "url_chances")
    gain = chances.select("pair", (F.log("a") - F.log("r")).alias("gain"))
    own_ids = [free_name(n, [*df.columns, out]) for n in ("_h1", "_h2")]
    sums = asked.join(gain, asked["key"] == gain["pair"]).groupBy("h1", "h2").agg((F.sum("gain") / F.count(F.lit(1))).alias(out))
    sums = sums.select(F.col("h1").alias(own_ids[0]), F.col("h2").alias(own_ids[1]), out)
    return df.drop(out).withColumns(dict(zip(own_ids, (first, second), strict=True))).join(sums, own_ids, "left").drop(*own_ids)


def filter_urls(df: DataFrame, rules: Sequence[Rule], url: str = "url", max_urls: int | None = None, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """df with host, path, rule, verdict and score of every URL.

    The longest rule that fits decides. Without one the models do, fitted on all
    URLs that rules decide: `allow` from the threshold on, else `block`. A null URL
    or one without :// has empty host and path and counts as an empty text for the
    models. Repeated rows are judged each; columns of these names are replaced.
    Models of more than max_pairs different pairs are joined instead of sent to the workers.
    """
    own = df.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    text, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    ruled = own.withColumns({"rule": text, "verdict": verdict})
    fitted, calibrating = _numbered(ruled, url, "verdict", max_urls)
    pairs = _counted(fitted)
    if pairs.count() <= max_pairs:
        model = _models(pairs)
        judged = lambda t, name: score(t, model, name)
    else:
        judged = lambda t, name: score_by_joins(t, pairs, name)
    threshold = threshold_of(judged(calibrating, "url").select("verdict", "score"))
    by_model = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return judged(ruled, url).withColumn("verdict", F.coalesce("verdict", by_model))
