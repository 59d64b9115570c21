"""Approximate nearest neighbours by a hash-prefix forest.

Every tree gives each vector a long string of bits, one per random hyperplane, and
keeps the vectors as arrays sorted by that string. A query descends each tree: the
vectors that share its longest prefixes stand next to the place of its own string.
From there all trees are ascended together, one bit at a time, until the shared
prefixes hold enough candidates; these are scored exactly.

The arrays are cut into bounded blocks: by the first bits of the string and then by a
hash of the identifier, so that equal strings never make a large block. Queries are
cut as well and meet every block of their own first bits. The first pass only counts,
with strings alone, how many candidates each level would give; the second scores the
ranges of the chosen level and keeps the best of each block.

Inner products are searched as angles: vectors get one more component that brings
all to the largest norm, queries a zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEIGHBOURS = 20
TREES = 20
#: Bits of a hash string.
BITS = 48
#: Candidates (counted once per tree that finds them) to gather: a share of all vectors, and a least number.
CANDIDATE_SHARE, LEAST_CANDIDATES = 1.0, 20_000
#: Vectors and queries in a block.
BLOCK, QUERY_BLOCK = 16_384, 4_096


def usable(vectors: DataFrame, key: str, vector: str, dim: int | None = None) -> tuple[DataFrame, int]:
    """Rows (id, v) with a key and a finite vector other than zero of the given or else the most frequent length."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0))
    if dim is None:
        top = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
        dim = top[0] if top else 1
    return rows.where(F.size("v") == dim), dim


def planes(dim: int, trees: int, bits: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(1234)).standard_normal((dim + 1, trees * bits))


def hash_strings(v: np.ndarray, extra: np.ndarray, normals: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """Hash strings as integers, one row per vector and one column per tree; the first bit is the highest."""
    signs = (np.c_[v, extra] @ normals > 0).reshape(len(v), trees, bits)
    weights = np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64)
    return (signs * weights).sum(axis=2)


def search(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS,
           trees: int = TREES, bits: int = BITS, share: float = CANDIDATE_SHARE, least: int = LEAST_CANDIDATES,
           block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k nearest rows found for every query row: query_id, rank (from 1), vec_id, score.

    `is_query` is a condition on the column `id` (the key as a long). Nearest is the
    largest inner product in double precision, ties go to the smaller id; a query's
    own id is no candidate. Vectors that are null, empty, zero, of another length
    than the most frequent one, or hold null or non-finite components take no part,
    nor do null keys. Of rows that repeat a key the best score counts. With no more
    vectors than asked for all are returned.
    """
    spark = vectors.sparkSession
    rows, dim = usable(vectors, key, vector)
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm2).alias("top")).first()
    n, top = stats["n"], stats["top"] or 1.0
    wanted = max(least, int(share * n))
    # no query needs prefixes shorter than these: a few levels above where the average one stops
    first = int(max(0, np.floor(np.log2(max(1.0, trees * n / wanted))) - 2))
    held = spark.sparkContext.broadcast(planes(dim, trees, bits))

    def strings(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in source:
            for at in range(0, len(part), 2048):
                own = part.iloc[at : at + 2048]
                v = np.stack(own["v"].to_numpy()).astype(np.float64)
                rest = np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0.0))
                ask = own["is_query"].to_numpy(bool)
                raw = [x.tobytes() for x in v]
                for side, extra, mine in ((0, rest, np.ones(len(v), bool)), (1, np.zeros(len(v)), ask)):
                    if not mine.any():
                        continue
                    h = hash_strings(v[mine], extra[mine], held.value, trees, bits)
                    yield pd.DataFrame({
                        "side": side, "tree": np.tile(np.arange(trees), int(mine.sum())), "id": np.repeat(own["id"].to_numpy()[mine], trees),
                        "h": h.reshape(-1), "v": [r for r, m in zip(raw, mine, strict=True) if m for _ in range(trees)],
                    })

    hashed = rows.withColumn("is_query", is_query).mapInPandas(strings, "side int, tree int, id long, h long, v binary")
    bucket = F.shiftrightunsigned("h", bits - first) if first else F.lit(0).cast("long")
    hashed = hashed.withColumn("bucket", bucket)
    # per bucket a bounded number of rows: trees times the first bits, a fixed share of the forest
    sizes = hashed.groupBy("tree", "bucket").agg(
        F.ceil(F.sum(1 - F.col("side")) / block).alias("blocks"), F.ceil(F.sum("side") / query_block).alias("q_blocks")).where("blocks > 0 AND q_blocks > 0")
    placed = hashed.join(F.broadcast(sizes), ["tree", "bucket"])
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("side") == 0, F.col("blocks")).otherwise(F.col("q_blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("side") == 0, F.col("q_blocks")).otherwise(F.col("blocks")) - 1))
    placed = placed.withColumns({"mine": mine}).withColumn("other", other)
    dealt = placed.select(
        "side", "tree", "bucket", "id", "h", "v",
        F.when(F.col("side") == 0, F.col("mine")).otherwise(F.col("other")).alias("b"),
        F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("mine")).alias("qb"),
    )
    group = ["tree", "bucket", "b", "qb"]
    levels = np.arange(first, bits + 1)

    def count(part: pd.DataFrame) -> pd.DataFrame:
        """For each query and level how many strings of the block share so many bits."""
        index, asks = part[part["side"] == 0], part[part["side"] == 1]
        h, q = np.sort(index["h"].to_numpy()), asks["h"].to_numpy()
        low = np.array([np.searchsorted(h, (q >> (bits - x)) << (bits - x)) for x in levels])
        high = np.array([np.searchsorted(h, ((q >> (bits - x)) + 1) << (bits - x)) for x in levels])
        return pd.DataFrame({"id": asks["id"].to_numpy(), "found": list((high - low).T.astype(np.int64))})

    narrow = dealt.drop("v")
    counted = narrow.groupBy(*group).applyInPandas(count, "id long, found array<long>")
    sums = counted.groupBy("id").agg(*(F.sum(F.col("found")[i]).alias(f"c{i}") for i in range(len(levels))))
    enough = [F.when(F.col(f"c{i}") >= wanted, F.lit(int(x))) for i, x in enumerate(levels)]
    level = F.coalesce(F.greatest(*enough), F.lit(int(first))) if len(enough) > 1 else F.lit(int(first))
    chosen = sums.select("id", level.alias("level"))

    def score(part: pd.DataFrame) -> pd.DataFrame:
        """The k best (and one more, for the query itself) of each query's range in the block."""
        index, asks = part[part["side"] == 0], part[part["side"] == 1]
        index = index.iloc[np.argsort(index["h"].to_numpy(), kind="stable")]
        h, ids = index["h"].to_numpy(), index["id"].to_numpy()
        out_q, out_i, out_s = [], [], []
        if len(index) and len(asks):
            v = np.frombuffer(b"".join(index["v"]), np.float64).reshape(len(index), dim)
            q = np.frombuffer(b"".join(asks["v"]), np.float64).reshape(len(asks), dim)
            qid, shift = asks["id"].to_numpy(), bits - asks["level"].to_numpy()
            prefix = asks["h"].to_numpy() >> shift
            order = np.lexsort((prefix, shift))
            cuts = np.flatnonzero((np.diff(prefix[order]) != 0) | (np.diff(shift[order]) != 0)) + 1
            parts = [x[i : i + 256] for x in np.split(order, cuts) for i in range(0, len(x), 256)]
            for own in parts:
                s, p = shift[own[0]], prefix[own[0]]
                a, b = np.searchsorted(h, p << s), np.searchsorted(h, (p + 1) << s)
                if a == b:
                    continue
                near = q[own] @ v[a:b].T
                if b - a > k + 1:
                    edge = -np.partition(-near, k, axis=1)[:, k]
                    at = near >= (edge - 1e-9 * np.maximum(1.0, np.abs(edge)))[:, None]  # with what only rounding parts
                else:
                    at = np.ones(near.shape, bool)
                for i, hit in zip(own, at, strict=True):
                    c = np.flatnonzero(hit) + a
                    exact = (v[c] * q[i]).sum(axis=1)
                    best = np.lexsort((ids[c], -exact))[: k + 1]
                    out_q.append(np.full(len(best), qid[i]))
                    out_i.append(ids[c][best])
                    out_s.append(exact[best])
        cat = lambda parts, kind: np.concatenate([*parts, np.zeros(0, kind)])
        return pd.DataFrame({"query_id": cat(out_q, np.int64), "vec_id": cat(out_i, np.int64), "score": cat(out_s, np.float64)})

    asks = dealt.where("side = 1").join(chosen, "id").select("side", *group, "id", "h", "v", "level")
    both = dealt.where("side = 0").select("side", *group, "id", "h", "v", F.lit(0).alias("level")).unionByName(asks)
    scored = both.groupBy(*group).applyInPandas(score, "query_id long, vec_id long, score double")
    # a candidate found in several trees counts once; each block sends a bounded list per query
    found = scored.where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)  # cut before the shuffle, too
    return ranked.select("query_id", "rank", "vec_id", "score")
