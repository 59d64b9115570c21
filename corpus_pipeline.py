"""A corpus from documents to token ids, each stage over all that the one before kept.

1. language_id: documents without a language (no text, or no letter) go.
2. ngram_join: of documents whose 5-word shingles have a Jaccard similarity of 0.8 or
   more, directly or through others, the one with the smallest id stays.
3. decontaminate: documents that hold a benchmark item within its error budget go.
4. secret_scan: secrets in the texts that are left give way to a mark.
5. bpe: the texts are encoded, and decoded again as a check.

Rows with a null id take part in all stages but the second, which keeps them as they
are. Of rows that share an id the second stage keeps the one with the smallest text.
An empty table gives an empty result; extra columns are carried to the fourth stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsight.llm import bpe, decontaminate, language_id, partenum, secret_scan
from opsight.llm.common import free_name, ready, table, written

VOCABULARY = "byte_bpe_50k.json"
#: Bytes of rows that a Python worker gets at once: all stages share the executors, whose buffers outside the
#: heap stay as large as the largest batch. With the last row it is less than `partenum.CHUNK_BYTES`, as a rule.
BATCH_BYTES = "1800k"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark, BATCH_BYTES)
    model = language_id.fit(docs, F.lit(True))
    lang, score = free_name("lang_pred", docs.columns), free_name("lang_score", docs.columns)
    judged = language_id.predict(docs, model, lang=lang, score=score)
    return judged.where(F.col(lang) != language_id.UNKNOWN).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark, BATCH_BYTES)
    joined = partenum.join(docs, partenum.Rule(5, 80, 100))
    stays = joined.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(stays, "doc_id", "left_semi").select(*docs.columns)
    one, n = F.row_number().over(Window.partitionBy("doc_id").orderBy("text")), free_name("n", docs.columns)
    return kept.withColumn(n, one).where(F.col(n) == 1).drop(n).unionByName(docs.where("doc_id IS NULL"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hits = free_name("hits", docs.columns)
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark", BATCH_BYTES), hits=hits)
    return found.where(F.size(hits) == 0).drop(hits)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark, BATCH_BYTES)
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark, BATCH_BYTES)
    path = public_tokenizers.path(VOCABULARY)
    coded = bpe.encode(docs.select("doc_id", "text"), path, keep=["doc_id"], decoded="decoded")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.array_join("ids", ",").alias("token_ids"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language), ("ngram_join", drop_near_copies), ("decontaminate", drop_leaks),
    ("secret_scan", mask_secrets), ("bpe", tokenize),
]

#: The first, fourth and fifth stage have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents", BATCH_BYTES)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
