"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsight.llm import (
    bpe, decontaminate, hash_forest, id_files, language_id, license_scan, partenum, secret_scan, suffix_repeats, url_filter, warc, whitening,
    word_runs,
)
from opsight.llm.common import delete_on_exit, table
from opsight.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"
END_ID = 2
RULES = (
    url_filter.Rule("org/", "allow"), url_filter.Rule("example.org/es/", "block"), url_filter.Rule("example.org/en/1", "block"),
    url_filter.Rule("com/fr/", "allow"), url_filter.Rule("com/de/", "block"),
)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def held_out(key: str = "doc_id"):
    """A row without a key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


@query
def op1_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every vector whose id is divisible by 20."""
    return hash_forest.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return partenum.join(table(spark, sf_dir, "documents").select("doc_id", "text"), partenum.Rule(4, 85, 100))


@query
def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that documents with smaller ids have."""
    kept = suffix_repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the two thirds that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = language_id.fit(docs, ~F.col("held_out"))
    return language_id.predict(docs, model).select("doc_id", "held_out", "lang_pred", "score")


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts per base kind, digest of the base spans, all spans."""
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("spans")
    count = lambda kind: F.size(secret_scan.of_kind(spans, kind)).cast("long").alias(f"n_{kind}")
    base = secret_scan.joined(secret_scan.of_kind(spans, "assign", "access", "hex"))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"),
        secret_scan.joined(spans).alias("spans"), count("named"),
    )


@query
def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as counts and digests."""
    path = public_tokenizers.path(VOCABULARY)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, path, keep=["doc_id"], decoded="decoded")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and benchmark item that the document holds within the item's error budget."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("hits").alias("hit"))
    return found.select("doc_id", F.col("hit.item").alias("item_id"), F.col("hit.distance").alias("distance"))


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives in the shared folder and read back."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), path)
    delete_on_exit(spark, path)
    back = warc.read(spark, path, texts=False)
    return back.select(
        F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"), "url",
    )


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "score")


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document."""
    found = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score",
    )


def looped(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) in which every tenth document, by the checksum h of its id, goes round in circles.

    With n words and g = h // 10, the words from a = g % n on are the first p of them
    over and over, p = 1 + (n - a) // (3 + g % 8). Null ids leave a text as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    chosen = docs.withColumns({"h": h, "words": F.when(h % 10 == 0, words)}).withColumn("n", F.size("words"))
    g, a, p = F.floor(F.col("h") / 10), F.col("a"), F.col("p")
    chosen = chosen.withColumn("a", F.when(F.col("n") > 0, (g % F.col("n")).cast("int")))
    chosen = chosen.withColumn("p", (1 + F.floor((F.col("n") - a) / (3 + g % 8))).cast("int"))
    round_ = F.slice("words", a + 1, p)
    times = F.ceil((F.col("n") - a) / p).cast("int")
    turned = F.slice(F.concat(F.slice("words", F.lit(1), a), F.flatten(F.array_repeat(round_, times))), F.lit(1), F.col("n"))
    return chosen.select("doc_id", F.when(a.isNotNull(), F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


@query
def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, the longest of them, and digests of all and of what stays."""
    found = word_runs.find_runs(looped(table(spark, sf_dir, "documents").select("doc_id", "text")))
    runs = F.col("runs")
    longest = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = found.withColumn("best", longest)
    length, period = -F.col("best.less"), F.col("best.period")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op12_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to files with seek tables in the shared folder and read back."""
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    id_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_VOCABULARY), end=END_ID)
    delete_on_exit(spark, path)
    back = id_files.read(spark, path, ids=False)
    return back.select(F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector along the first 16 components, in units of their deviations."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    explained = F.array(*map(F.lit, model.explained)) if model.explained else F.array().cast("array<double>")
    rows = whitening.transform(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return rows.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("place")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )


ORACLE["op8_warc"] = """
WITH p AS (
  SELECT page_id, url, sha1(coalesce(html, '')) AS payload_digest,
         CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes
  FROM pages
), g AS (
  SELECT payload_digest, max(page_id) AS last_id FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN last_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last_id <> page_id THEN last_id END AS refers_to, url
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest
"""
