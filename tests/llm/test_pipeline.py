"""The pipeline against plain forms of its stages, and the contract of the registered queries."""

import hashlib

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from opsight.llm import decontaminate, partenum, secret_scan
from tests.llm import reference

SF_DIR = "/root/testdata/sf0.001"


def masked(text):
    out, at = [], 0
    for _, a, b, _ in secret_scan.scan(text):
        if b > at:
            out += [text[at:a], "[secret]"] if a >= at and (a > at or not out) else []
            at = b
    return "".join([*out, text[at:]])


def leaked(text, items):
    """Whether the whole text holds an item within its budget, by the distance to every item."""
    text = decontaminate.normal(text)
    return any(decontaminate.myers(decontaminate.bits(i), len(i), text) <= decontaminate.budget(len(i)) for i in items)


def test_pipeline_is_its_plain_form(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    items = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    docs = {r["doc_id"]: r["text"] for r in rows if r["text"] and any(c.isalpha() for c in r["text"])}
    groups = reference.similar_components(docs.items(), 5, 80)
    docs = {d: t for d, t in docs.items() if groups[d][1] == d}
    docs = {d: masked(t) for d, t in docs.items() if not leaked(t, items)}
    whole = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert set(got) == set(docs) and len(docs) < len(rows)
    for d, text in docs.items():
        ids = ",".join(map(str, whole.encode(text, add_special_tokens=False).ids))
        assert got[d]["token_ids"] == ids
        assert got[d]["ids_sha256"] == hashlib.sha256(ids.encode()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_stages_hand_small_batches_to_python(spark):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    docs = spark.createDataFrame([(1, "some words", "en")], "doc_id long, text string, lang string")
    wide = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("x"), 1000).alias("text"))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR)
        got = [r["n"] for r in wide.mapInArrow(sizes, "n long").collect()]
        assert 6_000_000 <= sum(got) and max(got) <= partenum.CHUNK_BYTES, name


def test_stages_keep_columns_and_take_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(40))
    rows = [(1, long, "en", "s", 7, 1.0), (1, long, "en", "s", 7, 1.0), (2, long + " more", None, None, None, None), (3, None, "en", "s", 0, 0.0),
            (None, "free text", "en", "s", 9, 0.5), (4, "", "en", "s", 0, 0.0), (5, 'x password = "abcdefgh1"', "en", "s", 24, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    for frame in (docs, docs.limit(0)):
        kept = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, SF_DIR)
            assert kept.columns == docs.columns
        out = kept.collect()
        assert sorted((r["doc_id"] or 0) for r in out) == ([0, 1, 5] if frame is docs else [])
    assert [r["text"] for r in out if r["doc_id"] == 5] == []
    clean = corpus_pipeline.mask_secrets(spark, docs, SF_DIR).where("doc_id = 5").first()
    assert "abcdefgh1" not in clean["text"] and clean["n_chars"] == len(clean["text"])


def test_stages_leave_columns_of_any_name(spark):
    long = " ".join(f"word{i}" for i in range(40))
    names = ("__row", "__lang", "__n", "__hits", "hits", "n", "judged", "lang_pred", "lang_score")
    docs = spark.createDataFrame([(1, long, "en", *names), (2, long, "en", *names)], ["doc_id", "text", "lang", *names])
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF_DIR)
        assert kept.columns == docs.columns
    assert [tuple(r) for r in kept.collect()] == [(1, long, "en", *names)]


def test_every_operator_is_registered(spark):
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "decontaminate", "secret_scan", "bpe"]
    plan = entry.queries()["op10_license_scan"](spark, SF_DIR)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_language_on_held_out_documents(spark):
    got = entry.queries()["op4_language_id"](spark, "/root/testdata/sf0.01").where("held_out")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = got.join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.95
