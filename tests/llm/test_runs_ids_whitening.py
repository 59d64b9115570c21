"""Word runs, id files and whitening against plain forms, with null, empty, repeated, long and clashing input."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from opsight.llm import id_files, queries, whitening, word_runs

WORDS = public_tokenizers.path("word_bpe_49k.json")


def plain_runs(words, least=6, times=4):
    """Runs by comparing words at every distance."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            part = words[i : i + length]
            smallest = next(p for p in range(1, q + 1) if part[p:] == part[: length - p])
            if length >= max(least, times * q) and smallest == q:
                out.append((i, length, q))
            i = j
    return sorted(out)


def plain_collapse(words, found):
    gone = {i for start, length, period in found for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(rng):
    """Short words, copies of copies, runs inside runs."""
    out = []
    while len(out) < rng.choice((0, 3, 20, 60, 150)):
        kind = rng.random()
        if kind < 0.4:
            out += rng.choices("ab", k=rng.randint(1, 9))
        elif kind < 0.7:
            out += rng.choices("abcdefgh", k=rng.randint(1, 6)) * rng.randint(2, 7)
        elif out:
            out += out[-rng.randint(1, len(out)) :] * rng.randint(1, 4)
        if len(out) > 300:
            break
    return out


def test_runs_of_batches_equal_those_of_single_texts():
    rng = random.Random(3)
    texts = [random_words(rng) for _ in range(250)] + [[], ["a"] * 5, ["a"] * 6, ["a", "b"] * 4, ["a", "a", "b"] * 4 + ["a"]]
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        got = list(word_runs.search([" ".join(t).encode() for t in part]))
        for words, (n, runs, collapsed) in zip(part, got, strict=True):
            wanted = plain_runs(words)
            assert n == len(words) and [tuple(r) for r in runs.tolist()] == wanted
            assert collapsed == plain_collapse(words, wanted)


def test_runs_of_long_texts(monkeypatch):
    monkeypatch.setattr(word_runs, "PIECE", 50)
    rng = random.Random(4)
    turn = [f"w{rng.randint(0, 900)}" for _ in range(1500)]
    words = [f"x{i}" for i in range(700)] + turn * 4 + turn[:77] + ["y"] * 20_000 + ["z", "y"] * 5_000
    ((n, runs, collapsed),) = word_runs.search([(" \t\n".join(words) + " ").encode()])
    wanted = [(700, 6077, 1500), (6777, 20_000, 1), (26_776, 10_001, 2)]
    assert n == len(words) and [tuple(r) for r in runs.tolist()] == wanted
    assert collapsed == plain_collapse(words, wanted)


def test_runs_of_odd_rows(spark):
    loop = "so it goes " * 5
    rows = [(1, loop, "x"), (1, loop, "x"), (2, None, None), (None, "", "y"), (3, "  \n", "z"), (4, "é " * 6 + " \x1c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumn("__text", F.lit(1))
    got = sorted(((r["doc_id"] or 0), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in word_runs.find_runs(docs).collect())
    assert got == [
        (0, 0, [], ""), (1, 15, [(0, 15, 3)], "so it goes"), (1, 15, [(0, 15, 3)], "so it goes"), (2, 0, [], ""), (3, 0, [], ""),
        (4, 7, [(0, 6, 1)], "é  \x1c"),
    ]
    assert word_runs.find_runs(docs.limit(0)).count() == 0


def as_looped(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return [w.decode() for w in words]


def test_runs_query(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.choice((" ", "  ", "\t\n")).join(random_words(rng) + ["w"] * rng.choice((0, 7)))) for i in range(160)]
    rows += [(200, None), (201, ""), (None, "a b " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op11_word_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows) > 8
    for doc_id, text in rows:
        words = as_looped(doc_id, text)
        found, r = plain_runs(words), got[doc_id]
        best = min(((-length, start, period) for start, length, period in found), default=None)
        wanted = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(found), *wanted), doc_id
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(plain_collapse(words, found).encode()).hexdigest()


# ---- id files ----

ODD = [
    "", " ", "one", "One ONE  onE's", "naïve CAFÉ école Å İ ΣΑΣ", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "a\x1cb\x1dc\x85d\xa0e f​g\x00h",
    "12345 3.14 a1b2 'S it's we'LL ''s", "́ leading ́mark x\ń", "日本語 テキスト ﬁ ǅ", "힣각 \U0001f600👩‍👩‍👧", "x" * 5000, "　wide space",
]


def test_pieces_are_encoded_as_in_the_text(monkeypatch):
    library = Tokenizer.from_file(WORDS)
    encoder = id_files.Encoder(*id_files.Encoder.parts(WORDS))
    assert encoder.apart
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choices("aB'sd \t\n\x0b\x0c\r.,é́Kİͅ\x1c\xa05<|>", k=rng.randint(1, 60))) for _ in range(3000)]
    texts.insert(40, "LONG text's " * 400)
    wanted = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for slice_bytes in (id_files.SLICE, 700):
        monkeypatch.setattr(id_files, "SLICE", slice_bytes)
        monkeypatch.setattr(id_files, "MEMORY", slice_bytes)
        monkeypatch.setattr(id_files, "JOINED", slice_bytes // 20)
        for text, ids, want in zip(texts, encoder.encode_all([t.encode() for t in texts]), wanted, strict=True):
            assert ids.tolist() == want, repr(text)


def test_id_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(id_files, "FILE_BYTES", 2000)
    monkeypatch.setattr(id_files, "FRAME_IDS", 400)
    rng = random.Random(6)
    rows = [(3 * i - 50, " ".join(f"word{rng.randint(0, 500)}" for _ in range(rng.choice((0, 3, 80))))) for i in range(300)]
    rows += [(7, "same"), (7, "same"), (7, "other"), (None, "no key"), (None, None), (10**15, None), (5000, "a b " * 3000)] + list(enumerate(ODD, 6000))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string").repartition(5)
    path = str(tmp_path / "ids")
    id_files.write(docs, path, WORDS, end=2)
    library = Tokenizer.from_file(WORDS)
    encoded = {t: [*library.encode(t or "", add_special_tokens=False).ids, 2] for _, t in rows}
    got = id_files.read(spark, path).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r["start"])
    assert [r["key"] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert sorted((r["key"] or -1, r["ids"]) for r in got) == sorted((d if d is not None else -1, encoded[t]) for d, t in rows)
    at = 0
    for r in got:
        assert r["start"] == at and r["n_ids"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_ids"]
    # any zstandard reader opens the files and finds the ids in a row
    parts = sorted((tmp_path / "ids").glob("part-*"), key=lambda p: (p.name.split("-")[1], int(p.stem.split("-c")[-1])))
    assert len(parts) > 8
    stream = b"".join(zstandard.ZstdDecompressor().stream_reader(p.read_bytes(), read_across_frames=True).read() for p in parts)
    assert np.frombuffer(stream, "<u2").tolist() == [i for r in got for i in r["ids"]]
    # look-ups give the same rows
    some = id_files.read(spark, path, keys=[7, 5000, 4, 12345, 10**15]).collect()
    assert sorted(map(tuple, some)) == sorted(tuple(r) for r in got if r["key"] in (7, 5000, 4, 10**15))
    assert len(id_files.read(spark, path, keys=[]).collect()) == 0


def test_only_frames_asked_for_are_opened():
    made = id_files.FileMaker(2, 0)
    for k in range(5):
        made.add(k, np.arange(1000, dtype=np.uint32) * (k + 1) % 49000)
    content = bytearray(made.content() + id_files.END)
    file = id_files.FileReader(bytes(content))
    assert file.document(3).tolist() == [i * 4 % 49000 for i in range(1000)]
    content[int(file.at[3]) + 20] ^= 1  # in the frame of document 2
    broken = id_files.FileReader(bytes(content))
    assert broken.document(3).tolist() == file.document(3).tolist()
    with pytest.raises((ValueError, zstandard.ZstdError)):
        broken.document(2)
    with pytest.raises(ValueError, match="no seek table"):
        id_files.FileReader(bytes(content[:-3]))


def test_id_files_of_an_empty_table_and_wide_ids(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    id_files.write(docs, str(tmp_path / "none"), WORDS, end=2)
    assert id_files.read(spark, str(tmp_path / "none")).count() == 0
    one = spark.createDataFrame([(1, "Hello there")], "doc_id long, text string")
    other = public_tokenizers.path("byte_bpe_50k.json")
    id_files.write(one, str(tmp_path / "one"), other, end=70_000)
    ids = Tokenizer.from_file(other).encode("Hello there", add_special_tokens=False).ids
    assert id_files.read(spark, str(tmp_path / "one")).first()["ids"] == [*ids, 70_000]


# ---- whitening ----


def plain_whitening(vectors, k):
    rows = [v for v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.floor(64 * np.array(rows, np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    c = (n * fit - total) / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    deviation = np.square(n * x - total).sum(axis=1)
    return n, deviation, ((n * x - total) / n) @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum(), values


def same_up_to_sign(a, b):
    return all(min(np.abs(a[:, i] - b[:, i]).max(), np.abs(a[:, i] + b[:, i]).max()) < 1e-6 for i in range(b.shape[1]))


def test_whitening(spark, tmp_path):
    rng = np.random.default_rng(5)
    vectors = (rng.standard_normal((400, 24)) * np.linspace(3, 0.2, 24)).tolist()
    vectors += vectors[:50] + [vectors[0]] * 200
    odd = [None, [*vectors[0][:23], None], [*vectors[0][:23], float("nan")], [float("inf"), *vectors[0][1:]]]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(10**6 + i, v) for i, v in enumerate(odd)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op13_whitening(spark, str(tmp_path)).orderBy("vec_id", "component").collect()
    n, deviation, whitened, explained, _ = plain_whitening(vectors, 16)
    assert len(got) == 16 * len(vectors) and {r["n"] for r in got} == {n} and n <= 400
    assert [r["deviation"] for r in got[::16]] == deviation.tolist()
    assert same_up_to_sign(np.array([r["whitened"] for r in got]).reshape(-1, 16), whitened)
    assert np.allclose([r["explained"] for r in got[:16]], explained, rtol=1e-9)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_singular_values_of_any_rank():
    rng = np.random.default_rng(1)
    for n, d, rank, equal in [(50, 8, 8, 0), (50, 8, 3, 0), (5, 12, 5, 0), (60, 10, 10, 4), (40, 300, 40, 0), (500, 200, 200, 0)]:
        x = rng.standard_normal((n, rank)) @ rng.standard_normal((rank, d))
        if equal:
            u, s, vt = np.linalg.svd(x, full_matrices=False)
            s[:equal] = s[0]
            x = u @ np.diag(s) @ vt
        passes = []
        s, v = whitening.bidiagonal(d, lambda z: (passes.append(1), (x.T @ (x @ z), float((x @ z) @ (x @ z))))[1], min(16, d), float(np.linalg.norm(x)))
        exact = np.linalg.svd(x, compute_uv=False)
        want = np.r_[exact, np.zeros(d)][: len(s)]
        assert np.allclose(s, want, atol=1e-9 * want[0])
        assert np.allclose(v.T @ v, np.eye(len(s)), atol=1e-10)
        good = s > 1e-9 * s[0]
        assert np.allclose(np.linalg.norm(x @ v, axis=0)[good], s[good], rtol=1e-9)
        assert np.allclose(x.T @ (x @ v[:, good]), v[:, good] * s[good] ** 2, atol=1e-8 * s[0] ** 2)
        assert len(passes) <= d


def test_whitening_of_odd_rows(spark):
    schema = T.StructType().add("vec_id", "long").add("embedding", T.ArrayType(T.FloatType())).add("whitened", "string").add("__v", "string")
    none = spark.createDataFrame([], schema)
    assert whitening.transform(none, whitening.fit(none)).count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0], "x", "p"), (1, [1.0, 2.0], "x", "p"), (None, None, None, None)], schema)
    model = whitening.fit(same)
    assert (model.n, len(model.values)) == (1, 0)
    got = whitening.transform(same, model).collect()
    assert [(r["vec_id"], r["deviation"], r["whitened"]) for r in got] == [(1, 0, []), (1, 0, [])]
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0], "x", "p") for i in range(9)] + [(99, [1.0], "y", "q"), (98, [], None, None)], schema)
    model = whitening.fit(flat)
    assert model.n == 9 and len(model.values) == 1 and abs(model.explained[0] - 1) < 1e-12
    rows = whitening.transform(flat, model).where("__v = 'p'").collect()
    assert len(rows) == 9 and abs(np.var([r["whitened"][0] for r in rows]) - 1) < 1e-9
    far = spark.createDataFrame([(i, [float(1 << 31) * i, 1.0 * i], "x", "p") for i in range(200)], schema)
    with pytest.raises(Exception, match="beyond a long"):
        whitening.transform(far, whitening.fit(far)).collect()
