"""Every operator against a plain form, with null, empty, repeated, long and clashing input."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from opsight.llm import bpe, decontaminate, hash_forest, language_id, license_scan, partenum, secret_scan, suffix_repeats, url_filter, warc
from opsight.llm.components import components
from opsight.llm.words import runs, words
from tests.llm import reference

DOCS = "doc_id long, text string"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def invented(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randint(0, vocabulary)}" for _ in range(n))


def edited(text, seed, times):
    rng, w = random.Random(seed), text.split()
    for _ in range(times):
        w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies at many distances, shared passages, short, empty, null and very long texts."""
    rng = random.Random(5)
    texts = [None, "", "   \n", "one", "ONE", "two words", "Two  WORDS", "a b c d", "é à ü ö", invented(1, 30_000)]
    passage = invented(99, 60)
    for i in range(12):
        base = invented(100 + i, rng.choice((8, 20, 60, 200, 500)))
        texts.append(base)
        texts += [edited(base, 7 * i + j, j) for j in range(1, 9)] + [base, base.upper()]
        texts.append(invented(300 + i, 40) + "\n" + passage + "\t" + invented(400 + i, 40))
    return list(enumerate(texts, 3))


def test_word_hashes_are_those_of_single_words():
    raw = ["Ab cd\x0bAb", "", "ab\x85x  cd ", "\x1cAb"]
    data = np.frombuffer("".join(raw).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(r.encode()) for r in raw)])
    for fold in (False, True):
        found = words(data, offsets, fold)
        plain = [w for r in raw for w in (r.encode().lower() if fold else r.encode()).split()]
        assert [data[a:b].tobytes().lower() for a, b in zip(found.starts, found.ends, strict=True)] == [w.lower() for w in plain]
        assert len(set(found.hashes.tolist())) == len(set(plain))
        assert found.counts().tolist() == [len(r.encode().split()) for r in raw]
    assert len(runs(found.hashes[:3], 4)) == 0


def test_repeats(spark, corpus):
    docs = spark.createDataFrame(corpus, DOCS).repartition(5)
    got = {r[0]: tuple(r)[1:] for r in suffix_repeats.remove_repeats(docs).withColumn("kept", F.sha2("kept", 256)).collect()}
    assert got == reference.kept_words(corpus)


def test_repeats_across_chunks_and_with_frequent_prefixes(spark, monkeypatch):
    rows = [(i, invented(7, 40) + f" end{i % 3} " + invented(i, 30)) for i in range(60)]
    monkeypatch.setattr(suffix_repeats, "REPORTED", 1)
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    flags = suffix_repeats.repeats(docs, buckets=1, group=40)
    assert flags.count() > 0
    tables, total = suffix_repeats.frequent_prefixes(docs.select(F.col("text").cast("binary").alias("text")), 13, 40)
    assert total == 60 * 71 and len(tables[0]) > 0
    got = {r[0]: tuple(r)[1:] for r in suffix_repeats.remove_repeats(docs).withColumn("kept", F.sha2("kept", 256)).collect()}
    assert got == reference.kept_words(rows)


def test_repeats_of_odd_rows(spark):
    text = invented(3, 30)
    rows = [(1, text, "x"), (2, text, "x"), (2, text, "x"), (2, invented(4, 30), "y"), (None, text, "z"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in suffix_repeats.remove_repeats(docs).collect())
    assert got == [(0, 0, 0), (0, 30, 0), (1, 30, 0), (2, 30, 0), (2, 30, 30), (2, 30, 30)]
    assert suffix_repeats.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80), (1, 60)])
def test_ngram_join(spark, corpus, n, num):
    docs = spark.createDataFrame(corpus, DOCS).repartition(5)
    got = {r[0]: (r["n_shingles"], r["component_id"]) for r in partenum.join(docs, partenum.Rule(n, num, 100)).collect()}
    assert got == reference.similar_components(corpus, n, num)


def test_ngram_join_in_small_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr(partenum, "BLOCK", 3)
    monkeypatch.setattr(partenum, "PAIR_WORDS", 5)
    rows = corpus[:80]
    got = {r[0]: (r["n_shingles"], r["component_id"]) for r in partenum.join(spark.createDataFrame(rows, DOCS).repartition(4), partenum.Rule(4, 85, 100)).collect()}
    assert got == reference.similar_components(rows)


def test_signatures_meet_for_every_similar_pair():
    """Random sets of all sizes: wherever two are similar enough, a signature is shared."""
    rule, rng = partenum.Rule(4, 85, 100), np.random.default_rng(2)
    for size in [*range(1, 40), 60, 90, 150]:
        a = np.sort(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        for _ in range(6):
            cut = rng.integers(0, size // 6 + 1)
            b = np.sort(np.r_[a[cut:], rng.integers(0, 1 << 63, rng.integers(0, size // 6 + 1), dtype=np.uint64)])
            if not rule.holds(a, b):
                continue
            owner = np.r_[np.zeros(len(a), np.int64), np.ones(len(b), np.int64)]
            found = [{}, {}]
            for s, t, band in partenum.signatures(owner, np.r_[a, b], 2, rule):
                for x, y in zip(s.tolist(), t.tolist(), strict=True):
                    found[y][x] = max(band, found[y].get(x, 0))
            marks = [max(found[0][x], found[1][x]) for x in found[0].keys() & found[1].keys()]
            assert any(m < partenum.HELD or m >= partenum.ASKED for m in marks)


def test_ngram_join_of_odd_rows(spark):
    text = invented(3, 30)
    rows = [(5, text, 1), (5, text, 1), (9, text, 2), (None, text, 3), (7, None, 4), (8, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(((r["doc_id"] or 0), r["n_shingles"], r["component_id"]) for r in partenum.join(docs).collect() if r["doc_id"])
    assert got == [(5, 26, 5), (5, 26, 5), (7, 0, 7), (8, 0, 8), (9, 26, 5)]
    split = [(1, invented(11, 60)), (1, invented(12, 60)), (2, edited(invented(11, 60), 1, 1)), (3, edited(invented(12, 60), 2, 1)), (4, invented(13, 60))]
    found = partenum.join(spark.createDataFrame(split, DOCS), partenum.Rule(2, 60, 100)).distinct()
    assert sorted((r["doc_id"], r["component_id"]) for r in found.collect()) == [(1, 1), (2, 1), (3, 1), (4, 4)]
    assert [r["component_id"] for r in partenum.join(docs).where("doc_id IS NULL").collect()] == [None]
    assert partenum.join(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(1, 2), (3, 2), (3, 4), (10, 11), (11, 10), (7, 7), *((20 + i, 21 + i) for i in range(30)), *((100, i) for i in range(101, 140))]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10} | {20 + i: 20 for i in range(31)} | {i: 100 for i in range(100, 140)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def nearest(rows, queries, k):
    out = {}
    for q, v in queries:
        scored = sorted((-float(np.dot(np.array(v, float), np.array(w, float))), i) for i, w in rows if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_forest_small_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) * rng.choice((1, 5))]) for i in range(80)]
    rows += [(200 + i, rows[0][1]) for i in range(30)]  # copies: ties by id
    bad = [(1000, None), (1001, [0.0] * 6), (1002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1003, [float("nan")] * 6), (1004, [1.0]), (None, [1.0] * 6), (1005, [float("inf")] * 6)]
    good = [r for r in rows if any(r[1])]
    frame = spark.createDataFrame([(*r, 0.5) for r in rows + bad], "vec_id long, embedding array<double>, score double")
    got = {}
    for r in hash_forest.search(frame, F.col("id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = nearest(good, [r for r in good if r[0] % 20 == 0], 20)
    assert set(got) == set(want)
    for q, found in got.items():
        assert [(r, i) for r, i, _ in sorted(found)] == [(n, i) for n, (i, _) in enumerate(want[q], 1)]
        assert all(abs(s - w) < 1e-9 for (_, _, s), (_, w) in zip(sorted(found), want[q], strict=True))
    assert hash_forest.search(frame.limit(0), F.col("id") % 20 == 0).count() == 0


def test_forest_recall_and_blocks(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((3000, 24))
    v[1000:2000] = v[0] + 0.01 * rng.standard_normal((1000, 24))  # one crowd of near copies
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = hash_forest.search(frame, F.col("id") % 20 == 0, share=1.0, least=2000, block=300, query_block=40)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = nearest(rows, [r for r in rows if r[0] % 20 == 0], 20)
    recall = np.mean([len(got[q] & {i for i, _ in w}) / 20 for q, w in want.items()])
    assert set(got) == set(want) and recall >= 0.9


def test_language(spark):
    words_of = {"aa": "bakaradama", "bb": "lirinimiti"}
    rng = random.Random(1)
    rows = []
    for i in range(120):
        lang = rng.choice(("aa", "bb"))
        rows.append((i, " ".join("".join(rng.choices(words_of[lang], k=5)) for _ in range(20)), lang, 9.0))
    rows += [(200, None, "aa", 1.0), (201, "12 34 !?", None, 1.0), (202, "", None, 1.0), (None, "baraka", None, 1.0), (203, "b" * 3_000_000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = language_id.fit(docs, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    assert model.languages == ["aa", "bb"]
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == rows[i][2] for i in range(120))
    assert [got[i]["lang_pred"] for i in (200, 201, 202, None, 203)] == ["und", "und", "und", "aa", "aa"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[200]["score"] == 0
    none = language_id.fit(docs.where("lang = 'zz'"), F.lit(True))
    assert {r["lang_pred"] for r in language_id.predict(docs, none).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_language_scores_are_sums_over_ngrams():
    model = language_id.Model(["a", "b"], np.random.default_rng(0).random((language_id.BUCKETS, 2)).astype(np.float32), np.zeros(2))
    text = "Äb c9" * 50
    points, _ = language_id.folded([text])
    plain = np.zeros(2)
    for bucket in language_id.grams(points):
        plain += model.log_p[bucket].sum(axis=0, dtype=np.float64)
    want = np.exp(plain.max() - np.logaddexp(*plain))
    old, language_id.SLICE = language_id.SLICE, 64
    try:
        names, scores = model.predict([None, text, "", text])
    finally:
        language_id.SLICE = old
    assert names[1] == names[3] == ["a", "b"][int(plain.argmax())] and names[0] == names[2] == "und"
    assert abs(scores[1] - want) < 1e-6


def test_language_takes_little_memory_at_once():
    import tracemalloc

    rng = np.random.default_rng(0)
    model = language_id.Model(list("abcd"), rng.random((language_id.BUCKETS, 4)).astype(np.float32), np.zeros(4))
    texts = [invented(i, 250) for i in range(2000)]
    model.predict(texts[:1])
    tracemalloc.start()
    try:
        model.predict(texts)
        assert tracemalloc.get_traced_memory()[1] < 20 << 20
    finally:
        tracemalloc.stop()


SECRET_TEXTS = [
    None, "", "no secret here", 'password = "hunter22x"', "PassWord:abcdef api-key", "api_key=abc", "apikey = ABCDEF1", "token\": 'qwertyuiop'",
    "AKIA" + "A1" * 8, "AKIA" + "A" * 15, "x" + "0a" * 12 + "z", "0a" * 11 + "g", "é" * 9 + " secret=ñabc secret=abcdefg",
    'k = "s3cr3tv4lue"\nmy_password = k', 'client_secret := "abc" + "defgh" + \'ij\'', "password_file = /etc/x/passwordlist", 'pwd = "changeme"', "a" * 200_000 + "=",
    "ſecret=abcdefgh", "toKen=abcdefgh",
]


def test_tables_on_the_way_drop_their_shuffles(spark):
    from opsight.llm import common

    seen = spark.conf.get(common.DROP_SHUFFLES, None)
    counts = common.written(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert sum(r["count"] for r in counts.collect()) == sum(r["count"] for r in counts.collect()) == 100
    assert spark.conf.get(common.DROP_SHUFFLES, None) == seen


def test_secret_base_spans():
    import re

    kinds = {"assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), "access": ("AKIA[A-Z0-9]+", 20), "hex": ("[0-9a-f]+", 24)}
    for text in SECRET_TEXTS:
        want = set()
        for kind, (pattern, least) in kinds.items():
            for m in re.finditer(pattern, text or "", re.I | re.A if kind == "assign" else 0):
                if len(m[2] if kind == "assign" else m[0]) >= least:
                    want.add((kind, m.start(), m.end()))
        found = [s[:3] for s in secret_scan.scan(text)]
        assert {s for s in found if s[0] != "named"} == want
        assert found == sorted(found, key=lambda s: (s[1], secret_scan.KINDS.index(s[0]), s[2]))


def test_secret_names():
    def named(text):
        return [text[a:b] for a, b, _ in secret_scan.named_spans(text)]

    assert named('k = "s3cr3tv4lue"\nmy_password = k') == ["s3cr3tv4lue"]
    assert named('dbPassword: "p4ss w0rd!!"') == ["p4ss w0rd!!"]
    assert named('{"privateKey" => \'Zx81yy..qq\'}') == ["Zx81yy..qq"]
    assert named('client_secret := "abc" + "defgh"') == ['abc" + "defgh']
    assert named('user = "bob_the_builder"') == [] and named('pwd = "changeme"') == [] and named("token_count = 1234567") == []


@pytest.mark.parametrize(("text", "want"), [
    ('password = """hunter2\nhunter2"""', ["hunter2\nhunter2"]),
    ("<cfg:password>hunter2hunter</cfg:password>", ["hunter2hunter"]),
    ('<add key="password" value="hunter22x"/><entry name="pwd"> hunter33x </entry>', ["hunter22x", "hunter33x"]),
    ("db:\n  password: |\n    first99line\n\n    second\n  user: somebody\n", ["first99line\n\n    second"]),
    ('DB_PASS = "hunter2x9"\npassword = "${DB_PASS}"', ["hunter2x9"]),
    ("password=${HIDDEN:-x}\nHIDDEN=qwerty99", ["qwerty99"]),
    ('base = "hunter2"; password = base + "secretpart"', ["hunter2", "secretpart"]),
    ('password = base+"secretpart"\nbase = "hunter2"', ["secretpart", "hunter2"]),
    ('part = "abc"\nmy_token = part + "def9"', ["abc", "def9"]),
    ('client_secret = ("abc"\n   "defgh9")', ['abc"\n   "defgh9']),
    ('a = "zx81yy"\nb = a\nc = b\nmy_secret = c', ["zx81yy"]),
    ("my_secret = c\nc = b\nb = a\na = 'zx81yy'", ["zx81yy"]),
    ("doc = \'\'\'\npassword = \"inner99secret\"\n\'\'\'", ["inner99secret"]),
    ("a = b\nb = a\npassword = a", []), ("password = getpass_from_env", []), ("passwd=os.environ", []),
    ("token = request.token_value", []), ('password = get_it("abcdefgh")', []), ("the mountain pass: between hills", []),
    ("token = eyJhbGciOi1.eyJzdWIiO2.SflKxwRJ3", ["eyJhbGciOi1.eyJzdWIiO2.SflKxwRJ3"]),
])
def test_secrets_by_syntax(text, want):
    assert sorted(text[a:b] for a, b, _ in secret_scan.named_spans(text)) == sorted(want)


def test_secrets_behind_long_chains_of_constants():
    text = "".join(f"a{i + 1} = a{i}\n" for i in range(20_000)) + "password = a20000\na0 = 'zx81yy9'"
    assert [text[a:b] for a, b, _ in secret_scan.named_spans(text)] == ["zx81yy9"]
    for text in ("password = (" * 20_000, 'x = """' * 20_000, "k: |\n" * 20_000, "<" * 100_000):
        secret_scan.named_spans(text)


def test_secrets_in_long_literals_and_behind_wide_blanks():
    secret = "".join(random.Random(2).choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789", k=40))
    for before, after in ((0, 0), (0, 9000), (256, 0), (300, 0), (9000, 0), (9000, 9000), (251, 3)):
        value = "-" * before + secret + "-" * after
        for text in (f'auth_password = "{value}"', f"password{' ' * 500}={' ' * 500}'{value}'"):
            assert [text[a:b] for a, b, _ in secret_scan.named_spans(text)] == [value]
    assert secret_scan.named_spans('password = "' + "-" * 9000 + '"') == []
    text = 'secret = "abc"' + " " * 500 + "+" + "\t" * 500 + '"defgh"'
    assert [text[a:b] for a, b, _ in secret_scan.named_spans(text)] == [text[10:-1]]


def test_secrets_and_redaction(spark):
    rows = [(i, t, "old") for i, t in enumerate(SECRET_TEXTS)] + [(3, SECRET_TEXTS[3], "old"), (None, SECRET_TEXTS[3], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = secret_scan.find_secrets(docs).collect()
    assert sorted(([tuple(s) for s in r["spans"]] for r in got), key=str) == sorted(([tuple(s) for s in secret_scan.scan(t)] for _, t, _ in rows), key=str)
    clean = {(r["doc_id"], r["text"]) for r in secret_scan.redact(docs).collect()}
    assert (3, "[secret]\"") in clean and (0, None) in clean and (2, "no secret here") in clean
    assert all(not secret_scan.scan(t) for _, t in clean)
    assert secret_scan.find_secrets(docs.limit(0)).count() == 0


def test_bpe_is_that_of_the_tokenizer(spark):
    whole = Tokenizer.from_file(PATH)
    rng = random.Random(2)
    pool = "ab  \n\t\r\x0b\x1c\x85\xa0　é'sth123²Ⅷ漢字😀́!?-_\x00ßİ٣"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 50))) for _ in range(800)]
    texts += [None, "", "a<|endoftext|> b<|endoftext|>", "a" * 5000, "=-" * 400, " ".join(["the same"] * 500), invented(8, 5000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    coded = bpe.decode(bpe.encode(docs, PATH, chars_at_once=900), PATH)
    for r in coded.collect():
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == whole.encode(text, add_special_tokens=False).ids
        assert r["decoded"] == whole.decode(r["ids"], skip_special_tokens=False) == text
    once = bpe.encode(docs, PATH, keep=["doc_id"], decoded="back", chars_at_once=900)
    assert once.columns == ["doc_id", "ids", "back"]
    assert all(r["back"] == (texts[r["doc_id"]] or "") for r in once.collect())
    assert bpe.encode(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("rows", [
    [(1, "7")], [(1, None), (2, ""), (3, None)], [(i, "the same words") for i in range(20_000)], [(1, "one two"), (2, "one two"), (3, "")],
])
def test_bpe_where_a_slice_brings_no_new_word(spark, rows, monkeypatch):
    """Single characters, nothing but nulls, and later slices whose words are all known."""
    tokenizer = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    coded = bpe.encode(docs, PATH, decoded="decoded", chars_at_once=2000).collect()
    assert len(coded) == len(rows)
    for text, ids, decoded in {(r["text"], tuple(r["ids"]), r["decoded"]) for r in coded}:
        assert list(ids) == tokenizer.encode(text or "", add_special_tokens=False).ids and decoded == (text or "")


def test_bpe_decode_of_part_of_a_character(spark):
    whole = Tokenizer.from_file(PATH)
    ids = whole.encode("漢", add_special_tokens=False).ids
    df = spark.createDataFrame([(1, ids[:1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(df, PATH).collect()}
    assert got[2] == got[3] == "" and "�" in got[1]


def test_myers_is_edit_distance():
    rng = random.Random(4)
    for _ in range(150):
        item, text = ("".join(rng.choice("abc ") for _ in range(rng.randint(1, n))) for n in (70, 90))
        assert decontaminate.myers(decontaminate.bits(item), len(item), text) == reference.edit_distance_within(item, text)


def test_decontamination(spark):
    items = [(1, invented(1, 20)), (2, invented(2, 30)), (3, "too short"), (4, None), (4, invented(4, 12)), (5, invented(2, 30))]
    rng = random.Random(9)
    docs = [(0, None, "x"), (1, "", "x"), (2, items[0][1].upper().replace(" ", "\n "), "x"), (2, items[0][1], "x")]
    for i in range(60):
        text = items[rng.choice((0, 1, 4))][1]
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(("", "q", "zz")) + text[at + 1 :]
        docs.append((10 + i, invented(50 + i, 30) + " " + text + " " + invented(90 + i, 20), "x"))
    df = spark.createDataFrame(docs, "doc_id long, text string, hits string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for chars in (1 << 20, 100):
        got = {(r["doc_id"], r["text"]): sorted(tuple(h) for h in r["hits"]) for r in decontaminate.matches(df, bench, block_chars=chars).collect()}
        for d, t, _ in docs:
            want = []
            for k, item in items:
                item = decontaminate.normal(item or "")
                if len(item) >= decontaminate.LEAST_CHARS and t:
                    distance = reference.edit_distance_within(item, decontaminate.normal(t))
                    if distance <= decontaminate.budget(len(item)):
                        want.append((k, distance))
            assert got[d, t] == sorted(want)
    assert {len(r["hits"]) for r in decontaminate.matches(df, bench.limit(0)).collect()} == {0}
    assert decontaminate.matches(df.limit(0), bench).count() == 0


def test_automata_of_several_blocks_are_built_once(monkeypatch):
    """Blocks take turns batch by batch; each keeps its automaton, and a new broadcast never gets an old one."""
    built = []

    class Counted:
        def __init__(self, items, percent, least):
            built.append(items)

    class Held:
        def __init__(self, *value):
            self.value = value

    monkeypatch.setattr(decontaminate, "Matcher", Counted)
    monkeypatch.setattr(decontaminate, "_built", {})
    blocks = [Held(f"name{i}", [i], 10, 20) for i in range(3)]
    for _ in range(50):
        for held in blocks:
            decontaminate._matcher(held)
    assert built == [[0], [1], [2]]
    for i in range(3, 3 + decontaminate.KEPT_BLOCKS):
        decontaminate._matcher(Held(f"name{i}", [i], 10, 20))
    assert len(decontaminate._built) == decontaminate.KEPT_BLOCKS


def test_short_items_are_held_as_whole_words(spark):
    items = [(1, "2 + 2 = 4?"), (2, "Too  Short"), (3, "x"), (4, "東京"), (5, " \n"), (6, None), (7, "too short")]
    held = {"so 2 + 2 = 4? yes": [1], "2 + 2 = 4?": [1], "2 + 2 = 5?": [], "12 + 2 = 4?": [], "it is too\nshort.": [2, 7], "too shorty": [], "tattoo short": [],
            "tattoo short, too short": [2, 7], "x": [3], "ax xa": [], "(x)": [3], "私は東京に行く": [4], "東 京": [], "": [], None: []}
    docs = spark.createDataFrame(list(enumerate(held)), DOCS)
    got = decontaminate.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["text"]: [tuple(h) for h in r["hits"]] for r in got} == {t: [(k, 0) for k in own] for t, own in held.items()}


def test_warc_round_trip(spark, tmp_path):
    big = "".join(random.Random(1).choices("abc é\r\n\r\n", k=90_000))
    rows = [(1, "http://a/", big, 1), (2, "http://b/", big, 1), (3, None, None, 1), (4, "http://d\r\n/", "", 1), (5, "u", "x" * 999, 1), (6, "u", "x" * 999, 1),
            (7, "v", "y" * 1000, 1), (8, "v", "y" * 1000, 1), (9, "v", "y" * 1000, 1), (None, "n", "y" * 1000, 1), (10, "r", "WARC/1.1\r\n\r\n\r\n", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key int").repartition(3)
    warc.write(pages, str(tmp_path / "a"))
    back = warc.read(spark, str(tmp_path / "a"))
    got = {int(r["key"]) if r["key"] else None: r for r in back.collect()}
    assert len(got) == len(rows)
    last = {big: 2, "y" * 1000: 9}
    for page, url, html, _ in rows:
        r, body = got[page], (html or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha1(body).hexdigest())
        to = last.get(html) if page is not None else None
        assert (r["record_type"], r["refers_to"]) == (("revisit", str(to)) if to not in (None, page) else ("response", None))
        assert r["payload"] == (None if r["record_type"] == "revisit" else html or "")
        assert r["url"] == (url and url.replace("\r\n", ""))
    assert warc.dangling(back).count() == 0
    assert warc.read_parts(spark, str(tmp_path / "a")).where("segment > 1").count() >= 2
    warc.write(pages.limit(0), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_warc_faults():
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n"
    assert warc.payload_of(block) == b"abc"
    for bad in (b"HTTP/1.1 200 OK", block.replace(b"3\r\nabc", b"9\r\nabc")):
        with pytest.raises(ValueError):
            warc.payload_of(bad)
    head = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\n"
    assert [b for _, b in warc.parse(head + b"abc\r\n\r\n")] == [b"abc"]
    for bad in (head + b"ab", head + b"abcd\r\n\r\n", b"none\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse(bad))


RULES = [url_filter.Rule("org/", "allow"), url_filter.Rule("example.org/es/", "block"), url_filter.Rule("com/de/", "block")]


def test_urls(spark):
    urls = {"http://A.Example.org/es/x?q#f": ("a.example.org", "/es/x", "example.org/es/", "block"), "https://example.org/esx": ("example.org", "/esx", "org/", "allow"),
            "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"), "http://org": ("org", "", None, None), "http://forg/": ("forg", "/", None, None),
            None: ("", "", None, None), "": ("", "", None, None), "no scheme": ("", "", None, None), "a://b#c/d": ("b", "", None, None), "x://y?z://w/v": ("y", "", None, None),
            "http://x.com/de/" + "p" * 50_000: ("x.com", "/de/" + "p" * 50_000, "com/de/", "block")}
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate([*urls, *urls])], "page_id long, url string, verdict string")
    got = url_filter.filter_urls(pages, RULES).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        host, path, rule, verdict = urls[r["url"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert url_filter.filter_urls(pages.limit(0), RULES).count() == 0


def test_url_models_tell_unseen_urls_apart():
    rng = random.Random(3)
    good, bad = ([f"http://{''.join(rng.choices(s, k=8))}.net/{''.join(rng.choices(s, k=6))}" for _ in range(300)] for s in ("abcde", "vwxyz"))
    model = url_filter.Model(url_filter.Markov(good[:200]), url_filter.Markov(bad[:200]))
    model.threshold = url_filter.calibrated(model.scores(good[200:250]), model.scores(bad[200:250]))
    assert (model.scores(good[250:]) >= model.threshold).all() and (model.scores(bad[250:]) < model.threshold).all()
    # the interpolated probabilities of all characters after one context sum to one
    chars, keys, _ = url_filter._contexts([good[0][:9]])
    last = [np.repeat(k[-1:], 256) for k in keys]
    assert abs(np.exp(model.accepted.log_p(np.arange(256, dtype=np.uint64), last)).sum() - 1) < 1e-9


def test_url_sample_is_that_of_distinct_urls(spark):
    few = [(f"http://a{i}.net/{v}", v) for i in range(60) for v in ("allow", "block")]
    once = spark.createDataFrame(few, "url string, verdict string")
    often = once.crossJoin(spark.range(50)).drop("id")
    for most in (100, 20):
        a, b = (url_filter.fit(rows, max_urls=most) for rows in (once, often))
        assert (a.threshold, a.scores(["http://a7.net/x"]).tolist()) == (b.threshold, b.scores(["http://a7.net/x"]).tolist())
        for side in ("accepted", "rejected"):
            assert getattr(a, side).context_n.tolist() == getattr(b, side).context_n.tolist() != []


def test_url_models_count_every_url(spark):
    rng = random.Random(4)
    texts = {v: sorted({f"http://{''.join(rng.choices(s, k=5))}.net/{i}" for i in range(25_000)}) for v, s in (("allow", "abcdevw"), ("block", "vwxyzab"))}
    rows = spark.createDataFrame([(u, v) for v, urls in texts.items() for u in urls], "url string, verdict string")
    got = url_filter.fit(rows)
    want = url_filter.Model(*[url_filter.Markov([u for i, u in enumerate(texts[v]) if i % 4]) for v in ("allow", "block")])
    for side in ("accepted", "rejected"):
        for name in ("context", "context_n", "pair", "pair_n"):
            assert getattr(getattr(got, side), name).tolist() == getattr(getattr(want, side), name).tolist()
    assert got.threshold == url_filter.calibrated(*[want.scores(texts[v][::4]) for v in ("allow", "block")])
    # a model of bounded size counts them as well
    shared = url_filter.fit(rows, max_pairs=100)
    assert shared.accepted.classes and shared.accepted.pair_n.sum() == want.accepted.pair_n.sum()
    assert len(shared.accepted.pair) <= url_filter.CLASSES
    some = texts["allow"][:50] + texts["block"][:50]
    assert np.corrcoef(shared.scores(some), want.scores(some))[0, 1] > 0.99


def test_large_url_models_keep_every_count(spark):
    """Models too large to be held give the scores and verdicts of the whole counts, not of shared ones."""
    rng = random.Random(5)
    hosts = ["example.org/en", "example.org/es", "x.com/de", "y.net", "z.com"]
    urls = [f"http://{rng.choice(hosts)}/{''.join(rng.choices('abcdefgé', k=rng.randint(0, 9)))}" for _ in range(3000)]
    urls += [*urls[:50], None, "", "\n", "http://x.com/de/" + "p" * 3000]
    pages = spark.createDataFrame([(i, u, 0.0) for i, u in enumerate(urls)], "page_id long, url string, _h1 double")
    held, joined = (url_filter.filter_urls(pages, RULES, max_pairs=m).toPandas().sort_values("page_id") for m in (10**9, 100))
    assert list(held.columns) == list(joined.columns) and len(joined) == len(urls)
    for name in ("page_id", "url", "_h1", "host", "path", "rule", "verdict"):
        assert held[name].fillna("").tolist() == joined[name].fillna("").tolist()
    assert np.allclose(held["score"], joined["score"], rtol=1e-9, atol=1e-12)


LICENSES = [None, "", "...", "Under the MIT  License! under-the.mit/license", "mit license", "Apache License, Version 2.0 and CC BY-NC 4 (cc-by-nc)", "Kit under the mİt license",
            "über Under The Mit License é", "cc by nc cc by nc", license_scan.TEMPLATES["bsd"].upper(), "x\n\n" + license_scan.TEMPLATES["mpl-2"].replace(" ", "\n") + "\n\ny",
            license_scan.TEMPLATES["gpl"].rsplit(" ", 12)[0], "word " * 40_000 + "under the mit license"]


def template_labels(text):
    """Labels and largest share by comparing every block with every template."""
    import re

    out = {}
    low = (text or "").translate(reference.LOWER)
    for blocks, wrapped in ((re.split(r"\r?\n", low), False), (re.split(r"\r?\n[ \t]*\r?\n", low), True)):
        for block in blocks:
            held = set(reference.WORD.findall(block))
            for label, t in license_scan.TEMPLATES.items():
                own = set(license_scan.template_words(t))
                share = len(held & own) / len(own)
                if share >= license_scan.THRESHOLD and not (wrapped and len(held) > license_scan.MOST_TIMES * len(own)):
                    out[label] = max(share, out.get(label, 0))
    return out


def test_licenses(spark):
    rng = random.Random(6)
    texts = list(LICENSES)
    for t in license_scan.TEMPLATES.values():
        for drop in (0.1, 0.2, 0.3):
            texts.append("\n".join((invented(1, 9), " ".join(w for w in t.split() if rng.random() > drop))))
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1)], "doc_id long, text string, labels int")
    got = license_scan.scan(docs).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        text = texts[r["doc_id"]]
        n, places, first, last, base = reference.phrase_places(text, license_scan.PHRASES)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, places, first, last, base)
        found = template_labels(text)
        assert r["labels"] == sorted({*base, *found})
        assert abs(r["score"] - (1.0 if base else max(found.values(), default=0.0))) < 1e-12
    assert license_scan.scan(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan(docs, phrases={"a b a": "x"})


def test_wrapped_licenses_in_long_paragraphs(spark):
    texts = {}
    for label, t in license_scan.TEMPLATES.items():
        wrapped = t.replace(" ", "\n")
        for before, after in ((300, 300), (0, 9000), (9000, 0)):
            texts[len(texts)] = (label, "\n".join((invented(len(texts), before, 10**6), wrapped, invented(-len(texts), after, 10**6))))
    got = license_scan.scan(spark.createDataFrame([(i, t) for i, (_, t) in texts.items()], DOCS)).collect()
    assert len(got) == len(texts)
    for r in got:
        label, text = texts[r["doc_id"]]
        assert label in r["labels"] and r["labels"] == sorted(template_labels(text)) and r["score"] == 1.0


NOTICES = {
    "This work is licensed under the GNU General Public License, version 3.": ["gpl-family"],
    "Released under the GNU Lesser General Public License v2.1 or later": ["gpl-family", "lgpl-notice"],
    "GNU AFFERO GENERAL PUBLIC LICENSE Version 3": ["agpl-notice", "gpl-family"],
    "Licensed under the GPL v2 or later.": ["gpl-short"],
    "Licensed under the LGPL.": ["lgpl-short"],
    "licensed under the AGPL-3.0": ["agpl-short"],
    "Mozilla Public License Version 2.0": ["mpl-notice"],
    "Licensed under the MPL 2.0": ["mpl-short"],
    "Distributed under the BSD license": ["bsd-notice"],
    "Released under the BSD 3-Clause License": ["bsd-3-notice", "bsd-notice"],
    "BSD 2-Clause \"Simplified\" License": ["bsd-2-notice"],
    "Licensed under CC BY 4.0.": ["cc-short"],
    "Creative Commons Attribution-ShareAlike 4.0 International": ["cc-by-sa-notice"],
    "a Creative Commons Attribution-NonCommercial License": ["cc-by-nc-notice", "cc-family"],
    "Creative Commons Attribution-NoDerivatives 3.0": ["cc-by-nd-notice"],
    "Licensed under CC BY-NC 4.0.": ["cc-by-nc", "cc-short"],
    "Released under the MIT License.": ["mit"],
    "Licensed under the Apache License, Version 2.0.": ["apache-2"],
    "This program is free software under a general public license": [],
    "The license of this work is public": [],
}


def test_license_notices(spark):
    texts = list(NOTICES)
    got = license_scan.scan(spark.createDataFrame(list(enumerate(f"some words\n{t}\nmore words" for t in texts)), DOCS)).collect()
    assert {texts[r["doc_id"]]: r["labels"] for r in got} == NOTICES
    assert all(r["score"] == (1.0 if r["labels"] else 0.0) for r in got)


def test_near_copies_meet_once_whatever_signatures_they_share(spark, frame):
    words = [f"w{i}" for i in range(400)]
    near = [*words[:200], "other", *words[200:]]
    docs = frame("doc_id long, text string", (1, " ".join(words)), (2, " ".join(near)))
    texts = partenum._texts(docs.repartition(2, "doc_id"), "doc_id", "text")
    met = partenum._meetings(texts, partenum.Rule(), 1).where("kind = 'member'")
    assert {r["n"] for r in met.groupBy("sig").agg(F.count("*").alias("n")).collect()} == {2}
    assert met.select("sig").distinct().count() == met.select("band").distinct().count()
    linked = partenum.join(docs).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, linked)) == [(1, 1), (2, 1)]


def test_pairs_that_share_many_signatures_are_told_once(spark, monkeypatch):
    base = invented(5, 120)
    rows = [(i, edited(base, i, 1 + i % 2)) for i in range(1, 61)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    rule, close, made = partenum.Rule(4, 85, 100), partenum._close, {}

    def counted(members, rule, every):
        out = close(members, rule, every).cache()
        made[every] = out.count(), out.distinct().count()
        return out

    monkeypatch.setattr(partenum, "_close", counted)
    got = {r[0]: (r["n_shingles"], r["component_id"]) for r in partenum.join(docs, rule).collect()}
    assert got == reference.similar_components(rows)
    assert 0 < made[False][0] <= 8 * len(rows), made
    assert made[True][0] <= 1.5 * made[True][1], made


def test_ngram_join_of_keys_with_texts_of_several_sizes(spark):
    short, long = invented(21, 30), invented(22, 600)
    rows = [(1, short), (1, long), (2, edited(short, 1, 1)), (2, edited(long, 1, 2)), (3, edited(long, 2, 2)), (4, edited(short, 3, 1)), (5, invented(23, 30))]
    found = partenum.join(spark.createDataFrame(rows, DOCS).repartition(3), partenum.Rule(2, 60, 100)).distinct()
    assert sorted({(r["doc_id"], r["component_id"]) for r in found.collect()}) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)]


def test_groups_of_the_join_hand_on_small_pieces(monkeypatch):
    monkeypatch.setattr(partenum, "PIECE_ROWS", 7)
    pieces = list(partenum._told("member", np.arange(20), sig=np.arange(20) * 3))
    assert [len(p) for p in pieces] == [7, 7, 6] and all([*p.columns] == partenum.MET for p in pieces)
    assert [tuple(r) for p in pieces for r in p.itertuples(index=False)] == [("member", i, 0, 3 * i, 0, 0) for i in range(20)]
    assert not list(partenum._told("same", np.arange(0), other=np.arange(0)))
