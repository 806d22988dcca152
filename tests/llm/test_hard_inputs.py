"""Inputs made to break hashes, draws and buffers."""

import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotwright.llm import ann, bpe, langid, minhash, queries, sadedup, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def thue_morse(n, a="a", b="b"):
    """Words that every polynomial modulo a power of two takes for their complements."""
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


PAIR = thue_morse(1024), thue_morse(1024, "b", "a")


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.tiktoken")


def test_the_pair_collides_under_sums_of_powers():
    up, _ = bpe.powers(1024)
    sums = [int((bpe.BYTE_VALUES[np.frombuffer(t.encode(), np.uint8)] * up).sum(dtype=np.uint64)) for t in PAIR]
    assert sums[0] == sums[1]


def test_bpe_tells_colliding_slices_apart(spark, vocabulary, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    library = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=bpe.vocabulary(vocabulary), special_tokens={})
    rows = [(1, PAIR[0]), (2, PAIR[1]), (3, f"{PAIR[1]} {PAIR[0]} ab {PAIR[0]}"), (4, PAIR[1])]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op4_bpe(spark, str(tmp_path)).collect():
        text = dict(rows)[r.doc_id]
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_op4_query_matches_the_library_on_whole_documents(spark, vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    d = "/root/testdata/sf0.001"
    library = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=bpe.vocabulary(vocabulary), special_tokens={})
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = queries.op4_bpe(spark, d).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_minhash_tells_colliding_words_apart(spark):
    df = spark.createDataFrame([(1, PAIR[0], "en", "s", 0), (2, PAIR[1], "en", "s", 0), (3, PAIR[0], "en", "s", 0)], DOCS)
    assert {r.doc_id: (r.class_id, r.n_copies) for r in minhash.classes(df).collect()} == {1: (1, 2), 2: (2, 1), 3: (1, 2)}


def test_suffix_dedup_tells_colliding_strings_apart(spark):
    rest = thue_morse(2048), thue_morse(2048, "b", "a")
    texts = [*PAIR, *rest, "q" * 10 + PAIR[0][:350], "q" * 10 + PAIR[1][:350]]
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.n_removed for r in sadedup.removed(df.select("doc_id", "text")).collect()}
    data, least = [t.encode() for t in texts], 400
    seen: dict[bytes, int] = {}
    for x in data:
        for a in range(len(x) - least + 1):
            seen[x[a : a + least]] = seen.get(x[a : a + least], 0) + 1
    for k, x in enumerate(data):
        cover = np.zeros(len(x), bool)
        for a in range(len(x) - least + 1):
            if seen[x[a : a + least]] > 1:
                cover[a : a + least] = True
        assert got[k] == int(cover.sum()), k


def test_strings_of_one_sum_have_two_digests():
    for n in (1024, 2048, 4096):
        a, b = (np.frombuffer(thue_morse(n, *p).encode(), np.uint8) for p in ("ab", "ba"))
        assert sadedup.Digests(a).of(np.array([0]), np.array([n])) != sadedup.Digests(b).of(np.array([0]), np.array([n]))
    data = np.frombuffer(b"some text, some text" * 3, np.uint8)
    one = sadedup.Digests(data).of(np.array([0, 11, 20, 5]), np.array([9, 20, 29, 9]))
    assert one[0] == one[1] == one[2] != one[3]
    other = np.frombuffer(b"quite another beginning; some text", np.uint8)
    assert sadedup.Digests(other).of(np.array([25]), np.array([34]))[0] == one[0]


PROSE = {"en": "the cat and the dog went over the hill with a song", "de": "der hund und die katze gingen über den berg mit einem lied"}


def language_rows(n, ids):
    rng = np.random.default_rng(3)
    return [(ids(k), " ".join(rng.permutation(PROSE[lang].split())) + f" {k}", lang, "s", 0) for k in range(n) for lang in PROSE]


@pytest.mark.parametrize("ids", [lambda k: None, lambda k: 7, lambda k: k % 2], ids=["null", "one id", "two ids"])
def test_language_model_learns_whatever_the_ids(spark, ids):
    docs = spark.createDataFrame(language_rows(1500, ids), DOCS)
    model = langid.fit(docs)
    assert model is not None and set(model.languages) == set(PROSE)
    got = langid.predict(docs, model)
    assert got.where("lang = lang_pred").count() >= 0.99 * 3000


def test_language_sample_is_bounded_and_copies_count_once(spark, monkeypatch):
    rows = language_rows(200, lambda k: None) + [(None, PROSE["en"], "en", "s", 0)] * 3000
    seen = []
    monkeypatch.setattr(langid, "train", lambda rows, idf, params: seen.extend(rows))
    langid.fit(spark.createDataFrame(rows, DOCS), langid.Params(sample_per_language=50))
    assert len(seen) == 100 and len({(r[0], r[1]) for r in seen}) == 100


def test_op10_query_on_null_ids(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("doc_id", F.lit(None).cast("long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op10_language_id(spark, str(tmp_path)).groupBy("lang_pred").count().collect()
    assert sum(r["count"] for r in got) == 1000 and len([r for r in got if r["count"] > 50]) >= 3


def test_language_prediction_matches_its_weights(spark):
    """One prediction recomputed from the model's parts, n-gram by n-gram."""
    docs = spark.createDataFrame(language_rows(100, lambda k: k), DOCS)
    model = langid.fit(docs)
    p = model.params
    for text in (PROSE["en"], "Katze, dog!", "ü"):
        points = [ord(c) if c.isalpha() else 0 for c in text.lower()]
        points = [0, *[c for k, c in enumerate(points) if c or (k and points[k - 1])], 0]
        counts: dict[int, int] = {}
        for n in range(1, p.longest + 1):
            for a in range(len(points) - n + 1):
                code = 0
                for c in points[a : a + n]:
                    code = (code * 0x100000001B3 + c) % 2**64
                g = ((code + n) * 0x9E3779B97F4A7C15 % 2**64 >> 40) % p.features
                counts[g] = counts.get(g, 0) + 1
        x = {g: (1 + np.log(c)) * model.idf[g] for g, c in counts.items()}
        length = np.sqrt(sum(v * v for v in x.values()))
        z = np.array([sum(v / length * model.weights[g, j] for g, v in x.items()) + model.bias[j] for j in range(len(model.languages))]) / model.temperature
        e = np.exp(z - z.max())
        want = model.languages[int(np.argmax(e))], float(e.max() / e.sum())
        got = langid.predict_text(model, text)
        assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-5


def test_ann_with_repeated_query_ids(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(9300, 6))
    ids = [50 * (k % 3) for k in range(9000)] + list(range(1001, 1301))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = ann.neighbours(df, F.col("vec_id") % 50 == 0, 5, rows_per_leaf=200).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {q: len(v) for q, v in by.items()} == {0: 5, 50: 5, 100: 5, **{q: 5 for q in range(1050, 1301, 50)}}
    u, hits = x / np.linalg.norm(x, axis=1)[:, None], 0
    for q, found in by.items():
        own = [k for k, i in enumerate(ids) if i == q]
        asker = min(own, key=lambda k: tuple(x[k]))
        best = np.sort([s for s, i in zip(u @ u[asker], ids, strict=True) if i != q])[::-1][:5]
        hits += sum(abs(s - b) < 1e-9 for (_, _, s), b in zip(sorted(found), best, strict=True))
    assert hits >= 0.9 * 5 * len(by)


def test_ann_where_all_rows_are_one(spark):
    df = spark.createDataFrame([(k // 40, [1.0, 2.0]) for k in range(6000)], "vec_id long, embedding array<double>")
    got = ann.neighbours(df, F.col("vec_id") % 50 == 0, 5).collect()
    assert len(got) == 3 * 5 and all(abs(r.score - 1) < 1e-12 and r.vec_id != r.query_id for r in got)


def test_warc_of_many_small_pages_takes_time_in_proportion(spark, tmp_path):
    df = spark.range(60_000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.col("id").cast("string").alias("html")).coalesce(1)
    began = time.monotonic()
    warc.write(df, f"{tmp_path}/w")
    assert time.monotonic() - began < 30
    assert warc.scan(spark, f"{tmp_path}/w").count() == 60_000
