"""Language identification: kernels against sets of grams, regression against its closed form, held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from tidemark.llm import language as L, queries

STEMS = {"aa": "kel mor tan vish ulo pra den sok", "bb": "fyr ingen skol var hjem lys tid nat", "cc": "の 日本 東京 山 川 水 火 木"}


def text_of(lang, rng, n=40):
    return " ".join("".join(rng.choices(STEMS[lang].split(), k=2)) for _ in range(n))


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    return [(k, text_of(lang := rng.choice(sorted(STEMS)), rng), lang) for k in range(n)]


def grams(text):
    t = text.lower()
    return {t[i : i + n] for n in range(1, L.LONGEST + 1) for i in range(len(t) - n + 1)}


def test_kernels_are_shared_grams():
    rng = random.Random(2)
    texts = [text_of(lang, rng) for lang in STEMS] + ["", "a", "Ünï", "x" * 5000]
    marks = L.Landmarks.of(texts[:3])
    wanted = [[len(grams(a) & grams(b)) / np.sqrt(max(1, len(grams(a))) * len(grams(b))) for b in texts[:3]] for a in texts]
    assert np.allclose(marks.kernels(texts), wanted)
    kernel = np.array(wanted[:3])
    assert np.allclose((kernel @ marks.root) @ (kernel @ marks.root).T, kernel)  # the space reproduces the landmarks' kernel


def test_pieces_of_long_texts_change_nothing(monkeypatch):
    text = "".join(random.Random(3).choices("abcdefgh ß日", k=5000))
    whole = L.distinct_codes(text)
    monkeypatch.setattr(L, "_PIECE", 97)
    assert np.array_equal(L.distinct_codes(text), whole) and len(whole) == len(grams(text))


def test_regression_equals_its_closed_form(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    model = L.train(docs, landmarks=12)
    rows = sorted(L.drawn(docs).collect(), key=lambda r: (r.lang, r.nth))
    assert len(rows) == sum(zlib.crc32(str(k).encode()) % 4 != 2 for k, _, _ in corpus())
    marks = L.Landmarks.of([r.text[max(0, (len(r.text) - L.PASSAGE) // 2) :][: L.PASSAGE] for r in rows if r.nth <= 4])
    x, y = marks.kernels([r.text for r in rows]) @ marks.root, np.array([[r.lang == v for v in model.languages] for r in rows], float)
    xc, yc = x - x.mean(axis=0), y - y.mean(axis=0)
    w = np.linalg.solve(xc.T @ xc + L.RIDGE * len(x) * np.eye(x.shape[1]), xc.T @ yc)
    new = [text_of(v, random.Random(9)) for v in STEMS] + ["!", "zzz"]
    assert np.allclose(model.scores(new), np.clip((marks.kernels(new) @ marks.root - x.mean(axis=0)) @ w + y.mean(axis=0), 0, 1), atol=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(corpus(600), "doc_id long, text string, lang string")
    counts = L.accuracy(docs, L.identify(docs)).collect()
    assert {r.lang for r in counts} == set(STEMS) and sum(r.n for r in counts) > 100
    assert sum(r.right for r in counts) == sum(r.n for r in counts)


def test_predictions_read_the_text_alone(spark):
    """Held-out rows with false languages, sources and ids are predicted alike."""
    rows = corpus(200)
    lied = [(k, t, "aa" if zlib.crc32(str(k).encode()) % 4 == 2 else v) for k, t, v in rows]
    got = [{r.doc_id: (r.lang_pred, r.score) for r in L.identify(spark.createDataFrame(x, "doc_id long, text string, lang string")).collect()} for x in (rows, lied)]
    assert got[0].keys() == got[1].keys()
    for k, (lang, score) in got[0].items():
        assert got[1][k][0] == lang and got[1][k][1] == pytest.approx(score, abs=1e-6)


def test_query_on_odd_documents(spark, tmp_path):
    rng = random.Random(4)
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "12 -- !", "aa"), (None, text_of("bb", rng), "bb"), (903, text_of("cc", rng, 20_000), None), (3, text_of("aa", rng), None), (904, "½²³", "cc"), (905, "x", None)]
    rows = corpus(200) + odd
    spark.createDataFrame([(*r, "s", 1.0) for r in rows], "doc_id long, text string, lang string, source string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    for r in got:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    by_id = {r.doc_id: r.lang_pred for r in got}
    assert [by_id[k] for k in (900, 901, 902, 904, None, 903)] == ["und"] * 4 + ["bb", "cc"] and by_id[905] in STEMS


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.identify(empty).collect() == []
    unlabelled = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in L.identify(unlabelled).collect()] == [(1, False, "und", 0.0)]


def test_the_sample_is_bounded(spark):
    rows = L.drawn(spark.createDataFrame(corpus(3000), "doc_id long, text string, lang string"), sample=300).groupBy("lang").count().collect()
    assert {r["count"] for r in rows} == {100}
