"""Embeddings against brute force, the classifier on held-out labels, and the pipeline."""

import math
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import cotrain, embed_dedup, minhash, packing
from tidemark.llm.quality_rules import passing
from tidemark.llm.workspace import Workspace

VECTORS = "vec_id long, embedding array<float>, n int"


def brute_force(vectors, similarity):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= similarity
    np.fill_diagonal(linked, False)
    component = np.array(ids)
    while True:
        least = np.minimum(component, np.where(linked, component[None], 1 << 60).min(axis=1))
        if (least == component).all():
            return {i: (int(n), int(c)) for i, n, c in zip(ids, linked.sum(axis=1), component, strict=True)}
        component = least


def planted(dim=32, groups=40, seed=0):
    rng = np.random.default_rng(seed)
    rows = {}
    for g in range(groups):
        base = rng.normal(size=dim)
        for k in range(rng.integers(1, 12)):
            noise = rng.normal(size=dim)
            noise *= np.linalg.norm(base) / np.linalg.norm(noise) * rng.uniform(0, 0.45)
            rows[len(rows)] = (base + noise if k else base).astype(np.float32)
    for k in range(300):
        rows[len(rows)] = rng.normal(size=dim).astype(np.float32)
    for k in range(60):
        rows[len(rows)] = rows[3]
    return rows


@pytest.mark.parametrize(("cell", "block"), [(1024, 8192), (20, 8192), (20, 16)])
def test_links_and_recall(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embed_dedup, "CELL", cell)
    monkeypatch.setattr(embed_dedup, "_LEFT", block // 8)
    monkeypatch.setattr(embed_dedup, "_RIGHT", block)
    rows = planted()
    wanted = brute_force(rows, 0.9)
    got = {r["vec_id"]: r for r in embed_dedup.near_vectors(spark.createDataFrame([(k, v.tolist(), 1) for k, v in rows.items()], VECTORS)).collect()}
    total, found = sum(n for n, _ in wanted.values()), sum(r["n_links"] for r in got.values())
    assert found <= total and found >= (0.98 if cell == 20 else 1) * total
    assert all(r["n_links"] <= wanted[k][0] for k, r in got.items())
    if cell == 1024:
        assert {k: r["component_id"] for k, r in got.items()} == {k: c for k, (_, c) in wanted.items()}
    assert all(r["kept"] == (r["component_id"] == k) for k, r in got.items())


def test_no_link_is_lost_where_vectors_have_few_dimensions(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "CELL", 20)
    rng = np.random.default_rng(5)
    few = rng.normal(size=(700, 4)) * [2, 1, 1, 0.5]
    near = few[:300] + rng.normal(size=(300, 4)) * 0.3
    rows = dict(enumerate((np.vstack([few, near]) @ rng.normal(size=(4, 64)) * 0.1).astype(np.float32)))
    wanted = brute_force(rows, 0.9)
    got = embed_dedup.near_vectors(spark.createDataFrame([(k, v.tolist(), 1) for k, v in rows.items()], VECTORS)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == wanted


@pytest.mark.parametrize("kind", ["isotropic", "few", "clustered"])
def test_every_link_is_found_in_many_cells(spark, kind):
    rng = np.random.default_rng(7)
    if kind == "isotropic":
        base = rng.normal(size=(500, 48))
        noise = rng.normal(size=(300, 48))
    elif kind == "few":  # eight dimensions of 48; near copies differ in the first alone
        plane = rng.normal(size=(8, 48))
        base, noise = rng.normal(size=(500, 8)) @ plane, rng.normal(size=(300, 1)) @ plane[:1]
    else:
        base = rng.normal(size=(25, 48))[rng.integers(0, 25, 500)] + 0.3 * rng.normal(size=(500, 48))
        noise = rng.normal(size=(300, 48))
    noise *= (rng.uniform(0, 0.5, 300) * np.linalg.norm(base[:300], axis=1) / np.linalg.norm(noise, axis=1))[:, None]
    rows = dict(enumerate(np.vstack([base, base[:300] + noise]).astype(np.float32)))
    wanted = brute_force(rows, 0.9)
    assert sum(n for n, _ in wanted.values()) >= 400
    got = embed_dedup.near_vectors(spark.createDataFrame([(k, v.tolist(), 1) for k, v in rows.items()], VECTORS), cell=25).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == wanted


def test_each_length_of_vector_links_with_its_own(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(size=3 + k % 3)], 1) for k in range(60)]
    rows += [(100 + k, v, 1) for k, v, _ in rows[:7]]
    got = {r["vec_id"]: r for r in embed_dedup.near_vectors(spark.createDataFrame(rows, VECTORS), cell=4).collect()}
    for size in (3, 4, 5):
        wanted = brute_force({k: np.array(v, np.float32) for k, v, _ in rows if len(v) == size}, 0.9)
        assert {k: (got[k]["n_links"], got[k]["component_id"]) for k in wanted} == wanted


def test_odd_vectors_link_with_nothing(spark):
    nan, inf = math.nan, math.inf
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [1e-30, 1e-31])]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_vectors(spark.createDataFrame([(*r, 1) for r in rows], VECTORS)).collect()), key=str)
    linked = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (10, 3, 1, False)]
    assert got == sorted([*linked, *((k, 0, k, True) for k in range(3, 10)), (None, 0, None, True)], key=str)
    assert embed_dedup.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    assert embed_dedup.near_vectors(spark.createDataFrame([(1, None, 1)], VECTORS)).collect()[0]["kept"]


def corpus(seed=0, n=500):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("aeioustrnl"), rng.integers(2, 9))) for _ in range(800)]
    rows, labels = [], []
    for k in range(n):
        words = [str(w) for w in rng.choice(vocabulary, rng.integers(60, 200))]
        junk = k % 5 == 0
        if junk:
            words = [f"{w.upper()}!!" for w in words] if k % 2 else [x for w in words for x in (w, "|")]
        text = " ".join(words).capitalize() + "." if not junk else " ".join(words)
        rows.append((k, text, "en", f"s{rng.integers(4)}", len(text)))
        if k % 3:
            labels.append((k, int(not junk)))
    return rows, labels


DOCS, LABELS = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int"


def test_classifier_on_held_out_labels(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows, (None, None, None, None, None), (9999, "", "xx", "new", -1), rows[1]], DOCS).repartition(3)
    got = cotrain.quality_scores(docs, spark.createDataFrame([*labels, (1, None), (2, 7), (None, 1)], LABELS)).collect()
    assert len(got) == len(rows) + 3 and all(r["score"] is not None and 0 <= r["score"] <= 1 for r in got)
    unseen = {r["doc_id"]: r["kept"] for r in got if r["doc_id"] is not None and r["doc_id"] < 500 and r["doc_id"] % 3 == 0}
    assert sum(kept == (k % 5 != 0) for k, kept in unseen.items()) >= 0.98 * len(unseen)
    assert all(kept for k, kept in unseen.items() if k % 5)


def test_an_informative_view_teaches_and_a_blind_one_does_not():
    rng = np.random.default_rng(1)
    y, pool_y = rng.integers(0, 2, 400), rng.integers(0, 2, 400)
    sharp = lambda v: np.column_stack([v * 4 + rng.normal(size=len(v)), rng.normal(size=len(v))])
    blind = lambda v: rng.normal(size=(len(v), 3))
    model = cotrain.co_train([sharp(y), blind(y)], y, [sharp(pool_y), blind(pool_y)])
    test = rng.integers(0, 2, 1000)
    p, q, both = model.scores(sharp(test), blind(test))
    assert ((both > 0.5) == test).mean() > 0.95 and ((p > 0.5) == test).mean() > 0.95
    assert np.abs(q - 0.5).max() < 0.48


def test_all_unlabelled_documents_teach():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 400)
    text, meta = np.column_stack([y * 8 + rng.normal(size=400)] * 2), rng.normal(size=(400, 2))
    pool_y = rng.integers(0, 2, 30_000)
    pool = [np.column_stack([pool_y * 8 + rng.normal(size=30_000)] * 2), rng.normal(size=(30_000, 2))]
    rare = np.arange(30_000) >= 29_990  # the last ten alone have this mark
    pool[1] = np.column_stack([pool[1], rare])
    pool_y[rare], pool[0][rare] = 0, 0.0
    model = cotrain.co_train([text, np.column_stack([meta, np.zeros(400)])], y, pool)
    assert model.meta.model.weights[2] < 0


def test_the_sums_of_tasks_are_those_of_all_documents(spark):
    rows, _ = corpus(n=60)
    docs = spark.createDataFrame([*rows, (None, None, None, None, None)], DOCS).repartition(3)
    packed = docs.select(cotrain._measure()("text", "lang", "source", "n_chars", F.lit(None).cast("int")).alias("x"))
    wanted = [np.array([f(r) for r in docs.collect()], float) for f in (lambda r: cotrain.text_view(r["text"]), lambda r: cotrain.meta_view(r["lang"], r["source"], r["n_chars"]))]
    both = lambda text, meta: np.concatenate([[len(text)], text.sum(axis=0), meta.sum(axis=0)])
    assert np.allclose(cotrain._summed(packed)(both), both(*wanted))


def test_without_labels_every_document_is_kept(spark):
    rows, _ = corpus(n=20)
    docs = spark.createDataFrame(rows, DOCS)
    for labels in ([], [(k, 1) for k in range(20)]):
        got = cotrain.quality_scores(docs, spark.createDataFrame(labels, LABELS)).collect()
        assert len(got) == 20 and all(r["kept"] and r["score"] is None for r in got)
    assert cotrain.quality_scores(docs.limit(0), spark.createDataFrame([], LABELS)).count() == 0


@pytest.fixture
def sf_dir(spark, tmp_path):
    rows, labels = corpus(3, 300)
    copies = [(1000 + k, rows[k + 1][1] + " end", *rows[k + 1][2:]) for k in range(0, 40, 4)]
    extra = [(2000, None, None, None, None), (2001, "short", "en", "s1", 5), (2002, rows[2][1], "en", "s9", 1)]
    spark.createDataFrame([*rows, *copies, *extra], DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_pipeline_equals_its_stages(spark, sf_dir, encode):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    ids = {r["doc_id"] for r in docs.collect()}
    junk = {k for k in range(300) if k % 5 == 0} | {1000 + k for k in range(0, 40, 4) if k % 5 == 4}
    accepted = corpus_pipeline.quality_classifier(spark, docs, sf_dir)
    assert accepted.columns == docs.columns and {r["doc_id"] for r in accepted.collect()} & junk == set()
    passed = passing(accepted)
    clean = ids - junk - {2000, 2001}
    assert {r["doc_id"] for r in passed.collect()} == clean
    copies = {1000 + k for k in range(0, 40, 4)} | {2002}
    single = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, passed, sf_dir).collect()}
    assert single == clean - copies
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert Counter((r["doc_id"], r["length"]) for r in pieces) == Counter((k, len(encode(texts[k])) + 1) for k in single)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_dedup", "mixture", "packing"]


def test_a_group_ends_with_one_row(spark):
    one, two = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
    rows = [(7, one), (7, one), (None, one), (None, one), (9, one), (None, two), (None, two), (5, two + " end"), (8, None), (8, None)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(7, one), (5, two + " end"), (8, None), (8, None)], key=str)


def test_stages_take_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_stages_keep_clashing_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({"kept": F.lit(1), "slot": F.lit(2), "component_id": F.lit(3), "failures": F.lit(4)})
    helpers = ["_m", "_text", "_split", "_ledger", "m", "split", "row", "ledger", "quality_score", "judged", "mix", "mix_key", "mix_j", "mix_base", "mix_slot", "key", "salt", "_dedup_row", "file", "at"]
    docs = docs.withColumns({name: F.lit(10 + k) for k, name in enumerate(helpers)})
    changed = " OR ".join(f"{name} <> {10 + k}" for k, name in enumerate(helpers))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns and got.where("kept <> 1 OR slot <> 2 OR component_id <> 3 OR failures <> 4").count() == 0
        assert got.count() and got.where(changed).count() == 0
    assert minhash.near_duplicates(docs).count() == docs.count() and packing.best_fit({}, 8) == Counter()


def test_words_tell_what_counts_cannot(spark):
    rng = np.random.default_rng(4)
    common, good, bad = ([f"{p}{k:03}" for k in range(300)] for p in "cgb")
    rows = []
    for k in range(600):
        words = [*rng.choice(common, 60), *rng.choice(bad if k % 4 == 0 else good, 25)]
        rows.append((k, " ".join(rng.permutation(words).tolist()), "en", "s", 500))
    labels = [(k, int(k % 4 > 0)) for k in range(600) if k % 3]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {r["doc_id"]: r["kept"] for r in cotrain.quality_scores(docs, spark.createDataFrame(labels, LABELS)).collect()}
    unseen = [k for k in range(0, 600, 3)]
    assert sum(got[k] == (k % 4 > 0) for k in unseen) >= 0.98 * len(unseen)
    model, _ = cotrain.train(docs, spark.createDataFrame(labels, LABELS))
    assert model.report["n"] > 20 and model.report["auc"] > 0.98 and model.report["log_loss"] < 0.2


def test_a_document_is_scored_as_if_it_had_not_been_counted():
    rng = np.random.default_rng(0)
    places = [np.unique(rng.integers(0, cotrain.BUCKETS, 50)) for _ in range(20)]
    y = rng.integers(0, 2, 20)
    words = cotrain.Words.of(places, y)
    others = cotrain.Words.of(places[1:], y[1:])
    assert words.score_without(places[0], y[0]) == pytest.approx(others.score(places[0]))
    assert words.score(np.empty(0, int)) == 0.0 and len(cotrain.word_places(None)) == 0


def test_sequences_follow_the_mixture(spark, sf_dir, tokenizer_path, monkeypatch, tmp_path):
    monkeypatch.setattr(packing, "STRETCH", 8)
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(["word"] * int(rng.integers(5, 60))), "en", "ab"[k % 2], 1) for k in range(1500)]
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(str(tmp_path / "in"))
    corpus_pipeline.mixture(spark, spark.read.parquet(str(tmp_path / "in")), "").write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    order = {r["doc_id"]: k for k, r in enumerate(sorted(mixed.select("doc_id", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n")).collect(), key=lambda r: (r["f"], r["n"])))}
    pieces = packing.pack(mixed, tokenizer_path, 1, 64).collect()
    assert sorted(order) == sorted(r["doc_id"] for r in pieces)
    plan, stretches = packing.plan_packing(dict(Counter(r["length"] for r in pieces)), 64), 0
    total, holding = sum(n for _, n in plan), Counter(v for config, _ in plan for v in set(config))
    stretches = total // 8
    assert stretches > 20
    numbers = {s: k for k, s in enumerate(sorted({r["sequence_id"] for r in pieces}))}
    by_length = {v: sorted(order[r["doc_id"]] for r in pieces if r["length"] == v) for v in holding}
    for r in pieces:  # a piece's place among its length is its sequence's place in the run, but for a stretch and a piece a configuration
        mine = by_length[r["length"]]
        share = numbers[r["sequence_id"]] / total
        assert abs(mine.index(order[r["doc_id"]]) - share * len(mine)) <= 2 * holding[r["length"]] + 3 * len(mine) / stretches + 1


def test_scores_of_labelled_documents_do_not_tell_their_labels(spark):
    """Random words under random labels: whatever the scores of the labelled documents, they say nothing of the labels."""
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 4000, 60)) for _ in range(500)]
    labels = {k: int(rng.random() < 0.5) for k in range(0, 500, 2)}
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    scored = cotrain.quality_scores(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).where("doc_id % 2 = 0").toPandas()
    auc = cotrain.measured(scored["score"].to_numpy(), scored["doc_id"].map(labels).to_numpy())["auc"]
    assert 0.35 < auc < 0.65


def test_near_dedup_leaves_no_tables_of_the_search(spark):
    texts = [" ".join(f"w{k}" for k in range(at, at + 30)) for at in (0, 0, 50, 1000)]
    docs, ws = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), Workspace(spark, "test")
    with ws.around():
        got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in got) == [0, 2, 3]
    assert [p.name.split("-")[1] for p in Path(urlparse(ws.uri).path).iterdir() if list(p.iterdir())] == ["dedup"]
