"""Token files, separator scan and packing against the library and brute force."""

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import packing, separator_scan, token_files
from tidemark.llm.vocab import WordEncoder
from tidemark.llm.workspace import Workspace

END = 1


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def encoders(tokenizer_path):
    return WordEncoder(tokenizer_path), WordEncoder(tokenizer_path, special_as_text=True)


@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r.,!?'\"ab AB éÉßİΣ日\x1c\x85\xa0́ <|>1"), st.characters(codec="utf-8")), max_size=60))
def test_cached_encoding_equals_the_library(encoders, encode, text):
    got = np.frombuffer(encoders[0].encode([text])[0], encoders[0].dtype).tolist()
    assert got == encode(text)


def test_special_strings(encoders, encode):
    text = "a <|endoftext|> <|EndOfText|> b<|startoftext|>c"
    raw, plain = (np.frombuffer(e.encode([text])[0], e.dtype).tolist() for e in encoders)
    assert raw == encode(text) and 49407 in raw and 49407 not in plain


def test_caches_stay_bounded(tokenizer_path, encode, monkeypatch):
    monkeypatch.setattr("tidemark.llm.vocab._CHUNKS", 3)
    monkeypatch.setattr("tidemark.llm.vocab._CORES", 3)
    enc = WordEncoder(tokenizer_path)
    for text in ("one two three four", "five six seven eight", "one nine"):
        assert np.frombuffer(enc.encode([text])[0], enc.dtype).tolist() == encode(text)
    assert len(enc._chunks) < 9


def test_token_files_round_trip(documents, tokenizer_path, encode):
    rows = documents.select("doc_id", "text").collect()
    ordered = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    wanted, at = [], 0
    for r in ordered:
        ids = [*encode(r["text"]), END]
        wanted.append((r["doc_id"], at, len(ids), crc(ids)))
        at += len(ids)
    got = [tuple(r) for r in token_files.token_file_digest(documents, tokenizer_path, END).collect()]
    assert sorted(got, key=lambda r: r[1]) == wanted


def test_offsets_are_flat_64_bit(spark, documents, tokenizer_path):
    manifest = token_files.write_token_files(documents, Workspace(spark, "t"), tokenizer_path, END).collect()
    ends = []
    for m in sorted(manifest, key=lambda m: m["part"]):
        path = m["file"].removeprefix("file://")
        offsets = np.memmap(f"{path}.off", "<u8", "r")
        assert len(offsets) == m["n_docs"] + 1 and offsets[0] == m["base"] and offsets[-1] - offsets[0] == m["n_tokens"]
        assert len(np.memmap(f"{path}.bin", "<u2", "r")) == m["n_tokens"]
        ends.append((int(offsets[0]), int(offsets[-1])))
    assert all(a[1] == b[0] for a, b in zip(ends[:-1], ends[1:], strict=True))


@pytest.mark.parametrize("block", [1, 3, 1000, 1 << 20])
def test_separator_scan(documents, tokenizer_path, encode, block):
    small = documents.where("doc_id IS NULL OR doc_id <> 4") if block < 1000 else documents
    got = separator_scan.count_tokens(small, tokenizer_path, 49407, block).orderBy("doc_index").collect()
    wanted = Counter((r["doc_id"], len(encode(r["text"]))) for r in small.collect())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == wanted
    at = 0
    for k, r in enumerate(got):
        assert (r["doc_index"], r["start"], r["closed"]) == (k, at, True)
        at += r["n_tokens"] + 1


def test_documents_may_cross_files_and_stay_open(spark, tmp_path):
    parts = [[5, 6], [7, 0, 8], [0, 0, 9, 9]]
    rows = []
    for k, ids in enumerate(parts):
        np.array(ids, "<u2").tofile(tmp_path / f"f{k}.bin")
        rows.append((k, f"file://{tmp_path}/f{k}", 2, len(ids)))
    files = spark.createDataFrame(rows, "part int, file string, width int, n_tokens long")
    for block in (1, 2, 10):
        got = separator_scan.stitch(separator_scan.scan_blocks(files, 0, block), Workspace(spark, "t")).orderBy("doc_index").collect()
        assert [(r["start"], r["n_tokens"], r["closed"]) for r in got] == [(0, 3, True), (4, 1, True), (6, 0, True), (7, 2, False)]


def check_packing(rows, capacity):
    space = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == space.get(r["sequence_id"], 0)
        space[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(s <= capacity for s in space.values())
    return len(space)


def test_packing_places_every_piece(documents, tokenizer_path, encode):
    rows = packing.pack(documents, tokenizer_path, END, 16).collect()
    wanted = Counter()
    for r in documents.collect():
        ids = [*encode(r["text"]), END]
        wanted.update((r["doc_id"], k, s, len(ids[s : s + 16]), crc(ids[s : s + 16])) for k, s in enumerate(range(0, len(ids), 16)))
    assert Counter(tuple(r)[:5] for r in rows) == wanted
    check_packing(rows, 16)


@settings(max_examples=40, deadline=None)
@given(lengths=st.lists(st.integers(1, 64), max_size=300))
def test_plan_covers_the_histogram_near_the_bound(lengths):
    plan = packing.plan_packing(dict(Counter(lengths)), 64)
    used = Counter()
    for config, n in plan:
        assert sum(config) <= 64 and n > 0
        for v in config:
            used[v] += n
    assert used == Counter(lengths)
    first_fit = []
    for v in sorted(lengths, reverse=True):
        k = next((k for k, s in enumerate(first_fit) if s + v <= 64), None)
        if k is None:
            first_fit.append(v)
        else:
            first_fit[k] += v
    assert sum(n for _, n in plan) <= len(first_fit) * 1.05 + 1


def test_large_histograms_reach_the_bound():
    lengths = np.clip(np.exp(np.random.default_rng(0).normal(4.5, 1, 30000)).astype(int) + 1, 1, 512)
    plan = packing.plan_packing(dict(Counter(lengths.tolist())), 512)
    assert sum(n for _, n in plan) <= -(-int(lengths.sum()) // 512) * 1.005


@pytest.mark.parametrize(
    ("histogram", "most"),
    [({2100: 400, 1000: 400}, 400), ({1400: 500, 1500: 501, 1366: 333}, 667), ({2100: 300, 1400: 500, 1000: 400, 700: 200, 600: 900}, 618)],
)
def test_plan_reaches_an_lp_bound_above_the_volume(histogram, most):
    counts = np.zeros(4097, np.int64)
    for v, n in histogram.items():
        counts[v] = n
    _, prices, bound = packing.solve_lp(counts, 4096)
    assert bound > 1.02 * (counts @ np.arange(4097)) / 4096
    assert counts @ prices >= bound * packing.price_configs(prices, 4096)[0][4096] * (1 - 1e-9)
    plan = packing.plan_packing(histogram, 4096)
    used = Counter()
    for config, n in plan:
        assert sum(config) <= 4096
        for v in config:
            used[v] += n
    assert used == histogram and bound - 1e-6 <= sum(n for _, n in plan) <= most
    assert packing.solve_lp(counts, 4096)[2] <= most


def test_empty_tables(documents, tokenizer_path):
    none = documents.limit(0)
    assert packing.pack(none, tokenizer_path, END).count() == 0
    assert token_files.token_file_digest(none, tokenizer_path, END).count() == 0
    assert separator_scan.count_tokens(none, tokenizer_path, 49407).count() == 0


@pytest.mark.parametrize("capacity", [64, 4096])
@settings(max_examples=25, deadline=None)
@given(data=st.data())
def test_no_plan_is_worse_than_best_fit(capacity, data):
    lengths = data.draw(st.lists(st.integers(capacity // 12, capacity), min_size=1, max_size=80))
    plan, bound = packing.plan_and_bound(dict(Counter(lengths)), capacity)
    alone = packing.best_fit(dict(Counter(lengths)), capacity).total()
    assert bound <= sum(n for _, n in plan) <= alone


@pytest.mark.parametrize(("histogram", "most"), [({2049: 5000, 1024: 5000}, 5000), ({1400: 3000, 1360: 3000, 2700: 1000}, 3167)])
def test_plans_within_one_of_the_lp(histogram, most):
    plan, bound = packing.plan_and_bound(histogram, 4096)
    assert bound <= sum(n for _, n in plan) <= most and bound >= most - 1 - most * packing.GAP


def test_the_weights_matter(monkeypatch):
    lengths = np.random.default_rng(3).integers(90, 190, 3000)
    counts = np.bincount(lengths, minlength=337)[:337]
    _, _, bound = packing.solve_lp(counts, 336)
    monkeypatch.setattr(packing, "RATE", 0.0)
    _, _, flat = packing.solve_lp(counts, 336)
    assert flat == pytest.approx(counts @ np.arange(337) / 336) and bound > 1.005 * flat


def test_plans_come_from_priced_configurations(monkeypatch):
    """On lengths like those of documents the plan is the LP's at its first prices, and within the gap of its bound."""
    rng = np.random.default_rng(5)
    lengths = np.minimum(4096, np.exp(rng.normal(6, 0.9, 30_000)).astype(int) + 3)
    alone = packing.best_fit
    monkeypatch.setattr(packing, "best_fit", lambda h, c: alone(h, c) if sum(h.values()) < len(lengths) else Counter({(c,): 10**9}))
    plan, bound = packing.plan_and_bound(dict(Counter(lengths.tolist())), 4096)
    assert sum(n * len(c) for c, n in plan) == len(lengths) and bound <= sum(n for _, n in plan) <= bound * (1 + packing.GAP)


def test_long_texts_are_packed_whole(spark, tokenizer_path, encode):
    text = "The quick brown fox, 12 times. " * 20000
    rows = packing.pack(spark.createDataFrame([(1, text), (2, "short"), (None, None)], "doc_id long, text string"), tokenizer_path, END).collect()
    ids = [*encode(text), END]
    mine = sorted((r for r in rows if r["doc_id"] == 1), key=lambda r: r["piece"])
    assert [(r["start"], r["length"]) for r in mine] == [(s, min(4096, len(ids) - s)) for s in range(0, len(ids), 4096)]
    assert all(r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]]) for r in mine)
    check_packing(rows, 4096)
