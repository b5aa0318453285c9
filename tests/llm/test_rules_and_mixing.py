"""Quality ledger and mixture: brute force and guarantees; both stay out of Python workers."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing as M
from tidemark.llm import quality_rules as Q


def measure(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {k + d for k in range(len(words) - 2) for d in range(3) if windows[tuple(words[k : k + 3])] > 1}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), n < 50 or 100 * len(inside) > 50 * n)


TEXTS = [
    None, "", " \n\t ", "a b c", "a b c a b c", "a a a a", "x y z x y z x", "One line\nOne line\n \nother\nOne line", "# * | <b> 100% $5 & more",
    "é\xa0ü one\x1ctwo", "word " * 60, " ".join(f"w{k}" for k in range(60)), "SHOUT!! " * 3 + " ".join(f"LOUD{k}!!" for k in range(60)),
    " ".join(f"word{k} |" for k in range(60)), "\n".join(["same line here"] * 3 + [f"l{k} m{k} n{k} o{k}" for k in range(20)]), " ".join(f"q{k}" for k in range(20000)) + " q1 q2 q3",
]


@pytest.fixture(scope="module")
def ledger(spark):
    docs = spark.createDataFrame([(k, t, 5, "c") for k, t in enumerate(TEXTS)] + [(None, "a", 1, "c")], "doc_id long, text string, n_words int, _m string")
    return Q.quality_ledger(docs.select("doc_id", "text", "n_words")).cache()


def test_measurements_equal_brute_force(ledger):
    got = {r["doc_id"]: tuple(r)[1:7] for r in Q.quality_digest(ledger).where("doc_id IS NOT NULL").collect()}
    assert got == {k: measure(t) for k, t in enumerate(TEXTS)}


def test_verdicts(ledger):
    kept = {r["doc_id"] for r in Q.quality_digest(ledger).where("kept").collect()}
    assert kept == {11, 14, 15}
    failed = {r["doc_id"]: r["failures"] for r in ledger.collect()}
    names = list(Q.RULES)
    assert {n for k, n in enumerate(names) if failed[12] >> k & 1} == {"shouting", "exclamations"}
    assert {n for k, n in enumerate(names) if failed[13] >> k & 1} == {"symbols"}


def test_policies_and_ablations_are_bitwise(ledger):
    rows = ledger.collect()
    verdicts = {r["doc_id"]: r["kept"] for r in Q.apply_policies(ledger).collect()}
    for p in Q.POLICIES:
        assert sum(v[p.version] for v in verdicts.values()) == sum(not r["failures"] & p.mask for r in rows)
    for r in Q.ablations(ledger).collect():
        mask = next(p.mask for p in Q.POLICIES if p.version == r["version"])
        bit = 1 << list(Q.RULES).index(r["rule"])
        wanted = [sum(bool(x["failures"] & bit) for x in rows), sum(x["failures"] & mask == bit for x in rows), sum(not x["failures"] & mask & ~bit for x in rows)]
        assert [r["failing"], r["rejected_alone"], r["kept_without"]] == wanted
    assert Q.ablations(ledger.limit(0)).agg(F.sum("failing")).first()[0] == 0


def test_passing_keeps_the_columns(spark, documents):
    docs = documents.withColumn("text", F.when(F.col("doc_id") == 4, F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: F.concat(F.lit("word"), k.cast("string"))), " ")).otherwise(F.col("text")))
    got = Q.passing(docs)
    assert got.columns == docs.columns and [r["doc_id"] for r in got.collect()] == [4]


def sources(spark, sizes, chars=100):
    rows = [(k * 1000 + n, "x" * chars, s) for k, (s, count) in enumerate(sizes.items()) for n in range(count)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.97, "b": 0.02, "c": 0.01}, None])
def test_sources_stay_within_a_block_of_their_weights(spark, weights):
    docs = sources(spark, {"a": 300, "b": 200, "c": 150})
    placed = M.mix_sources(docs, weights, block_chars=100, cycle=50).select("source", "mix_block", "mix_slot", "mix_release", "mix_deadline").distinct().collect()
    assert len({r["mix_slot"] for r in placed}) == len(placed) == 650
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in placed)
    totals = docs.groupBy(M.source_key().alias("key")).agg(F.sum(F.length("text")).alias("chars"))
    share = {r["key"].removeprefix("="): r["n"] / r["q"] for r in M.shares(totals, weights, 50, M.POWER).collect()}
    assert sum(share.values()) == pytest.approx(1)
    last = min(max(r["mix_slot"] for r in placed if r["source"] == s) for s in "abc")
    served = defaultdict(int)
    for r in sorted(placed, key=lambda r: r["mix_slot"]):
        if r["mix_slot"] > last:
            break
        served[r["source"]] += 1
        for s, w in share.items():
            assert abs(served[s] - w * (r["mix_slot"] + 1)) < 1


def test_no_source_drifts_from_the_weights_passed_in(spark):
    weights = {f"s{k:02}": (0.9 if k == 0 else 0.1 / 19) for k in range(20)}
    docs = sources(spark, {s: 2700 if s == "s00" else 15 for s in weights})
    served, slots = Counter(), sorted((r["mix_slot"], r["source"]) for r in M.mix_sources(docs, weights, block_chars=100).select("source", "mix_slot").collect())
    last = min(max(t for t, x in slots if x == s) for s in weights)
    assert last > 2000
    for t, s in slots:
        if t > last:
            break
        served[s] += 1
        assert all(abs(served[x] - w * (t + 1)) < 1 + 1e-9 for x, w in weights.items())


def test_many_sources_keep_their_weights():
    rng = np.random.default_rng(0)
    n = [int(x) for x in rng.integers(1, 1 << 40, 20_000)]
    q = sum(n)
    placed = list(M.earliest_deadline_first([(w, 5) for w in n]))
    assert len(placed) == len({p[:2] for p in placed}) == len({p[4] for p in placed}) == 100_000
    assert all(r == j * q // n[k] and d == -(-(j + 1) * q // n[k]) and r <= t < d for k, j, r, d, t in placed)
    assert list(M.earliest_deadline_first([])) == []


def brute_edf(weights, blocks):
    """Slot by slot: the released block with the earliest deadline."""
    q, done, slot, out = sum(weights), [0] * len(weights), 0, []
    while any(d < b for d, b in zip(done, blocks, strict=True)):
        released = [(-(-(d + 1) * q // w), k) for k, (w, d, b) in enumerate(zip(weights, done, blocks, strict=True)) if d < b and d * q // w <= slot]
        if released:
            _, k = min(released)
            out.append((k, done[k], slot))
            done[k] += 1
        slot += 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_every_slot_equals_a_simulation(seed):
    rng = np.random.default_rng(seed)
    weights, blocks = [int(x) for x in rng.integers(1, 50, 7)], [int(x) for x in rng.integers(0, 40, 7)]
    assert [(k, j, t) for k, j, _, _, t in M.earliest_deadline_first(list(zip(weights, blocks, strict=True)))] == brute_edf(weights, blocks)


def test_blocks_grow_until_the_schedule_is_bounded(spark):
    docs = sources(spark, {"a": 300, "b": 200, "c": 150})
    placed = M.mix_sources(docs, {"a": 0.5, "b": 0.3, "c": 0.2}, block_chars=100, blocks=100).select("source", "mix_block", "mix_slot").distinct().collect()
    assert 60 <= len(placed) <= 103
    assert M.mix_sources(docs, block_chars=100, blocks=1).select("source", "mix_block").distinct().count() == 3


def test_sources_without_weight_follow(spark):
    docs = sources(spark, {"a": 20, "b": 10, "c": 5, "d": 5})
    slots = {s: sorted(r["mix_slot"] for r in M.mix_sources(docs, {"a": 2.0, "b": 1.0}, block_chars=100).where(F.col("source") == s).collect()) for s in "abcd"}
    assert sorted(sum(slots.values(), [])) == sorted(set(sum(slots.values(), []))) and len(sum(slots.values(), [])) == 40
    assert max(slots["a"] + slots["b"]) < min(slots["c"] + slots["d"])


def test_blocks_are_filled_in_order(spark):
    docs = spark.createDataFrame([(k, "x" * (k % 7 * 10), "s") for k in range(200)], "doc_id long, text string, source string")
    rows = M.mix_sources(docs, block_chars=100).orderBy("mix_start", "mix_chars").collect()
    at = 0
    for r in rows:
        assert r["mix_start"] == at and r["mix_block"] == at // 100
        at += r["mix_chars"]


def test_mixture_keeps_every_row_and_column(documents):
    got = M.in_mixture_order(documents)
    assert got.columns == documents.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, documents.collect()))
    assert M.mixture_plan(documents.limit(0)).count() == 0


def test_order_of_the_mixture(spark):
    docs = sources(spark, {"a": 90, "b": 30}, chars=M.BLOCK_CHARS)
    order = [r["source"] for r in M.in_mixture_order(docs).collect()]
    assert "a" in order[:4] and "b" in order[:4] and len(order) == 120


def test_native(spark, documents):
    for df in (Q.quality_digest(Q.quality_ledger(documents)), Q.passing(documents), M.mixture_plan(documents), M.in_mixture_order(documents)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
