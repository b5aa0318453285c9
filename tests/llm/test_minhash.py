"""Near-duplicates against brute force on shingle strings."""

import random
import re
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest

from tidemark.llm import minhash as M
from tidemark.llm.components import connected_components, linked_groups
from tidemark.llm.workspace import Workspace


def word_sets(text, words):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    tokens = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(tokens) < words:
        return {tuple(tokens)} if tokens else set()
    return set(zip(*(tokens[k:] for k in range(words))))


def components(sets, similarity):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and shared * similarity.denominator >= similarity.numerator * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def corpus():
    """Copies near the threshold, a group too large for one block and a passage that all share."""
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = " ".join(rng.choices(vocabulary, k=40))
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(20, 80))) for _ in range(120)]
    texts = [f"{t} {passage}" if rng.random() < 0.5 else t for t in texts]
    for t in texts[:60]:
        words = t.split()
        for _ in range(rng.randint(1, 3)):
            w = list(words)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w).upper() if rng.random() < 0.3 else "\n".join(w))
    base = rng.choices(vocabulary, k=60)
    for _ in range(80):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    return [*texts, "", "   ", None, "one", "one", "One two", "one two", "é É", "é é"]


@pytest.mark.parametrize(("words", "similarity", "block"), [(3, Fraction(85, 100), 1024), (3, Fraction(85, 100), 16), (5, Fraction(4, 5), 16)])
def test_components_equal_brute_force(spark, monkeypatch, words, similarity, block):
    monkeypatch.setattr(M, "_BLOCK", block)
    texts = corpus()
    sets = {k: word_sets(t, words) for k, t in enumerate(texts)}
    wanted = components(sets, similarity)
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, component long").repartition(5)
    got = {r["doc_id"]: tuple(r)[1:] for r in M.near_duplicates(docs, words, similarity).collect()}
    assert got == {k: (len(sets[k]), wanted[k], wanted[k] == k) for k in sets}
    assert sum(wanted[k] != k for k in wanted) > 50


def test_null_ids_repeats_and_no_rows(spark):
    text = " ".join(f"a{k}" for k in range(30))
    docs = spark.createDataFrame([(None, text), (3, text), (3, text), (4, text)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in M.near_duplicates(docs).collect()), key=str)
    assert got == [(3, 3, True), (3, 3, True), (4, 3, False), (None, None, True)]
    assert M.near_duplicates(docs.limit(0)).count() == 0


def test_match_threshold_misses_rarely():
    t = M.match_threshold(Fraction(85, 100))
    rng = np.random.default_rng(0)
    assert (rng.binomial(M.COORDINATES, 0.85, 1_000_000) < t).mean() < 1e-5
    assert t > M.COORDINATES // 2


def test_a_long_text(spark):
    words = [f"x{k}" for k in range(60_000)]
    edited = [*words[:30_000], "y", *words[30_001:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited))], "doc_id long, text string")
    assert {r["component_id"] for r in M.near_duplicates(docs).collect()} == {1}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_connected_components(spark, kind):
    rng = random.Random(4)
    edges = {"chain": [(k, k + 1) for k in range(200)], "star": [(0, k) for k in range(1, 200)], "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(150)], "none": []}[kind]
    wanted = components({n: {("s", n)} for e in edges for n in e}, Fraction(1))
    parent = dict(wanted)

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*edges, (None, 1)] if edges else [], "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(df, Workspace(spark, "t")).collect()}
    assert got == {n: root(n) for n in parent}


@pytest.mark.parametrize("few", [0, 50, 10_000])
def test_few_edges_are_merged_at_once(spark, monkeypatch, few):
    monkeypatch.setattr("tidemark.llm.components.FEW", few)
    ws = Workspace(spark, "few")
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(100, 300) if k % 40], "src string, dst string")
    got = {r["node"]: r["component"] for r in connected_components(edges, ws).collect()}
    assert got == {f"n{k}": f"n{max(k - (k - 1) % 40, 100)}" for k in range(100, 301)}
    assert ws._tables <= 3 or few < 200


def test_linked_groups():
    linked = np.zeros((6, 6), bool)
    for a, b in ((0, 3), (3, 5), (1, 2)):
        linked[a, b] = linked[b, a] = True
    assert [g.tolist() for g in linked_groups(linked)] == [[0, 3, 5], [1, 2]]


@pytest.mark.parametrize("alone", [True, False])
def test_large_groups_are_connected_by_two_looks(spark, monkeypatch, alone):
    """Two groups of more than a block, in clusters of one kind of set each, the smallest member with its kind or without; one group of one kind."""
    monkeypatch.setattr(M, "_BLOCK", 8)
    rng = random.Random(5)
    kind = {k: 0 if alone and k % 100 == 0 else rng.choice([1, 1, 1, 1, 2, 2, 3 + k]) for k in [*range(1, 60), *range(100, 140)]} | {k: 1 for k in range(200, 300)}
    kind[0] = 0 if alone else 1
    members = spark.createDataFrame([(k // 100, k) for k in kind], "near long, rep long")
    sets = spark.createDataFrame([(k, [10 * kind[k], 10 * kind[k] + 1]) for k in kind], "rep long, shingles array<long>")
    ws = M.Workspace(spark, "looks")
    links = M.connecting_links(members, "near", sets, "shingles", M.as_sets, lambda shared, a, b: shared >= 2, ws)
    got = {r["node"]: r["component"] for r in M.connected_components(links, ws).collect()}
    smallest = {}
    for k in sorted(kind):
        smallest.setdefault((k // 100, kind[k]), k)
    assert {k: got.get(k, k) for k in kind} == {k: smallest[k // 100, kind[k]] for k in kind}


def test_copies_are_sent_once_to_each_look(spark, monkeypatch):
    monkeypatch.setattr(M, "_BLOCK", 8)
    sized = spark.createDataFrame([(1, k, 800, 0) for k in range(800)], "of long, rep long, n long, hub long")
    first = M.first_look(sized).groupBy("rep").count().collect()
    assert all(r["count"] == (100 if r["rep"] == 0 else 1) for r in first)
    linked = spark.createDataFrame([(k, 0) for k in range(790)], "node long, component long")
    second = M.second_look(sized, linked).groupBy("rep").count().collect()
    assert {r["rep"] // 790: r["count"] for r in second} == {0: 2, 1: 101}  # 99 blocks of the component, 2 of the others
