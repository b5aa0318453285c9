"""Runs of words against a comparison of every period."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from tidemark.llm import queries, repeats as R


def brute(words, least):
    """All stretches where words a period apart are equal, each with its smallest period."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


@st.composite
def periodic(draw):
    words = draw(st.lists(st.integers(0, draw(st.integers(0, 4))), max_size=50))
    for _ in range(draw(st.integers(0, 2))):
        part = draw(st.lists(st.integers(0, 3), min_size=1, max_size=9))
        at = draw(st.integers(0, len(words)))
        words = words[:at] + (part * 9)[: draw(st.integers(1, 60))] + words[at:]
    return words


@given(periodic(), st.sampled_from((2, 3, 5, 12)))
@settings(max_examples=600, deadline=None)
def test_runs_equal_brute_force(words, least):
    assert R.runs_of(words, least) == brute(words, least)
    assert R.runs_of_text([str(w).encode() for w in words], least) == brute(words, least)


@given(st.lists(st.integers(0, 3), max_size=60))
@settings(max_examples=300, deadline=None)
def test_factors_are_the_longest_that_began_before(words):
    at = 0
    for start, end, back in R.factors(words):
        assert start == at and end > start
        earlier = lambda n: any(words[i : i + n] == words[start : start + n] for i in range(start))
        if back:
            assert all(words[i] == words[i - back] for i in range(start, end))
            assert end == len(words) or not earlier(end - start + 1)
        else:
            assert end == start + 1 and words[start] not in words[:start]
        at = end
    assert at == len(words)


def brute_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words, 12)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + m for s, m, p in runs)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(kept)))


def odd_documents():
    rng = random.Random(7)
    made = [(k, " ".join(rng.choices(["a", "bé", "c　d", "e\x85f", "g"], k=rng.randrange(120)))) for k in range(120)]
    line = "one two three four five six seven\n"
    made += [(200, None), (201, ""), (202, " \t\r\n\x0b\x0c "), (None, "x y " * 30), (None, None), (3, made[3][1]), (203, line * 40), (204, line + "between " * 3 + line), (205, "w " * 3000)]
    return made + [(206, " ".join(f"{k % 611}" for k in range(2000))), (207, "no\x1crun\xa0here")]


def test_digest_equals_brute_force(spark, tmp_path):
    docs = odd_documents()
    spark.createDataFrame([(*d, 5, "z") for d in docs], "doc_id long, text string, start long, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted(map(tuple, got), key=key) == sorted((brute_digest(*d) for d in docs), key=key)
    assert any(r.n_runs for r in got) and any(zlib.crc32(str(d[0]).encode()) % 10 == 0 and d[1] for d in docs)


def test_runs_and_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "a b c d " * 5 + "end"), (2, "plain words"), (3, None), (4, "")], "doc_id long, text string")
    assert {r.doc_id: [tuple(x) for x in r.runs] for r in R.document_runs(docs).collect()} == {1: [(0, 20, 4)], 2: [], 3: [], 4: []}
    assert {r.doc_id: r.text for r in R.collapse_runs(docs).collect()} == {1: "a b c d end", 2: "plain words", 3: None, 4: ""}


@pytest.mark.parametrize("text", ["w " * 200_000, "a b " * 100_000])
def test_very_long_texts_are_quick(text):
    words = text.encode().split()
    assert R.runs_of_text(words) == [(0, len(words), len(set(words)))]


def test_no_documents(spark):
    assert R.run_digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
