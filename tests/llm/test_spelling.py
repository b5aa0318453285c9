"""Spelling variants against brute force, with posting lists of every size."""

import random
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from tidemark.llm import queries, spelling as S


def brute_near(words):
    near = {w: set() for w in words}
    for w in words:
        cut = {w[:i] + w[i + 1 :] for i in range(len(w))}
        for v in words:
            if len(v) == len(w) and sum(a != b for a, b in zip(v, w, strict=True)) == 1 or len(v) == len(w) - 1 and v in cut:
                near[w].add(v)
                near[v].add(w)
    return near


def brute_groups(counts, ratio=10):
    near, rows = brute_near(counts), {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        rows[w] = [n, form, counts.get(form), None, len(near[w])]
    for w, row in rows.items():
        at = w
        while rows[at][1] is not None:
            at = rows[at][1]
        row[3] = at
    return {w: tuple(row) for w, row in rows.items()}


def vocabulary(seed, bases=40, letters="abé"):
    """Words over few letters, so that lists are crowded, and edits of them."""
    rng, words = random.Random(seed), set()
    for _ in range(bases):
        w = "".join(rng.choices(letters, k=rng.choice((7, 7, 8, 9, 12))))
        words.add(w)
        for _ in range(6):
            i, c = rng.randrange(len(w)), rng.choice(letters)
            words.add(rng.choice((w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :])))
    return {w: rng.choice((2, 3, 20, 25, 300, 5000)) for w in words if len(w) >= 7}


@pytest.mark.parametrize("crowded", [3, 1000])
def test_groups_equal_brute_force(spark, crowded):
    counts = vocabulary(1) | vocabulary(2, 30, "abcdefghijkl") | {"a" * 7: 4, "a" * 8: 50, "a" * 9: 700, "x" * 400: 2, "x" * 401: 20, "x" * 200 + "y" + "x" * 199: 2}
    got = S.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long"), crowded=crowded).collect()
    assert {r.word: (r.n, r.form, r.form_n, r.root, r.n_near) for r in got} == brute_groups(counts) and len(got) == len(counts)


def test_ties_take_the_smallest_word(spark):
    counts = {"abcdefg": 1, "abcdefx": 10, "abcdefc": 10}
    got = {r.word: r.form for r in S.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got == {"abcdefg": "abcdefc", "abcdefx": None, "abcdefc": None}


def test_no_words(spark):
    assert S.group_variants(spark.createDataFrame([], "word string, n long")).collect() == []


@given(st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=12, unique=True).map(sorted), min_size=1, max_size=8), st.integers(1, 8))
@settings(max_examples=300, deadline=None)
def test_merged_counts_lists(lists, least):
    counts = Counter(x for ids in lists for x in ids)
    assert list(S.merged(lists, least)) == sorted(x for x, n in counts.items() if n >= least)


@given(st.text("abc", min_size=7, max_size=12), st.data())
@settings(max_examples=300, deadline=None)
def test_an_edited_word_meets_its_origin(word, data):
    at, c, kind = data.draw(st.integers(0, len(word) - 1)), data.draw(st.sampled_from("abcd")), data.draw(st.integers(0, 1))
    other = word[:at] + c + word[at + kind :]
    if other == word:
        return
    assert S.one_edit(word, other) and S.one_edit(other, word)
    role = len(other) > len(word)
    short, long = [[p for p in S.postings(w, 1, v, [], {})] for w, v in ((word, role), (other, False))]
    for _ in range(len(other) - 5):  # they share a list at every depth
        shared = {p[0] for p in short} & {p[0] for p in long}
        assert shared
        short, long = ([q for p in some if p[0] in shared for q in S.postings(*p[1:], {})] for some in (short, long))


def brute_query(docs):
    counts = Counter()
    for doc_id, text in docs:
        run = ""
        for c in (text or "") + " ":
            if c in S.UPPER + S.LOWER or "À" <= c <= "ÿ":
                run += c.lower() if c in S.UPPER else c
            elif run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                k = h % len(run)
                counts[run if h % 31 else run[:k] + run[k + 1 :]] += 1
                run = ""
    return brute_groups({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})


def test_query_on_odd_documents(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["Résumés", "resumés", "Ünïcödé", "ÜNÏCÖDÉ", "running", "runnings", "gathering", "short", "x×÷yzabc", "it's", "123abcdefg456"], k=30)) for _ in range(60)]
    docs = [(k, t) for k, t in enumerate(texts)] + [(None, "gathering gathering running"), (3, texts[3]), (90, None), (91, ""), (92, "12 --"), (93, "gathering " * 20_000)]
    frame = spark.createDataFrame([(*d, 1, "w") for d in docs], "doc_id long, text string, n long, word string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_spelling_variants(spark, str(tmp_path)).collect()
    wanted = brute_query(docs)
    assert {r.word: (r.n, r.form, r.form_n, r.root, r.n_near) for r in got} == wanted and wanted and len(got) == len(wanted)
    assert any(row[1] for row in wanted.values())
