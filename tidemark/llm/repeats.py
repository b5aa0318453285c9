"""Periodic runs of words, found by the method of Kolpakov and Kucherov in every document.

A run is a stretch of words with a smallest period of which it holds two at least, that no neighbouring word extends. For each document
a task factorises the words by Lempel and Ziv, each factor being the longest that begins earlier too, as a suffix automaton tells.
Main's algorithm finds the runs that touch or cross the start of a factor, from common extensions to both sides of it in a window of
the two factors around it. Every other run lies inside one factor, and is copied from the earlier occurrence of that factor.

Before that, words that no run of the asked length can hold are set aside: a run of ``least`` words repeats its first
``least // 2`` words one period later and all its words lie in such repeats, so only stretches covered by windows that the stretch holds twice are
factorised. The filter is exact, and most prose has no such stretch. Work is linear in the words, and no document meets another.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import bound_batches

LEAST = 12
RUNS = """doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"""
_STEP, _MIX = 64, np.uint64(0x9E3779B97F4A7C15)
_TYPES = (pa.int64(),) * 6 + (pa.string(),) * 2

Run = tuple[int, int, int]  # start, length, period
Change = Callable[[int | None, list[bytes]], list[bytes]]


def factors(words: list[int]) -> list[tuple[int, int, int]]:
    """The factorisation as (start, end, distance back to an earlier occurrence; 0 for a word seen first)."""
    following: list[dict[int, int]] = [{}]
    link, longest, first_end = [-1], [0], [-1]
    last = 0
    for at, word in enumerate(words):
        new = len(following)
        following.append({})
        longest.append(longest[last] + 1)
        first_end.append(at)
        link.append(0)
        p = last
        while p >= 0 and word not in following[p]:
            following[p][word] = new
            p = link[p]
        if p >= 0:
            q = following[p][word]
            if longest[p] + 1 == longest[q]:
                link[new] = q
            else:
                twin = len(following)
                following.append(following[q].copy())
                longest.append(longest[p] + 1)
                first_end.append(first_end[q])
                link.append(link[q])
                while p >= 0 and following[p].get(word) == q:
                    following[p][word] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    found, at, n = [], 0, len(words)
    while at < n:
        state, end, seen = 0, at, -1
        while end < n and (state := following[state][words[end]]) and first_end[state] < end:
            seen = first_end[state]
            end += 1
        found.append((at, end, end - 1 - seen) if end > at else (at, at + 1, 0))
        at = found[-1][1]
    return found


def prefixes(words: list[int]) -> list[int]:
    """At each place, how many words from there are those of the start."""
    n, z = len(words), [0] * len(words)
    low = high = 0
    for i in range(1, n):
        k = min(z[i - low], high - i) if i < high else 0
        while i + k < n and words[k] == words[i + k]:
            k += 1
        z[i] = k
        if i + k > high:
            low, high = i, i + k
    return z


def across(words: list[int], low: int, at: int, end: int, least: int) -> dict[tuple[int, int], int]:
    """Runs in ``words[low:end]`` that touch or cross ``at``, as (start, end): smallest period; only those that are whole there."""
    left, right = words[low:at], words[at:end]
    back, n, m = left[::-1], at - low, end - at
    ahead, behind = prefixes(right), prefixes(back)
    before = prefixes([*back, -1, *right[::-1], *back])  # of a suffix of the left part with what ends in the right part
    after = prefixes([*right, -1, *left, *right])
    found: dict[tuple[int, int], int] = {}

    def note(start: int, stop: int, period: int) -> None:
        if stop - start < least or start == low and low and words[low - 1] == words[low - 1 + period]:
            return
        if stop == end and end < len(words) and words[end] == words[end - period]:
            return
        found[start, stop] = min(period, found.get((start, stop), period))

    for q in range(1, m + 1):
        suffix, prefix = before[n + 1 + m - q], ahead[q] if q < m else 0
        if suffix + prefix >= q:
            note(at - suffix, at + q + prefix, q)
    for q in range(1, n + 1):
        suffix, prefix = behind[q] if q < n else 0, after[m + 1 + n - q]
        if suffix + prefix >= q:
            note(at - q - suffix, at + prefix, q)
    return found


def runs_of(words: list[int], least: int = LEAST) -> list[Run]:
    """All runs of at least ``least`` words, by start and period."""
    starts: dict[int, dict[int, int]] = {}  # start: end: period
    parts = factors(words)
    for k, (at, end, back) in enumerate([*parts, (len(words), len(words), 0)]):
        if k:
            before = at - parts[k - 1][0]
            for (start, stop), period in across(words, max(0, at - 2 * before - (end - at)), at, end, least).items():
                known = starts.setdefault(start, {})
                known[stop] = min(period, known.get(stop, period))
        if back:
            for start in range(at + 1, end - least):
                if same := starts.get(start - back):
                    inside = {stop + back: period for stop, period in same.items() if stop + back < end}
                    if inside:
                        starts[start] = starts.get(start, {}) | inside
    return sorted((start, stop - start, period) for start, stops in starts.items() for stop, period in stops.items())


def stretches(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches that can hold runs: all their words lie in windows of ``least // 2`` words that the stretch holds twice."""
    width = least // 2
    found = [(0, len(words))]
    while True:
        narrowed = []
        for low, high in found:
            if high - low < least:
                continue
            codes = words[low:high].astype(np.uint64)
            n = len(codes) - width + 1
            windows = np.zeros(n, np.uint64)
            for k in range(width):
                windows = (windows ^ (windows >> np.uint64(29))) * _MIX + codes[k : k + n]
            if not (np.diff(np.sort(windows)) == 0).any():
                continue
            order = np.argsort(windows)
            twin = np.diff(windows[order]) == 0
            again = np.zeros(n, bool)
            again[order[1:][twin]] = again[order[:-1][twin]] = True
            marks = np.zeros(len(codes) + 1, np.int64)
            marks[:n] += again
            marks[width:] -= again
            covered = np.concatenate([[0], np.cumsum(marks[:-1]) > 0, [0]]).astype(np.int8)
            edges = np.flatnonzero(np.diff(covered)) + low
            narrowed += [(int(a), int(b)) for a, b in edges.reshape(-1, 2) if b - a >= least]
        if narrowed == found:
            return found
        found = narrowed


def runs_of_text(words: list[bytes], least: int = LEAST) -> list[Run]:
    if len(words) < least:
        return []
    codes = np.fromiter(map({}.setdefault, words, count()), np.int64, len(words))
    found = [(low + start, length, period) for low, high in stretches(codes, least) for start, length, period in runs_of(codes[low:high].tolist(), least)]
    return sorted((run for run in found if run[1] >= least), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """``words`` without those that some run holds after its first period."""
    if not runs:
        return words
    marks = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        marks[start + period] += 1
        marks[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(marks[:-1]) == 0)]


def periodic_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words as the contract's query alters them: of a tenth of the documents the tail repeats; those without a doc_id stay."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _each(docs: DataFrame, schema: str, types: tuple, names: list[str], result: Callable[[int | None, list[bytes], list[Run]], tuple], least: int, change: Change | None) -> DataFrame:
    bound_batches(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                rows = []
                for doc_id, text in zip(*(c.to_pylist() for c in batch.slice(at, _STEP).columns), strict=True):
                    words = (text or b"").split()
                    words = change(doc_id, words) if change else words
                    rows.append(result(doc_id, words, runs_of_text(words, least)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(find, schema)


def document_runs(docs: DataFrame, least: int = LEAST, change: Change | None = None) -> DataFrame:
    """Of every row of ``docs`` (doc_id, text) all its runs: doc_id and ``runs``, an array of (start, length, period) by start and period.

    Words are what blanks (space, tab, line ends) part in the whole text; a null or empty text has none. Rows are taken one by one, so
    repeats and null ids have rows of their own. ``change`` may replace a document's words first.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    as_rows = lambda doc_id, words, runs: (doc_id, [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
    return _each(docs, "doc_id long, runs array<struct<start: long, length: long, period: long>>", (pa.int64(), kind), ["doc_id", "runs"], as_rows, least, change)


def collapse_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Each row's doc_id and ``text``: its words joined by one blank, without those that repeat a period; null of a null text."""
    as_text = lambda doc_id, words, runs: (doc_id, b" ".join(collapsed(words, runs)).decode("utf-8", "replace"))
    given = _each(docs.where("text IS NOT NULL"), "doc_id long, text string", (pa.int64(), pa.string()), ["doc_id", "text"], as_text, least, None)
    return given.unionByName(docs.where("text IS NULL").select(F.col("doc_id").cast("long"), F.lit(None).cast("string").alias("text")))


def run_digest(docs: DataFrame, least: int = LEAST, change: Change | None = None) -> DataFrame:
    """A row per document: doc_id, n_runs, the longest run (ties: first, then smallest period) with exponent_milli, and digests of all runs and of what ``collapse_runs`` leaves.

    Without a run start, length, period and exponent_milli are null; the digests never are.
    """

    def digest(doc_id: int | None, words: list[bytes], runs: list[Run]) -> tuple:
        start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
        texts = (hashlib.sha256(data).hexdigest() for data in (lines, b" ".join(collapsed(words, runs))))
        return doc_id, len(runs), start, length, period, 1000 * length // period if runs else None, *texts

    names = [field.split()[0] for field in RUNS.split(", ")]
    return _each(docs, RUNS, _TYPES, names, digest, least, change)
