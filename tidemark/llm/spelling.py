"""Spelling variants: words one edit apart, found by a positional q-gram inverted index with a count filter.

Two words of which the longer has L code points and that differ by one edit share at least L - 5 of their grams of three,
each at the same position or one further on. Grams have a fixed order, rarest first. Before the first shared gram come only grams that
the edit changed, which lie within three positions of the longer word and two of a shorter one, so a word is posted under the
few grams up to the first that lies out of such reach of one before: by gram, length and position, as a home of its own length, and
as a visitor of the next length at either position. A posting list is a group of rows, dealt by key. Inside it, the shorter postings of
a word's grams are heap-merged under the same limits and looked up in the longer ones, and words on L - 5 lists are verified.

A list that holds too many words is dealt again by the next shared gram as well, as often as needed up to the L - 5 grams that
all its pairs share; nothing is cut off. Grams are ranked by their counts, of which the commonest ``RANKED`` are broadcast.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import compress, count
from operator import ne

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

LETTERS = r"([A-Za-zÀ-ÿ]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points of a gram; an edit makes so many neighbouring grams of the longer word at most, and destroys so many of a shorter one.
GRAM, MADE, LOST = 3, 3, 2
#: Rows of a posting list beyond which it is dealt by one more gram; grams whose rank is broadcast; shortest words that the filter serves.
CROWDED, RANKED, SHORTEST = 1_000, 65_536, 7
_BATCH = 20_000
POSTED = "key long, word string, n long, visitor boolean, picked array<int>"
PAIR = "word string, n long, near string, near_n long"
_POSTED = pa.schema([("key", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("visitor", pa.bool_()), ("picked", pa.list_(pa.int32()))])
_PAIR = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])

Posting = tuple[int, str, int, bool, list[int]]


def letter_runs(text: Column | str = "text") -> Column:
    """Maximal runs of letters of a whole text, with only A-Z lower-cased; null for a null text."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(LETTERS), F.lit(1))


def word_counts(runs: DataFrame, shortest: int = SHORTEST, least: int = 2) -> DataFrame:
    """Distinct words (word, n) of at least ``shortest`` code points that ``runs`` (word, a row per occurrence) holds ``least`` times."""
    return runs.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def gram_order(word: str, ranks: dict[str, int]) -> list[int]:
    """Positions of a word's grams, rarest gram first; equal grams by position, so that two words agree on what they share."""
    grams = [word[i : i + GRAM] for i in range(len(word) - GRAM + 1)]
    return [i for _, _, i in sorted([(ranks.get(g, 0), g, i) for i, g in enumerate(grams)])]


def postings(word: str, n: int, visitor: bool, picked: list[int], ranks: dict[str, int]) -> Iterator[Posting]:
    """A word's postings by one more gram than those picked so far.

    ``picked`` has twice the place in the order of each gram, and one more if the gram stands one position further on in the longer
    word. Grams after the edit are moved and those before are not, so moves never go back along the word. Grams passed over are those
    that the edit changed, so they lie within its reach, and the search ends where they do not.
    """
    order = gram_order(word, ranks)
    length, reach = (len(word) + 1, LOST) if visitor else (len(word), MADE)
    so_far = [(order[code // 2], code % 2) for code in picked]
    path = "".join([f"{length}", *(f"|{word[p : p + GRAM]}@{p + s}" for p, s in so_far)])
    taken = {code // 2 for code in picked}
    passed = [order[k] for k in range(max(taken, default=-1)) if k not in taken]
    low, high = min(passed, default=len(word)), max(passed, default=-1)
    for at in range(max(taken, default=-1) + 1, len(order)):
        if high - low >= reach:
            return
        p = order[at]
        for s in (0, 1) if visitor else (0,):
            if not so_far or all(s >= moved if p > q else s <= moved for q, moved in so_far):
                yield xxhash.xxh3_64_intdigest(f"{path}|{word[p : p + GRAM]}@{p + s}") - (1 << 63), word, n, visitor, [*picked, 2 * at + s]
        low, high = min(low, p), max(high, p)


def merged(lists: list[list[int]], least: int) -> list[int]:
    """Numbers on at least ``least`` of some sorted lists.

    One that is on so many is on one list at least besides the ``least - 1`` longest. The others are merged by a heap of their heads, and
    what comes is looked up in the longest, each from where the last search ended.
    """
    cut = len(lists) - least + 1
    if cut < 1:
        return []
    lists = sorted(lists, key=len)
    kept = [(x, 1) for x in lists[0]] if cut == 1 else _merged_heads(lists[:cut])
    for left, ids in enumerate(reversed(lists[cut:]), 1 - least):  # so many more lists can be missing
        at, n, still = 0, len(ids), []
        for x, found in kept:
            at = bisect_left(ids, x, at)
            if at < n and ids[at] == x:
                still.append((x, found + 1))
            elif found - left > least:
                still.append((x, found))
        kept = still
    return [x for x, found in kept if found >= least]


def _merged_heads(lists: list[list[int]]) -> list[tuple[int, int]]:
    """Numbers of some sorted lists, each with how many lists have it."""
    heap = [(ids[0], k, 0) for k, ids in enumerate(lists)]
    heapq.heapify(heap)
    found: list[tuple[int, int]] = []
    last, times = -1, 0
    while heap:
        head, k, i = heap[0]
        if head == last:
            times += 1
        else:
            if times:
                found.append((last, times))
            last, times = head, 1
        if i + 1 < len(lists[k]):
            heapq.heapreplace(heap, (lists[k][i + 1], k, i + 1))
        else:
            heapq.heappop(heap)
    return [*found, (last, times)]


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes one word the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    same = next(compress(count(), map(ne, a, b)), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def near_in_list(homes: list[tuple[str, int]], visitors: list[tuple[str, int]]) -> Iterator[tuple[str, int, str, int]]:
    """Pairs one edit apart of the words of a posting list: homes among themselves, visitors with homes of one more code point."""
    index: dict[tuple[str, int], list[int]] = {}
    for mine, (word, n) in enumerate(homes):
        grams = [(word[i : i + GRAM], i) for i in range(len(word) - GRAM + 1)]
        if mine:
            for other in merged([ids for g in grams if (ids := index.get(g))], max(1, len(word) - 5)):
                if len(homes[other][0]) == len(word) and one_edit(word, homes[other][0]):
                    yield word, n, *homes[other]
        for g in grams:
            if g in index:
                index[g].append(mine)
            else:
                index[g] = [mine]
    for word, n in visitors:
        places = [(word[i : i + GRAM], i + s) for i in range(len(word) - GRAM + 1) for s in (0, 1)]
        for other in merged([ids for g in places if (ids := index.get(g))], max(1, len(word) - 4)):
            if len(homes[other][0]) == len(word) + 1 and one_edit(word, homes[other][0]):
                yield word, n, *homes[other]


def _posted(words: DataFrame, ranks) -> DataFrame:
    """Postings of rows (word, n, visitor, picked) by one more gram each."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [p for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for p in postings(*row, ranks.value)]
            for at in range(0, len(rows), _BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + _BATCH], strict=True), _POSTED.types, strict=True)], schema=_POSTED)

    return words.select("word", "n", "visitor", "picked").mapInArrow(post, POSTED)


def _met(posted: DataFrame) -> DataFrame:
    """The pairs of every posting list; a task goes through its lists in order and holds one at a time."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, homes, visitors, found = None, [], [], []
        for batch in batches:
            keys, *rest = (c.to_pylist() for c in batch.columns)
            for here, word, n, visitor in zip(keys, *rest, strict=True):
                if here != key:
                    if len(homes) > 1 or homes and visitors:
                        found += near_in_list(homes, visitors)
                    key, homes, visitors = here, [], []
                (visitors if visitor else homes).append((word, n))
            if len(found) >= _BATCH:
                yield _pairs(found)
                found = []
        found += near_in_list(homes, visitors)
        yield _pairs(found)

    return posted.select("key", "word", "n", "visitor").repartition("key").sortWithinPartitions("key").mapInArrow(meet, PAIR)


def _pairs(found: list[tuple]) -> pa.RecordBatch:
    columns = zip(*found, strict=True) if found else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PAIR.types, strict=True)], schema=_PAIR)


def near_words(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Every pair of ``words`` (word, n) one edit apart, once in either direction: word, n, near, near_n.

    Words are distinct, not null and have at least ``SHORTEST`` code points; shorter ones may be missed. An empty table gives no rows.
    """
    ws = Workspace(words.sparkSession, "spelling")
    words = ws.save(words.select("word", F.col("n").cast("long").alias("n")))
    grams = words.select(F.explode(F.expr(f"transform(sequence(1, length(word) - {GRAM - 1}), i -> substring(word, i, {GRAM}))")).alias("gram")).groupBy("gram").count()
    ranks = words.sparkSession.sparkContext.broadcast({r["gram"]: r["count"] for r in grams.orderBy(F.desc("count"), "gram").limit(RANKED).collect()})
    role = F.explode(F.array(F.lit(False), F.lit(True))).alias("visitor")
    posted = ws.save(_posted(words.select("word", "n", role, F.array().cast("array<int>").alias("picked")), ranks))
    found = []
    while True:
        lists = posted.groupBy("key").agg(F.count("*").alias("rows"), F.min(F.length("word") + F.col("visitor").cast("int")).alias("length"), F.min(F.size("picked")).alias("depth"))
        full = ws.save(lists.where((F.col("rows") > crowded) & (F.col("depth") < F.col("length") - 5)).select("key"))
        if full.isEmpty():
            found.append(_met(posted))
            break
        full = F.broadcast(full)  # at most a key for every `crowded` rows
        found.append(_met(posted.join(full, "key", "left_anti")))
        posted = ws.save(_posted(posted.join(full, "key", "left_semi"), ranks))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    pairs = ws.save(pairs)
    turned = pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.unionByName(turned).dropDuplicates(["word", "near"])


def group_variants(words: DataFrame, ratio: int = 10, crowded: int = CROWDED) -> DataFrame:
    """Each of ``words`` (word, n) with its form and root: word, n, form, form_n, root, n_near.

    ``form`` is the commonest near word (ties: the smallest), if it is ``ratio`` times as common at least; ``root`` is where following
    forms ends, the word itself without a form. ``n_near`` counts near words. See ``near_words`` for what words may be.
    """
    ws = Workspace(words.sparkSession, "variants")
    words = ws.save(words.select("word", F.col("n").cast("long").alias("n")))
    best = near_words(words, crowded).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    formed = words.join(best, "word", "left").withColumn("ok", -F.col("best.less") >= ratio * F.col("n"))
    formed = ws.save(formed.select("word", "n", F.when(F.col("ok"), F.col("best.near")).alias("form"), F.when(F.col("ok"), -F.col("best.less")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")))
    # A form is commoner by the ratio, so chains have a step for each power of it at most; each round doubles the steps taken.
    roots, moved = ws.save(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))), True
    while moved:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        stepped = ws.save(roots.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")))
        roots, moved = stepped.drop("moved"), not stepped.where("moved").isEmpty()
    return formed.join(roots, "word", "left").select("word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), "n_near")
