"""MinHash near-duplicates by a signature-coordinate inverted join.

1. One pass over the texts gives each document its set of word shingles (64-bit hashes),
   a key of the whole set and a signature of ``COORDINATES`` minima. Documents with equal sets
   form a class; only its first document goes on, however many copies there are.
2. Classes are posted under each (coordinate, value). A pair above the match threshold t shares
   t postings, so values that one class alone has can be skipped, classes with fewer than t others
   have no partner, and of the rest the f - t + 1 rarest postings (the prefix) meet
   every partner. The long lists, those of passages that many documents share, fall
   outside it: they are skipped and only counted, from the signatures. Of lists with the same
   members one is enough.
3. Matches are counted inside each list, and pairs with t or more are retained as a spanning forest, never
   one by one. The components of these forests hold every similar pair.
4. Inside each component full sets are compared, which confirms the links, again kept as a spanning forest;
   their components are the result.

Lists and components of more than a block meet their smallest member first, then only pairs that this did
not connect are dealt out, by pairs of blocks: a group that a third of all documents
belong to is many tasks of bounded size, and copies of one text are sent twice, not once a block. t is the largest threshold that a pair at the wanted
similarity misses with a probability of at most ``MISS``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, linked_groups
from .workspace import Workspace, release

COORDINATES, MISS = 48, 1e-6
_WORDS, _SHORT, _BLOCK, _STEP, _COLUMNS, _ROWS = 200_000, 64, 1024, 4096, 2048, 64
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SKETCH = "doc_id long, n_shingles long, set_key binary, signature binary"


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= _SHORT:
            self[word] = value
        return value


_hashes = _WordHashes()


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the ``words``-word shingles of a text, A-Z lower-cased.

    A text with fewer words is one shingle; one without words has none.
    """
    tokens = text.encode("utf-8", "replace").lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    if len(_hashes) > _WORDS:
        _hashes.clear()
    codes = np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))
    width = min(words, len(tokens))
    mixed = codes[: len(codes) - width + 1].copy()
    for k in range(1, width):
        mixed *= _MULTIPLIER
        mixed += codes[k : len(codes) - width + 1 + k]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    if width < words:
        mixed ^= np.uint64(width)  # a short text is no shingle of a longer one
    return np.unique(mixed)


def signature(values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), _STEP):
        np.minimum(least, np.multiply.outer(factors, values[at : at + _STEP]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def match_threshold(similarity: Fraction, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The largest t that fewer than t of the coordinates of a similar pair match with probability <= miss."""
    p, below = float(similarity), 0.0
    for t in range(coordinates + 1):
        below += math.comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if below > miss:
            return max(1, t)
    return coordinates


def sketch(docs: DataFrame, words: int, coordinates: int = COORDINATES) -> DataFrame:
    """Per document (doc_id, text): set size, key of the set and signature; both null for an empty set."""
    factors = np.random.default_rng(20).integers(0, 1 << 63, coordinates, np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, signatures = [], [], []
            for text in batch.column(1):
                values = shingles(text.as_py(), words)
                sizes.append(len(values))
                keys.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None)
                signatures.append(signature(values, factors).tobytes() if len(values) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())], ["doc_id", "n_shingles", "set_key", "signature"])
        release(_hashes)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SKETCH)


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """The shingle set of every document, as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                step = batch.slice(at, _ROWS)
                sets = [shingles(text.as_py(), words).view(np.int64) for text in step.column(1)]
                yield pa.RecordBatch.from_arrays([step.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"])
        release(_hashes)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, shingles array<long>")


def prefix_postings(classes: DataFrame, ws: Workspace, threshold: int) -> DataFrame:
    """Postings (list_id, rep) of each class's prefix, in lists of two or more, no two with the same members."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = coordinate_values(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(values.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), values.shape[1]))], ["value_key", "rep"])

    postings = ws.save(classes.select("rep", "signature").mapInArrow(post, "value_key long, rep long"))
    shared = ws.save(postings.groupBy("value_key").agg(F.count("*").alias("n")).where("n > 1"))
    ranked = postings.join(shared, "value_key").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "value_key"))).alias("found"))
    rest = F.size("found") - threshold + 1
    prefix = ws.save(ranked.where(rest > 0).select("rep", F.explode(F.slice("found", F.lit(1), rest)).alias("p")).select("rep", F.col("p.value_key").alias("list_id")))
    ws.drop(postings)
    marks = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.min("rep").alias("low"), F.max("rep").alias("high")]
    lists = prefix.groupBy("list_id").agg(*marks).where("n > 1").groupBy("n", "x", "low", "high").agg(F.min("list_id").alias("list_id"))
    return ws.save(prefix.join(lists.select("list_id"), "list_id").select("list_id", "rep"))


def coordinate_values(signatures: pa.Array) -> np.ndarray:
    """A row per signature: its (coordinate, value) pairs as one number each."""
    values = np.frombuffer(b"".join(signatures.to_pylist()), "<u4").reshape(len(signatures), -1) if len(signatures) else np.empty((0, 1), "<u4")
    return values.astype(np.int64) | (np.arange(values.shape[1], dtype=np.int64) << 32)


DEALT = ("member_of", "one", "two", "block", "rep")


def first_look(sized: DataFrame) -> DataFrame:
    """Members (of, rep, n, hub) of groups as dealt for a first look: groups of one block whole, larger ones as each member with the hub.

    Spokes are dealt to ``ceil(n / _BLOCK)`` groups, to each of which the hub goes too, so a member is sent once.
    """
    parts, large = F.ceil(F.col("n") / _BLOCK).cast("int"), F.col("n") > _BLOCK
    part = F.when(large, 1 + F.pmod(F.xxhash64("rep"), parts)).otherwise(0).cast("int")
    once = sized.where(~large | (F.col("rep") != F.col("hub"))).select("of", F.lit(0).alias("one"), part.alias("two"), part.alias("block"), "rep")
    hubs = sized.where(large & (F.col("rep") == F.col("hub"))).distinct()
    hubs = hubs.select("of", F.lit(0).alias("one"), F.explode(F.sequence(F.lit(1), parts)).alias("two"), F.lit(0).alias("block"), "rep")
    return once.union(hubs).toDF(*DEALT)


def second_look(large: DataFrame, linked: DataFrame) -> DataFrame:
    """What a first look left open in groups (of, rep, n) of more than a block, given the components (node, component) it found.

    The largest component of a group is connected already: its members meet the others only, which meet all. A group of one component is done.
    """
    named = large.join(linked.withColumnsRenamed({"node": "rep", "component": "found"}), "rep", "left").withColumn("found", F.coalesce("found", "rep"))
    counts = named.groupBy("of", "found").agg(F.count("*").alias("m"))
    most = counts.groupBy("of").agg(F.max(F.struct("m", "found")).alias("most"))
    open_groups = named.join(most, "of").where("most.m < n")
    a, c = F.ceil(F.col("most.m") / _BLOCK).cast("int"), F.ceil((F.col("n") - F.col("most.m")) / _BLOCK).cast("int")
    inside, place = F.col("found") == F.col("most.found"), F.xxhash64("rep")
    block = F.when(inside, F.pmod(place, a)).otherwise(a + F.pmod(place, c)).cast("int")
    other = F.explode(F.sequence(F.when(inside, a).otherwise(0), a + c - 1))
    dealt = open_groups.select("of", "rep", block.alias("block"), other.alias("other"))
    return dealt.select("of", F.least("block", "other"), F.greatest("block", "other"), "block", "rep").toDF(*DEALT)


def connecting_links(members: DataFrame, group: str, sets: DataFrame, column: str, read: Callable[[pa.Array], list[np.ndarray]], enough: Callable[..., np.ndarray], ws: Workspace) -> DataFrame:
    """Links (src, dst) that connect whatever all links inside the groups of ``members`` (group, rep) connect.

    A group of up to ``_BLOCK`` members is compared whole. Of a larger one every member meets its smallest first, and only
    pairs that do not both belong to the largest component found so far are compared afterwards. What is sent then grows with
    the members, and with the product of those outside the largest component and the blocks of all.
    """
    sizes = members.groupBy(group).agg(F.count("*").alias("n"), F.min("rep").alias("hub"))
    sized = members.join(sizes, group).select(F.col(group).alias("of"), "rep", "n", "hub")
    first = ws.save(overlap_forest(first_look(sized), sets, column, read, enough))
    if sizes.where(F.col("n") > _BLOCK).isEmpty():
        return first
    rest = second_look(sized.where(F.col("n") > _BLOCK), connected_components(first, ws))
    return first.union(ws.save(overlap_forest(rest, sets, column, read, enough)))


def overlap_forest(dealt: DataFrame, sets: DataFrame, column: str, read: Callable[[pa.Array], list[np.ndarray]], enough: Callable[..., np.ndarray]) -> DataFrame:
    """Spanning forest (src, dst) of the links inside each dealt group.

    Members meet their sets (``column`` of ``sets``, by rep) and are brought together by group and pair of
    blocks; ``enough(shared, sizes_a, sizes_b)`` says which numbers of shared elements are links.
    """
    key = ["member_of", "one", "two"]
    together = dealt.join(sets.select("rep", column), "rep").repartition(*key).sortWithinPartitions(*key).select(*key, "block", "rep", column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, 3):
            block, rep, elements = group.column("block").to_numpy(), group.column("rep").to_numpy(), read(group.column(column).combine_chunks())
            one, two = group.column("one")[0].as_py(), group.column("two")[0].as_py()
            a = np.flatnonzero(block == one)
            b = a if one == two else np.flatnonzero(block == two)
            if len(rep) < 2 or not len(a) or not len(b):
                continue
            sizes = np.array([len(e) for e in elements])
            linked = np.zeros((len(rep), len(rep)), bool)
            linked[np.ix_(a, b)] = enough(shared_elements(elements, a, b), sizes[a][:, None], sizes[b][None])
            linked |= linked.T
            np.fill_diagonal(linked, False)
            edges = [(rep[g].min(), r) for g in linked_groups(linked) for r in rep[g] if r != rep[g].min()]
            if edges:
                src, dst = np.array(edges, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    return together.mapInArrow(run, "src long, dst long").distinct()


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of equal values in the first columns of sorted batches; holds one run and one batch at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        starts = [0, *new.tolist(), batch.num_rows]
        if held and any(held[-1].column(k)[-1].as_py() != columns[k][0] for k in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        for at, end in zip(starts[:-1], starts[1:], strict=True):
            if at:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, end - at))
    if held:
        yield pa.Table.from_batches(held)


def shared_elements(elements: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of elements that the sets of rows ``a`` and rows ``b`` share, by products of 0/1 matrices."""
    row = np.repeat(np.arange(len(elements)), [len(e) for e in elements])
    _, column, count = np.unique(np.concatenate(elements), return_inverse=True, return_counts=True)
    common = count > 1
    place = np.cumsum(common) - 1
    keep = common[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, int(common.sum()), _COLUMNS):
        lo, hi = np.searchsorted(column, [start, start + _COLUMNS])
        has = np.zeros((len(elements), min(_COLUMNS, int(common.sum()) - start)), np.float32)
        has[row[lo:hi], column[lo:hi] - start] = 1
        shared += has[a] @ has[b].T
    return shared.astype(np.int64)


def near_duplicates(docs: DataFrame, words: int = 5, similarity: Fraction = Fraction(4, 5)) -> DataFrame:
    """Components of ``docs`` (doc_id, text) under Jaccard similarity of word shingles.

    Returns a row per document: doc_id, n_shingles, component_id (smallest doc_id
    reachable), kept (doc_id = component_id). A text without words is linked with nothing; a row
    with a null doc_id is too, has no component and is kept. Rows with the same doc_id are one
    document, linked by any of their texts.
    """
    ws = Workspace(docs.sparkSession, "minhash")
    threshold, n, d = match_threshold(similarity), similarity.numerator, similarity.denominator
    sketches = ws.save(sketch(docs, words))
    can_link = "set_key IS NOT NULL AND doc_id IS NOT NULL"
    linkable = sketches.where(can_link)
    classes = ws.save(linkable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature")))

    lists = prefix_postings(classes, ws, threshold)
    candidates = connecting_links(lists, "list_id", classes, "signature", lambda c: list(coordinate_values(c)), lambda shared, a, b: shared >= threshold, ws)
    close = ws.save(connected_components(candidates, ws))

    wanted = close.select(F.col("node").alias("doc_id"))
    sets = ws.save(full_sets(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi"), words).withColumnRenamed("doc_id", "rep"))
    members = close.select(F.col("component").alias("near"), F.col("node").alias("rep"))
    links = connecting_links(members, "near", sets, "shingles", as_sets, lambda shared, a, b: shared * d >= (a + b - shared) * n, ws)
    component = ws.save(connected_components(links, ws))

    named = classes.select("set_key", "rep").join(component.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("linked"))
    placed = linkable.join(named, "set_key").select("doc_id", "n_shingles", F.col("linked").alias("component_id"))
    alone = sketches.where(f"NOT ({can_link})").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))  # never dealt by a null key
    return placed.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def as_sets(column: pa.ListArray) -> list[np.ndarray]:
    values, ends = column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())
    return np.split(values, ends[:-1])
