"""Best-fit packing of documents into fixed-length sequences by a configuration LP.

Tasks encode whole texts and cut only what is longer than a sequence. What the planner
sees is the histogram of piece lengths, at most ``capacity`` numbers whatever the corpus:

1. The covering LP starts at prices equal to size, whose bound is the volume. A knapsack dynamic program
   prices configurations (multisets of lengths that fit one sequence), and whole sequences are taken of
   those that are best at the prices, by growing shares. A plan within ``GAP`` of the bound ends the search.
2. Otherwise the LP goes on by multiplicative weights. What a longer piece fits a shorter one fits, so the rows of
   the LP are the pieces of at least each length, prices grow with the length, and a row that the best
   configurations cover less than others gains weight. Any prices give a lower bound; rounds end when the
   fractional packing is within ``GAP`` of it, or after ``ROUNDS``.
3. The fractional solution is rounded, the rest solved again, and what remains placed best-fit; and shares are
   taken at the prices of the best bound. The plan with the fewest sequences is used, plain best fit only if it has fewer still.

The plan is a few thousand (configuration, multiplicity) pairs, broadcast to place each
piece by its rank among the pieces of its length. Ranks are a count inside a stretch of rows plus
a prefix sum over stretches, so a length that a third of all pieces share is no hot group.

Sequences keep the order of the rows. The run is dealt into stretches of about ``STRETCH`` sequences, each
with its share of every configuration, and ranks go through them in turn: up to any stretch every length
has given its share of pieces, to within one piece for each configuration that holds it.
Rows read from files go by file and place; others by partition.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vocab import encoder
from .workspace import Workspace

Config = tuple[int, ...]
PIECE = "part int, run int, file string, at long, rank long, doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_STEP, _GATHER, _CELLS = 256, 32_768, 1 << 20
#: Sequences of a stretch, and most stretches.
STRETCH, STRETCHES = 256, 1 << 20
#: Most rounds of the LP, rounds without a better bound that halve the steps, how often they are halved, rounds of its rests, rounds of shares; gap to a lower bound that ends them; what counts as a best configuration, and in the first round; steps.
ROUNDS, PATIENCE, HALVINGS, REPEATS, SHARES, GAP, SLACK, LOOSE, RATE = 240, 24, 5, 8, 24, 0.0005, 0.002, 0.5, 0.5


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of every document (doc_id, text), each with its run of rows and its rank there among its length.

    A run is the rows that a task reads from one split of a file, or all its rows if they come from no file. A null or
    empty text is one piece with the end id alone; repeated rows are packed each for itself; a null doc_id
    stays null.
    """
    types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    names = [field.split()[0] for field in PIECE.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], enc.dtype)
        seen: Counter[int] = Counter()
        split, run = None, -1
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                step = batch.slice(at, _STEP)
                rows = []
                doc_ids, texts, *splits = (c.to_pylist() for c in step.columns)
                for doc_id, coded, here in zip(doc_ids, enc.encode(texts), zip(*splits, strict=True), strict=True):
                    if here != split:
                        split, run, seen = here, run + 1, Counter()
                    ids = np.concatenate([np.frombuffer(coded, enc.dtype), end]).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        piece = ids[start : start + capacity]
                        rows.append((part, run, *here, seen[len(piece)], doc_id, k, start, len(piece), zlib.crc32(piece.tobytes())))
                        seen[len(piece)] += 1
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

    split = F.input_file_name().alias("file"), F.input_file_block_start().alias("at")
    return docs.select(F.col("doc_id").cast("long"), "text", *split).mapInArrow(cut, PIECE)


def price_configs(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: best value of each capacity, and the length added last (0: slack); of equal values the longest."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    lengths = np.flatnonzero(prices)[::-1]
    worth, shortest = prices[lengths], -lengths
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        k = np.searchsorted(shortest, -c)
        if k < len(lengths):
            values = best[c - lengths[k:]]
            values += worth[k:]
            top = values.argmax()
            if values[top] > best[c]:
                best[c], last[c] = values[top], lengths[k + top]
    return best, last


def config_with(length: int, last: np.ndarray, capacity: int) -> Config:
    """The best configuration that holds ``length``, longest first."""
    config, c = [length], capacity - length
    while c > 0:
        if last[c]:
            config.append(int(last[c]))
            c -= int(last[c])
        else:
            c -= 1
    return tuple(sorted(config, reverse=True))


def fill(left: np.ndarray, prices: np.ndarray, last: np.ndarray, best: np.ndarray, capacity: int, slack: float) -> dict[Config, float]:
    """A packing of at most ``left`` pieces by configurations whose value is within ``slack`` of the best one."""
    uses: dict[Config, float] = defaultdict(float)
    left = left.astype(float)
    for length in np.flatnonzero(left)[::-1]:
        if left[length] <= 0 or prices[length] + best[capacity - length] < (1 - slack) * best[capacity]:
            continue
        need = Counter(config := config_with(int(length), last, capacity))
        if (step := min(left[v] / a for v, a in need.items())) > 0:
            uses[config] += step
            for v, a in need.items():
                left[v] -= a * step
    return uses


def solve_lp(counts: np.ndarray, capacity: int, prices: np.ndarray | None = None, rounds: int = ROUNDS, gap: float = GAP) -> tuple[dict[Config, float], np.ndarray, float]:
    """The covering LP by multiplicative weights: a fractional packing, the prices of its best bound, and that bound.

    There is a row for the pieces of at least each length, and a length's price is the sum of the weights of the rows it is in. Prices
    start at the sizes, whose bound is the volume. A round packs what the counts allow by the configurations that are best at the prices;
    then rows that it covered less than others gain weight. Any prices bound every packing from below: the counts at these
    prices, over the value of the best configuration. The packing is the mean of the later rounds, scaled until all is covered;
    rounds end when it is within ``gap`` of the bound. Where the bound does not rise for ``PATIENCE`` of them, they go on from its prices
    with half the step, ``HALVINGS`` times.
    """
    lengths = np.flatnonzero(counts)
    demand = counts[lengths].astype(float)
    at_least = lambda x: np.cumsum(x[::-1])[::-1]
    rows = at_least(demand)
    start = lengths / capacity if prices is None else np.maximum.accumulate(prices[lengths])
    weights = np.diff(start, prepend=0.0)
    bound, better, rate, since, mean = 0.0, 0, RATE, 0, np.zeros(len(lengths))
    at_bound = np.zeros(capacity + 1)
    done: list[dict[Config, float]] = []
    covered: list[np.ndarray] = []
    for k in range(rounds):
        y = np.zeros(capacity + 1)
        y[lengths] = np.cumsum(weights)
        best, last = price_configs(y, capacity)
        if (value := float(demand @ y[lengths]) / best[capacity]) > bound:
            better = k if value > bound * (1 + gap / 10) else better
            bound, at_bound, best_weights = value, y, weights
        uses = fill(counts, y, last, best, capacity, max(SLACK, LOOSE / (k + 1)))
        share = np.zeros(capacity + 1)
        for config, x in uses.items():
            for v in config:
                share[v] += x
        done.append(uses)
        covered.append(at_least(share[lengths]) / rows)
        since = (k + 1) // 2
        mean = sum(covered[since:])
        if (least := mean.min()) > 0 and sum(sum(u.values()) for u in done[since:]) / least <= bound * (1 + gap):
            break
        if k - better >= PATIENCE:
            better, rate, weights = k, rate / 2, best_weights
            if rate < RATE / 2**HALVINGS:
                break
            continue
        worth = weights * rows
        weights = weights * np.exp(-rate * (covered[-1] - worth @ covered[-1] / worth.sum()) / covered[-1].max())
    mixed: dict[Config, float] = defaultdict(float)
    for uses in done[since:]:
        for config, x in uses.items():
            mixed[config] += x
    worth = np.diff(at_bound[lengths], prepend=0.0) * rows
    scale = mean.min() if mean.min() > 0 else worth @ mean / worth.sum()  # rounding sees to the rest
    return {config: x / scale for config, x in mixed.items()}, at_bound, bound


def take(counts: np.ndarray, config: Config, most: int, plan: Counter[Config]) -> int:
    """Uses ``config`` at most ``most`` times, as often as the counts allow."""
    need = Counter(config)
    if whole := min(int(most), *(int(counts[v]) // a for v, a in need.items())):
        plan[config] += whole
        for v, a in need.items():
            counts[v] -= a * whole
    return whole


def by_lp(counts: np.ndarray, capacity: int, uses: dict[Config, float], prices: np.ndarray, rounds: int = ROUNDS // 12) -> Counter[Config]:
    """An LP solution in whole sequences: rounded down, then up while it fits, the LP of the rest again, and so on."""
    counts, plan = counts.copy(), Counter()
    for _ in range(REPEATS):
        placed = 0
        for config, x in uses.items():
            placed += take(counts, config, int(x + 1e-9), plan)
        for config, _ in sorted(uses.items(), key=lambda u: (int(u[1] + 1e-9) - u[1], u[0])):
            placed += take(counts, config, 1, plan)
        if not placed or not counts.any():
            break
        uses, prices, _ = solve_lp(counts, capacity, prices, rounds)
    return plan + best_fit({int(v): int(counts[v]) for v in np.flatnonzero(counts)}, capacity)


def by_shares(counts: np.ndarray, capacity: int, prices: np.ndarray) -> Counter[Config]:
    """Whole sequences of configurations that are best at the prices, by growing shares of what is left; then best fit."""
    counts, plan = counts.copy(), Counter()
    for k in range(SHARES):
        if not counts.any():
            break
        best, last = price_configs(np.where(counts > 0, prices, 0), capacity)
        if not best[capacity]:
            break
        for length in np.flatnonzero(counts)[::-1]:
            if counts[length] and prices[length] + best[capacity - length] >= (1 - SLACK) * best[capacity]:
                config = config_with(int(length), last, capacity)
                most = min(int(counts[v]) // a for v, a in Counter(config).items())
                take(counts, config, -(-most // (SHARES - k)), plan)
    return plan + best_fit({int(v): int(counts[v]) for v in np.flatnonzero(counts)}, capacity)


def plan_packing(histogram: dict[int, int], capacity: int) -> list[tuple[Config, int]]:
    """Configurations and how many sequences use each, for exactly the pieces of the histogram."""
    return plan_and_bound(histogram, capacity)[0]


def plan_and_bound(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[Config, int]], int]:
    """The plan, and a number of sequences that no plan can go below.

    Plans of the LP in turn until one is within ``GAP`` of the bound: shares at size prices, the rounded LP, shares at the prices of
    its bound. The one with the fewest sequences is taken, and plain best fit if that has fewer still.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    plan: Counter[Config] = Counter()
    if counts[capacity]:
        plan[(capacity,)] = int(counts[capacity])
        counts[capacity] = 0
    whole = plan.total()
    if not counts.any():
        return sorted(plan.items()), whole
    sizes = np.arange(capacity + 1)
    near = lambda p, bound: p.total() <= np.ceil(bound * (1 - 1e-9)) * (1 + GAP)
    bound = counts @ sizes / capacity
    rest = by_shares(counts, capacity, sizes / capacity)
    if not near(rest, bound):
        uses, prices, bound = solve_lp(counts, capacity)
        for solve in (lambda: by_lp(counts, capacity, uses, prices), lambda: by_shares(counts, capacity, prices)):
            if not near(rest, bound):
                rest = min(rest, solve(), key=Counter.total)
    if rest.total() > np.ceil(bound * (1 - 1e-9)):
        rest = min(rest, best_fit({int(v): int(counts[v]) for v in np.flatnonzero(counts)}, capacity), key=Counter.total)
    return sorted((plan + rest).items()), whole + int(np.ceil(bound * (1 - 1e-9)))


def best_fit(histogram: dict[int, int], capacity: int) -> Counter[Config]:
    """Best-fit decreasing on a histogram: sequences with the same contents move together.

    Contents are kept as chains (what they were before, length, how many of it) and written out at the end.
    """
    Chain = tuple[object, int, int] | None
    open_bins: dict[int, list[tuple[Chain, int]]] = defaultdict(list)
    spaces: list[int] = []

    def put(chain: Chain, space: int, n: int) -> None:
        if not open_bins[space]:
            insort(spaces, space)
        open_bins[space].append((chain, n))

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                each = min(capacity // length, n)
                bins = n // each
                put((None, length, each), capacity - each * length, bins)
                n -= bins * each
                continue
            space = spaces[at]
            chain, bins = open_bins[space].pop()
            each = min(space // length, n)
            used = min(bins, n // each)
            if bins > used:
                open_bins[space].append((chain, bins - used))
            elif not open_bins[space]:
                spaces.pop(at)
            put((chain, length, each), space - each * length, used)
            n -= used * each

    plan: Counter[Config] = Counter()
    for bins in open_bins.values():
        for chain, n in bins:
            config: list[int] = []
            while chain is not None:
                chain, length, each = chain
                config += [length] * each
            plan[tuple(reversed(config))] += n
    return plan


class Places(NamedTuple):
    """Where a length goes: for each place in a configuration its number of uses, its configuration and the offset."""

    uses: np.ndarray
    config: np.ndarray
    offset: np.ndarray


class Dealing(NamedTuple):
    """A plan as dealt to stretches: stretch g of G takes uses [g n // G, (g + 1) n // G) of a configuration with n."""

    places: dict[int, Places]
    stretches: int
    configs: int
    most: int  # uses of one configuration in one stretch

    def of(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces of a length with these ranks."""
        uses, config, offset = self.places[length]
        before = lambda g: (g[:, None] * uses // self.stretches).sum(axis=1)
        low, high = np.zeros_like(ranks), np.full_like(ranks, self.stretches)
        while (high - low > 1).any():
            middle = (low + high) // 2
            reached = before(middle) <= ranks
            low, high = np.where(reached, middle, low), np.where(reached, high, middle)
        first = low[:, None] * uses // self.stretches
        taken = (low[:, None] + 1) * uses // self.stretches - first
        ends, left = np.cumsum(taken, axis=1), ranks - first.sum(axis=1)
        k = (ends <= left[:, None]).sum(axis=1)
        nth = left - np.take_along_axis(ends - taken, k[:, None], axis=1)[:, 0]
        return (low * self.configs + config[k]) * self.most + nth, offset[k]


def deal(plan: list[tuple[Config, int]]) -> Dealing:
    total = sum(n for _, n in plan)
    stretches = min(STRETCHES, max(1, total // STRETCH))
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for k, (config, n) in enumerate(plan):
        offset = 0
        for length in config:
            found[length].append((n, k, offset))
            offset += length
    places = {length: Places(*np.array(rows, np.int64).T) for length, rows in found.items()}
    return Dealing(places, stretches, len(plan), max((n for _, n in plan), default=0) // stretches + 1)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096) -> DataFrame:
    """Packs ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Sequence ids have gaps; their
    order is that of the rows, by stretches. An empty table gives no rows. See ``cut_pieces`` for nulls and
    repeats; pieces of equal length are taken in the order of the rows.
    """
    ws = Workspace(docs.sparkSession, "packing")
    pieces = ws.save(cut_pieces(docs, tokenizer, end_id, capacity))
    per_run = ws.save(pieces.groupBy("part", "run", "length").agg(F.count("*").alias("n"), F.first("file").alias("file"), F.first("at").alias("at")))
    totals = per_run.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `capacity` rows
    dealing = docs.sparkSession.sparkContext.broadcast(deal(plan_packing({r["length"]: r["n"] for r in totals}, capacity)))

    earlier = Window.partitionBy("length").orderBy(F.length("file"), "file", "at", "part", "run").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_run.select("part", "run", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, _GATHER):
            lengths, ranks = (table.column(c).to_numpy() for c in ("length", "rank"))
            order = np.argsort(lengths, kind="stable")
            sequence, offset = np.empty_like(ranks), np.empty_like(ranks)
            for mine in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                length = int(lengths[mine[0]])
                step = max(1, _CELLS // len(dealing.value.places[length].uses))
                for k in range(0, len(mine), step):
                    some = mine[k : k + step]
                    sequence[some], offset[some] = dealing.value.of(length, ranks[some])
            kept = [table.column(c).combine_chunks() for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # a row a run and length grows with the files: never a side to broadcast
    ranked = pieces.join(bases.hint("merge"), ["part", "run", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PACKED)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to tables of about ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)
