"""Mixing sources to target weights by Pfair scheduling.

Documents of a source, laid end to end, fill blocks of ``block_chars`` characters. Block j of a source
of weight n, of q in all, is released at slot floor(jq/n) and due at slot ceil((j+1)q/n); at each slot the
released block with the earliest deadline goes next. Weights sum to q, so every deadline is met
and no source is ever a whole block ahead of or behind its weight, however long the run: n and q are
the weights themselves in units of 2^-52 of their sum, and windows are exact integers.

The driver schedules the blocks of the whole run with two heaps, from one number of characters a source:
a source and a block cost it a heap entry each, in time by the logarithm of the number of sources. Blocks are
``block_chars`` long, doubled until all sources together have at most ``BLOCKS`` of them, so the schedule is
bounded whatever the corpus; the guarantee is one block of that length.

Sources that end early leave their slots empty, and the others go on in their proportions:
nothing is dropped or repeated. Sources of weight zero follow when the others have ended, in equal shares.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from heapq import heapify, heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

BLOCK_CHARS, BLOCKS, CYCLE, POWER, UNIT = 1 << 16, 1 << 20, 1000, 0.5, 1 << 52
#: Rows of a source that are sorted together, about, and the least number of such groups.
GROUP_ROWS, SALTS = 20_000, 256
#: Slots of a file written in mixture order, about.
STRETCH = 512


def source_key(source: Column | str = "source") -> Column:
    """A null source is a source of its own."""
    source = F.col(source) if isinstance(source, str) else source
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _salt(rows: int) -> Column:
    """Spreads a source's documents, by a congruential step on the id; those without one by their text."""
    salts = max(SALTS, -(-rows // GROUP_ROWS))
    return F.expr(f"pmod(pmod(coalesce(doc_id, xxhash64(text)), 2147483647) * 48271, 2147483647) % {salts}")


def shares(totals: DataFrame, weights: Mapping[str, float] | None, cycle: int, power: float) -> DataFrame:
    """The exact share n / q of each source (key, chars): key, chars, n, q.

    Without ``weights`` a source weighs chars^power. Sources that ``weights`` does not name weigh nothing; if none
    weighs anything all weigh the same. No share depends on ``cycle``, as no cycle is repeated.
    """
    if weights is None:
        weight = F.pow(F.greatest(F.col("chars"), F.lit(1)).cast("double"), F.lit(float(power)))
    else:
        named = [x for s, w in weights.items() for x in (F.lit(f"={s}"), F.lit(float(w)))]
        weight = F.coalesce(F.create_map(*named)[F.col("key")], F.lit(0.0)) if named else F.lit(0.0)
    weighed = totals.withColumn("weight", weight)
    weighed = weighed.crossJoin(F.broadcast(weighed.agg(F.sum("weight").alias("all"), F.count("*").alias("m"))))
    exact = F.when(F.col("all") > 0, F.col("weight") / F.col("all")).otherwise(1 / F.col("m"))
    cut = weighed.withColumn("n", F.when(exact > 0, F.greatest(F.lit(1), F.round(exact * UNIT))).otherwise(0).cast("long"))
    return cut.crossJoin(F.broadcast(cut.agg(F.sum("n").alias("q")))).select("key", "chars", "n", "q")


def earliest_deadline_first(sources: list[tuple[int, int]], start: int = 0) -> Iterator[tuple[int, int, int, int, int]]:
    """Places the blocks of sources (weight, blocks) from slot ``start``: source, block, release, deadline, slot."""
    q = sum(n for n, _ in sources)
    waiting, ready, slot = [(0, k, 0) for k, (_, blocks) in enumerate(sources) if blocks], [], 0
    heapify(waiting)
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, k, j = heappop(waiting)
            heappush(ready, (-(-(j + 1) * q // sources[k][0]), k, j, release))
        due, k, j, release = heappop(ready)
        yield k, j, start + release, start + due, start + slot
        slot += 1
        if j + 1 < sources[k][1]:
            heappush(waiting, ((j + 1) * q // sources[k][0], k, j + 1))


def block_length(shared: DataFrame, block_chars: int, blocks: int) -> int:
    """``block_chars``, doubled until sources (key, chars) have at most ``blocks`` blocks, or one each."""
    while True:
        n, longest = shared.agg(F.sum(F.expr(f"chars div {block_chars}")), F.max("chars")).first()
        if not longest or n <= blocks or block_chars > longest:
            return block_chars
        while n > blocks:  # the count falls by half or more
            block_chars, n = block_chars * 2, n // 2


def schedule_blocks(shared: DataFrame, block_chars: int, ws: Workspace) -> DataFrame:
    """The place of every block in the run: key, block, release, deadline, slot. A source has one block at least."""
    rows = shared.selectExpr("key", "n", f"chars div {block_chars} + 1 AS blocks").orderBy("key").collect()
    placed, after = [], 0
    for group, equal in (([r for r in rows if r["n"]], False), ([r for r in rows if not r["n"]], True)):
        for k, *place in earliest_deadline_first([(1 if equal else r["n"], r["blocks"]) for r in group], after):
            placed.append((group[k]["key"], *place))
        after = placed[-1][-1] + 1 if placed else 0
    return ws.save(shared.sparkSession.createDataFrame(placed, "key string, block long, release long, deadline long, slot long"))


PLACE = ("chars", "start", "block", "release", "deadline", "slot")


def placed_rows(docs: DataFrame, weights: Mapping[str, float] | None, block_chars: int, cycle: int, power: float, blocks: int, kept: tuple[str, ...] = ("*",)) -> tuple[DataFrame, int]:
    """Two structs a row of ``docs``: ``row``, its ``kept`` columns as they are, and ``mix``, its place; and how many slots there are. No name of a column can clash."""
    ws = Workspace(docs.sparkSession, "mixing")
    chars = F.length(F.coalesce("text", F.lit(""))).cast("long")
    rows = docs.select(F.struct(*kept).alias("row"), source_key().alias("key"), _salt(docs.count()).alias("salt"), "doc_id", chars.alias("chars"))
    parts = ws.save(rows.groupBy("key", "salt").agg(F.sum("chars").alias("chars")))
    totals = parts.groupBy("key").agg(F.sum("chars").alias("chars"))
    block_chars = block_length(totals, block_chars, blocks)
    schedule = schedule_blocks(shares(totals, weights, cycle, power), block_chars, ws)
    earlier = Window.partitionBy("key").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = ws.save(parts.select("key", "salt", F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("base")))

    inside = Window.partitionBy("key", "salt").orderBy("doc_id", "chars").rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("within", F.coalesce(F.sum("chars").over(inside), F.lit(0)))
    started = within.join(bases, ["key", "salt"]).withColumn("start", F.col("base") + F.col("within"))
    started = started.withColumn("block", F.expr(f"start div {block_chars}"))
    placed = started.join(F.broadcast(schedule), ["key", "block"])  # at most BLOCKS rows besides one a source
    return placed.select("row", F.struct(*PLACE).alias("mix")), (schedule.agg(F.max("slot")).first()[0] or 0) + 1


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, block_chars: int = BLOCK_CHARS, cycle: int = CYCLE, power: float = POWER, blocks: int = BLOCKS) -> DataFrame:
    """``docs`` (doc_id, source, text, any others) with its place in the mixture.

    Adds mix_chars, mix_start (characters of the source before the document), mix_block (of its source, where it
    starts), mix_release, mix_deadline and mix_slot of that block; columns of these names
    are replaced. Order the mixture by mix_slot, then mix_start. Null texts have no characters; ties and
    repeated rows are placed one after another; rows with a null source are one source; an
    empty table gives no rows.
    """
    placed, _ = placed_rows(docs, weights, block_chars, cycle, power, blocks)
    names = [f"mix_{c}" for c in PLACE]
    return placed.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in names), *(F.col("mix")[c].alias(n) for c, n in zip(PLACE, names, strict=True)))


def mixture_plan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, source, chars, block, release, deadline, slot, start."""
    placed, _ = placed_rows(docs, None, BLOCK_CHARS, CYCLE, POWER, BLOCKS, kept=("doc_id", "source"))  # texts stay where they are read
    return placed.select("row.doc_id", "row.source", *(F.col("mix")[c].alias(c) for c in ("chars", "block", "release", "deadline", "slot", "start")))


def in_mixture_order(docs: DataFrame) -> DataFrame:
    """``docs`` in the order of the mixture: stretches of slots, one after another across the files written. Columns stay as they are.

    Slots hold a block each, so equal stretches of them are equal shares of the text, and no row has to be sampled to find them.
    """
    order = ["mix.slot", "mix.start"]
    placed, slots = placed_rows(docs, None, BLOCK_CHARS, CYCLE, POWER, BLOCKS)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), slots // STRETCH)
    stretch = F.expr(f"mix.slot * {parts} div {max(1, slots)}").cast("int")
    return placed.repartitionById(parts, stretch).sortWithinPartitions(*order).select("row.*")
