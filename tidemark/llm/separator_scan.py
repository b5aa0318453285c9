"""Token counts by a separator scan over flat token files without an index.

The files of a corpus, in order, are one stream of ids in which a separator ends each document. Tasks
search fixed blocks of the stream for the separator, vectorised. What a block cannot know,
where its first document began and how many documents came before, is a prefix scan over the
block totals, first within each file and then over files; documents may cross blocks and files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .token_files import flat, write_token_files
from .workspace import Workspace, open_fs

BLOCK = 1 << 20
_PER_TASK = 64
FOUND = "part int, block long, n_ids long, ends array<int>"


def scan_blocks(files: DataFrame, separator: int, block: int = BLOCK) -> DataFrame:
    """Separators of each block of ``files`` (part, file, width, n_tokens): their places in the block."""
    counts = F.expr(f"sequence(0L, (n_tokens - 1) div {block})")
    blocks = files.where("n_tokens > 0").select("part", "file", "width", "n_tokens", F.explode(counts).alias("block"))
    n = blocks.count()
    busy = 3 * files.sparkSession.sparkContext.defaultParallelism
    blocks = blocks.repartition(max(1, min(n, busy), -(-n // _PER_TASK)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                filesystem, path = open_fs(row["file"])
                at = row["block"] * block
                n = min(block, row["n_tokens"] - at)
                ids = read_ids(filesystem, f"{path}.bin", row["width"], at, n)
                ends = np.flatnonzero(ids == separator).astype(np.int32)
                columns = [pa.array([row["part"]], pa.int32()), pa.array([row["block"]]), pa.array([n], pa.int64()), pa.array([ends], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["part", "block", "n_ids", "ends"])

    return blocks.mapInArrow(search, FOUND)


def read_ids(filesystem, path: str, width: int, at: int, n: int) -> np.ndarray:
    """``n`` ids of a flat file from ``at``: mapped where the file is local, else read as one range."""
    if hasattr(filesystem, "open_input_file") and filesystem.type_name != "local":
        with filesystem.open_input_file(path) as f:
            return np.frombuffer(f.read_at(n * width, at * width), f"<u{width}")
    return flat(filesystem, path, f"<u{width}")[at : at + n]


def stitch(found: DataFrame, ws: Workspace) -> DataFrame:
    """Documents of the stream: part, place (in that file's separators), doc_index, start, n_tokens, closed.

    n_tokens leaves the separator out. Ids after the last separator are a document that is not closed.
    """
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.size("ends") > 0, F.element_at("ends", -1) + 1)
    sums = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("long")
    local = found.withColumns({"n_ends": F.size("ends"), "before": sums("n_ids", inside)})
    local = local.withColumn("last", F.col("before") + last)
    local = ws.save(local.withColumns({"ends_before": sums("n_ends", inside), "open_from": F.max("last").over(inside)}))

    files = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    totals = local.groupBy("part").agg(F.sum("n_ids").alias("n_ids"), F.sum("n_ends").alias("n_ends"), F.max("last").alias("last"))
    totals = totals.withColumns({"base": sums("n_ids", files), "ends_base": sums("n_ends", files)})
    totals = totals.withColumn("last", F.col("base") + F.col("last"))
    totals = ws.save(totals.withColumn("open_base", F.coalesce(F.max("last").over(files), F.lit(0))))

    blocks = local.drop("last").join(totals.select("part", "base", "ends_base", "open_base"), "part")
    origin = F.col("base") + F.col("before")
    first = F.coalesce(F.col("base") + F.col("open_from"), "open_base")
    ends = blocks.select("part", "ends_before", "ends_base", origin.alias("origin"), first.alias("first"), "ends", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("first")).otherwise(F.col("origin") + F.get("ends", F.col("k") - 1) + 1)
    place = F.col("ends_before") + F.col("k")
    closed = ends.select("part", place.alias("place"), (F.col("ends_base") + place).alias("doc_index"), start.alias("start"), (F.col("origin") + F.col("end") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    whole = totals.agg(F.sum("n_ids").alias("n"), F.sum("n_ends").alias("docs"), F.coalesce(F.max("last"), F.lit(0)).alias("start")).where("n > start")
    rest = whole.select(F.lit(None).cast("int").alias("part"), F.lit(None).cast("long").alias("place"), F.col("docs").alias("doc_index"), "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def count_tokens(docs: DataFrame, tokenizer: str, separator: int, block: int = BLOCK) -> DataFrame:
    """Writes ``docs`` (doc_id, text) as a token stream and counts its documents' tokens by scanning it.

    Returns doc_id, doc_index (place in the stream), start, n_tokens (without the separator), closed. The
    strings of special tokens in a text are ordinary text, so the separator ends documents only. Null and
    empty texts count 0; repeated rows and null doc_ids are documents of their own; an empty table
    gives no rows. Ids come from the writer's list of documents, boundaries from the scan alone.
    """
    ws = Workspace(docs.sparkSession, "separators")
    files = write_token_files(docs, ws, tokenizer, separator, special_as_text=True, ordered=False, index=False)
    counted = stitch(scan_blocks(files, separator, block), ws)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                filesystem, path = open_fs(row["file"])
                with filesystem.open_input_file(f"{path}.ids") as f:
                    ids = pa.ipc.open_file(f).read_all().column("doc_id").combine_chunks()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["part"], np.int32)), pa.array(np.arange(len(ids))), ids], ["part", "place", "doc_id"])

    named = files.repartition(max(1, files.count())).mapInArrow(names, "part int, place long, doc_id long")
    # a row per document, though its manifest is small: never a side to broadcast
    return counted.join(named.hint("merge"), ["part", "place"], "left").select("doc_id", "doc_index", "start", "n_tokens", "closed")
