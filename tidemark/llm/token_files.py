"""Token-id output: flat unsigned integer files with 64-bit document offsets.

``write_token_files`` deals documents out by ranges of ascending id. Each task writes
three files: ``.bin``, the ids one after another; ``.ids``, an Arrow file with the
document ids and lengths; and, once the partition bases are known from a prefix sum
over the manifest, ``.off``, n + 1 unsigned 64-bit offsets into the whole corpus.
``read_token_files`` maps them into memory again.

Files have names of their own per attempt, and the manifest lists those of committed
tasks only, so repeated or lost tasks leave nothing that a reader would see.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vocab import encoder
from .workspace import Workspace, open_fs

_STEP = 256
MANIFEST = "part int, file string, width int, n_docs long, n_tokens long"
DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_token_files(docs: DataFrame, ws: Workspace, tokenizer: str, end_id: int, special_as_text: bool = False, ordered: bool = True, index: bool = True) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text); returns the manifest with bases.

    ordered: whether documents go by ascending doc_id, for which texts are shuffled; else each task
    writes the rows it reads. index: whether offsets are written too; without them files are a plain stream of ids.

    Columns: part, file (URI without suffix), width (bytes of an id), n_docs, n_tokens, base
    (ids in earlier files). A null or empty text is a document of ``end_id`` alone; repeated
    rows are documents of their own; null doc_ids come first. An empty table gives no file.
    """
    folder = ws.folder("tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, special_as_text)
        end = np.array([end_id], enc.dtype).tobytes()
        size = enc.dtype.itemsize
        filesystem, path = open_fs(f"{folder}/{uuid.uuid4().hex}")
        ids, lengths = [], []
        with filesystem.open_output_stream(f"{path}.bin") as out:
            for batch in batches:
                for at in range(0, batch.num_rows, _STEP):
                    piece = batch.slice(at, _STEP)
                    coded = enc.encode(piece.column(1).to_pylist())
                    ids.append(piece.column(0))
                    lengths += [len(c) // size + 1 for c in coded]
                    out.write(end.join([*coded, b""]))
        if not lengths:
            filesystem.delete_file(f"{path}.bin")
            return
        side = pa.table([pa.chunked_array(ids), pa.array(lengths, pa.int64())], ["doc_id", "n_tokens"])
        with filesystem.open_output_stream(f"{path}.ids") as out, pa.ipc.new_file(out, side.schema) as writer:
            writer.write_table(side)
        row = [TaskContext.get().partitionId(), f"{folder}/{path.rsplit('/', 1)[1]}", size, len(lengths), sum(lengths)]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["part", "file", "width", "n_docs", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    if ordered:
        rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    manifest = ws.save(rows.mapInArrow(write, MANIFEST))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    manifest = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    if not index:
        return ws.save(manifest)

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                filesystem, path = open_fs(row["file"])
                with filesystem.open_input_file(f"{path}.ids") as f:
                    lengths = pa.ipc.open_file(f).read_all().column("n_tokens").to_numpy()
                starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8") + np.uint64(row["base"])
                with filesystem.open_output_stream(f"{path}.off") as out:
                    out.write(starts.tobytes())
            yield batch

    return ws.save(spread(manifest).mapInArrow(offsets, MANIFEST + ", base long"))


def spread(manifest: DataFrame) -> DataFrame:
    """A manifest of one row a file, one file a task."""
    return manifest.repartition(max(1, manifest.count()))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32-bit)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                filesystem, path = open_fs(row["file"])
                with filesystem.open_input_file(f"{path}.ids") as f:
                    doc_ids = pa.ipc.open_file(f).read_all().column("doc_id").combine_chunks()
                starts = flat(filesystem, f"{path}.off", "<u8").astype(np.int64)
                ids = flat(filesystem, f"{path}.bin", f"<u{row['width']}")
                at = starts - starts[0]
                crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spread(manifest).mapInArrow(read, DIGEST)


def flat(filesystem: pafs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """A flat file as an array: memory-mapped where the file system is a mounted one."""
    if filesystem.get_file_info(path).size == 0:
        return np.empty(0, dtype)
    if isinstance(filesystem, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with filesystem.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype)


def token_file_digest(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes ``docs`` as token files and returns what the files hold (see ``read_token_files``)."""
    ws = Workspace(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, ws, tokenizer, end_id))
