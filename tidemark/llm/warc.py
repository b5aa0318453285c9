"""WARC archives: writing, and the monolithic gzip normaliser.

``normalise`` takes archives compressed as one gzip stream, in which no record can be
reached without inflating all before it. One task per file inflates the stream once,
writes every record as a gzip member of its own and leaves a sidecar index (``.cdx``, an
Arrow file: record id, type, offset, length), by which ``read_records`` fetches members.

Which page is a ``response`` and which a ``revisit`` of an equal payload is decided on
digests alone; payloads are never shuffled for it. Every attempt writes to files of its
own, and only manifests of committed tasks are read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_files import spread
from .workspace import Workspace, open_fs

MANIFEST = "file string, n_records long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
_BLOCK, _LEVEL = 1 << 20, 6
_GZIP = zlib.MAX_WBITS | 16
_ID = "urn:page:"


def payload_roles(pages: DataFrame, min_bytes: int) -> DataFrame:
    """The revisits among ``pages`` (page_id, html): page_id, digest (hex SHA-1), refers_to.

    Of equal payloads of ``min_bytes`` or more, the smallest page_id is the response; rows
    that repeat that very page_id are responses too. Rows without a page_id refer to it.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    digests = pages.where(F.octet_length(payload) >= min_bytes).select("page_id", F.sha1(payload).alias("digest"))
    firsts = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return digests.join(firsts, "digest").where("page_id IS DISTINCT FROM refers_to").distinct()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit keeps the HTTP header of its page but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or 'about:blank', safe=':/?#[]@!$&()*+,;=%~' + chr(39))}",
        f"WARC-Payload-Digest: sha1:{b32encode(hashlib.sha1(payload).digest()).decode()}",
        *([f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{_ID}{'' if refers_to is None else refers_to}>"] if revisit else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def write_monolithic(pages: DataFrame, ws: Workspace, min_bytes: int = 0) -> DataFrame:
    """Archives ``pages`` (page_id, url, html), one gzip stream a task; returns the manifest.

    A null html is an empty payload, a null url ``about:blank``. An empty table gives no file.
    """
    folder = ws.folder("monolithic")
    pages = pages.select(F.col("page_id").cast("long"), "url", "html")
    revisits = ws.save(payload_roles(pages.select("page_id", "html"), min_bytes))
    html = F.coalesce("html", F.lit(""))
    keyed = pages.withColumns({"html": html, "digest": F.sha1(html.cast("binary"))})
    same = keyed["page_id"].eqNullSafe(revisits["page_id"]) & (keyed["digest"] == revisits["digest"])
    roles = keyed.join(revisits, same, "left").select(keyed["page_id"], "url", "html", "refers_to", revisits["digest"].isNotNull().alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
        filesystem, path = open_fs(uri)
        squeeze = zlib.compressobj(_LEVEL, zlib.DEFLATED, _GZIP)
        with filesystem.open_output_stream(path, compression=None) as out:
            for batch in batches:
                for row in zip(*(batch.column(k) for k in range(5)), strict=True):
                    page_id, url, text, refers_to, revisit = (v.as_py() for v in row)
                    out.write(squeeze.compress(record(page_id, url, text.encode(), refers_to, revisit)))
                    n += 1
            out.write(squeeze.flush())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n])], ["file", "n_records"])
        else:
            filesystem.delete_file(path)

    return ws.save(roles.mapInArrow(write, MANIFEST))


def inflate(blocks: Iterable[bytes]) -> Iterator[bytes]:
    """The contents of a gzip file of one or more members."""
    stream = zlib.decompressobj(_GZIP)
    for data in blocks:
        while data:
            yield stream.decompress(data)
            data = stream.unused_data
            if stream.eof:
                stream = zlib.decompressobj(_GZIP)


def split_records(contents: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and whole bytes of each record of a stream; holds one record at a time."""
    held, head, need = bytearray(), None, 0
    for data in contents:
        held += data
        while True:
            if head is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                head = headers(bytes(held[:end]))
                need = end + 4 + int(head["content-length"]) + 4
            if len(held) < need:
                break
            yield head, bytes(held[:need])
            del held[:need]
            head = None
    if held.strip():
        raise ValueError(f"the archive ends inside a record: {bytes(held[:80])!r}")


def normalise(manifest: DataFrame, ws: Workspace) -> DataFrame:
    """Rewrites the archives of ``manifest`` (file) with a member per record and a sidecar index each."""
    folder = ws.folder("records")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("file").to_pylist():
                target, at, index = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, []
                filesystem, path = open_fs(uri)
                to_fs, to_path = open_fs(target)
                with filesystem.open_input_stream(path, compression=None) as source, to_fs.open_output_stream(to_path, compression=None) as out:
                    for head, whole in split_records(inflate(iter(lambda s=source: s.read(_BLOCK), b""))):
                        squeeze = zlib.compressobj(_LEVEL, zlib.DEFLATED, _GZIP)
                        member = squeeze.compress(whole) + squeeze.flush()
                        out.write(member)
                        index.append((head["warc-record-id"], head["warc-type"], at, len(member)))
                        at += len(member)
                types = (pa.string(), pa.string(), pa.uint64(), pa.uint64())
                side = pa.table([pa.array(c, t) for c, t in zip(zip(*index, strict=True), types, strict=True)], ["record_id", "type", "offset", "length"])
                with to_fs.open_output_stream(f"{to_path}.cdx") as out, pa.ipc.new_file(out, side.schema) as writer:
                    writer.write_table(side)
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([len(index)])], ["file", "n_records"])

    return ws.save(spread(manifest.select("file")).mapInArrow(rewrite, MANIFEST))


def parse_page(whole: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload size and digest, type and referred page of a record; checks the digest of a payload."""
    head, _, rest = whole.partition(b"\r\n\r\n")
    fields = headers(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (found := b32encode(hashlib.sha1(payload).digest()).decode()) != digest:
        raise ValueError(f"{fields['warc-record-id']}: payload digest {found}, header {digest}")
    page, refers = (fields.get(k, "").strip("<>").removeprefix(_ID) for k in ("warc-record-id", "warc-refers-to"))
    return int(page) if page else None, int(headers(http)["content-length"]), digest, fields["warc-type"], int(refers) if refers else None


def read_records(manifest: DataFrame) -> DataFrame:
    """Fetches every record of normalised archives through their indexes (see RECORD)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for batch in batches:
            for uri in batch.column("file").to_pylist():
                filesystem, path = open_fs(uri)
                with filesystem.open_input_file(f"{path}.cdx") as f:
                    index = pa.ipc.open_file(f).read_all()
                with filesystem.open_input_file(path) as f:
                    places = list(zip(index.column("offset").to_pylist(), index.column("length").to_pylist(), strict=True))
                    for k in range(0, len(places), 1000):
                        rows = [parse_page(zlib.decompress(f.read_at(n, at), _GZIP)) for at, n in places[k : k + 1000]]
                        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                        yield pa.RecordBatch.from_arrays(columns, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return spread(manifest).mapInArrow(read, RECORD)


def warc_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archives ``pages``, normalises the archives and returns what they hold, a row per page."""
    ws = Workspace(pages.sparkSession, "warc")
    return read_records(normalise(write_monolithic(pages, ws, min_bytes), ws))
