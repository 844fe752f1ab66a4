"""WARC archives: writing, normalising monolithic gzip, and reading by offset.

A WARC file compressed as one gzip stream can only be read from its start. The
normaliser inflates such a file once, as a stream, and writes every record as a gzip
member of its own, with a sidecar index of offsets beside it; after that any record is
read with one seek. Records are passed on in pieces, so neither a file nor a record has
to fit into memory, and streams of several members are accepted as well.

Files are written under a name of their task attempt and then renamed, so a lost
executor leaves nothing half done behind. They live in the shared folder, which tasks
open by ``pyarrow.fs`` (file, s3, gs, hdfs). A file is one task's work; readers take blocks
of the index, so several tasks read one file.

Of records with equal payloads of ``REVISIT_BYTES`` or more the one with the least
page_id is a response and the others revisit it: they keep the HTTP header, with the
payload's length, and its digest. Equal payloads are found by digest on narrow rows,
with map-side combined minimums.

Defined results: a null payload is empty; a null URL has no target. A record with a null
page_id is a response that nothing refers to. Rows that repeat a page_id are records each.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import words
from gleaner.llm.groups import whole_groups
from gleaner.llm.storage import Shelf

REVISIT_BYTES = 100
DATE = "1970-01-01T00:00:00Z"
LEVEL = 4
PIECE = 1 << 20
READ_BLOCK = 4 << 20

# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 31

INDEX = "file string, record_id string, record_type string, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _record_id(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def _page_id(record_id: str | None) -> int | None:
    number = (record_id or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record of format version 1.1, uncompressed. refers_to: the page whose payload this one repeats."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head += [f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def headers_of(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the first line, which has no colon-space name, is skipped."""
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


class _Renamed:
    """A file under a name of this attempt, which gets its own name when it is whole."""

    def __init__(self, files: fs.FileSystem, path: str):
        self.files, self.path = files, path
        context = TaskContext.get()
        self.draft = f"{path}.{context.taskAttemptId() if context else 0}"
        self.out = files.open_output_stream(self.draft, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.files.move(self.draft, self.path)


def inflated(stream) -> Iterator[bytes]:
    """The content of a gzip stream of one member or more, in pieces."""
    engine = zlib.decompressobj(GZIP)
    begun = False
    while data := stream.read(PIECE):
        while data:
            piece = engine.decompress(data, PIECE)
            begun = True
            if piece:
                yield piece
            if engine.eof:
                data = engine.unused_data
                engine, begun = zlib.decompressobj(GZIP), False
            else:
                data = engine.unconsumed_tail
    if begun:
        raise ValueError("gzip stream ends early")


def records_in(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """(header fields, pieces of the whole record with its header) of a WARC stream; read each record before the next."""
    held = bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        if piece is None:
            return False
        held.extend(piece)
        return True

    def take(count: int) -> Iterator[bytes]:
        while count:
            if not held and not more():
                raise ValueError("record ends early")
            part = bytes(held[:count])
            del held[: len(part)]
            count -= len(part)
            yield part

    while True:
        while held[:2] == b"\r\n":
            del held[:2]
        end = held.find(b"\r\n\r\n")
        if end < 0:
            if more():
                continue
            if held.strip():
                raise ValueError("header ends early")
            return
        head = headers_of(bytes(held[:end]))
        body = take(end + 4 + int(head["content-length"]))
        yield head, body
        for _ in body:  # what the caller left unread
            pass


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    return files, path


def _write_monolithic(folder: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open(folder)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        out = engine = None
        for batch in batches:
            data, edges = words.text_buffer(batch["html"])
            ids, urls, digests, refers = (batch[c].to_pylist() for c in ("page_id", "url", "digest", "refers_to"))
            for i in range(batch.num_rows):
                if out is None:
                    out, engine = _Renamed(files, f"{path}/{name}"), zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                payload = data[edges[i] : edges[i + 1]].tobytes()
                out.write(engine.compress(record_bytes(ids[i], urls[i], payload, digests[i], refers[i])))
        if out is not None:
            out.write(engine.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])

    return scan


def normalise_file(files: fs.FileSystem, source: str, target: str) -> Iterator[tuple[str, str, int, int]]:
    """Rewrite one archive with a member for each record, and its index beside it; gives the index rows."""
    out, index = _Renamed(files, target), _Renamed(files, f"{target}.idx")
    with files.open_input_stream(source, compression=None) as stream:
        for head, body in records_in(inflated(stream)):
            offset, engine = out.size, zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
            for piece in body:
                out.write(engine.compress(piece))
            out.write(engine.compress(b"\r\n\r\n") + engine.flush())
            row = (head.get("warc-record-id", ""), head.get("warc-type", ""), offset, out.size - offset)
            index.write((json.dumps(dict(zip(("id", "type", "offset", "length"), row, strict=True))) + "\n").encode())
            yield row
    out.close()
    index.close()


def _normalise(raw: str, folder: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch["file"].to_pylist():
                files, source = _open(raw)
                _, target = _open(folder)
                for rows in batched(normalise_file(files, f"{source}/{name}", f"{target}/{name}"), 10_000):
                    columns = [pa.array(values) for values in zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(rows)), *columns],
                        names=["file", "record_id", "record_type", "offset", "length"],
                    )

    return scan


def _read(folder: str):
    """Records at the offsets of index rows, sorted by file."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open(folder)
        for table in whole_groups(batches, ["block"], rows=1):
            found: dict[str, list] = {name: [] for name in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")}
            name, archive = None, None
            for row in table.select(["file", "offset", "length"]).to_pylist():
                if row["file"] != name:
                    name, archive = row["file"], files.open_input_file(f"{path}/{row['file']}")
                archive.seek(row["offset"])
                member = zlib.decompress(archive.read(row["length"]), GZIP)
                head, _, rest = member.partition(b"\r\n\r\n")
                fields = headers_of(head)
                http, _, _ = rest.partition(b"\r\n\r\n")
                length = int(headers_of(http)["content-length"])
                digest = fields["warc-payload-digest"].removeprefix("sha256:")
                if fields["warc-type"] == "response":
                    begin = len(http) + 4
                    if hashlib.sha256(rest[begin : begin + length]).hexdigest() != digest:
                        raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest")
                found["page_id"].append(_page_id(fields["warc-record-id"]))
                found["payload_bytes"].append(length)
                found["payload_digest"].append(digest)
                found["record_type"].append(fields["warc-type"])
                found["refers_to"].append(_page_id(fields.get("warc-refers-to")))
                found["url"].append(fields.get("warc-target-uri"))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, kind) for values, kind in zip(found.values(), kinds, strict=True)], names=list(found)
            )

    return scan


def with_revisits(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, digest, refers_to) of every page."""
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("digest"))
    narrow = pages.filter(F.octet_length("html") >= least_bytes).select("page_id", F.sha2("html", 256).alias("digest"))
    firsts = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    firsts = firsts.filter("first < last").select("digest", "first")
    revisits = narrow.join(firsts, "digest").filter("page_id > first").distinct()
    return keyed.join(revisits, ["page_id", "digest"], "left").select(
        "page_id", "url", "html", "digest", F.col("first").alias("refers_to")
    )


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """Write each partition of (page_id, url, html, digest, refers_to) as one gzip stream; (file) of those written."""
    return pages.mapInArrow(_write_monolithic(folder), "file string")


def normalised(archives: DataFrame, raw: str, folder: str) -> DataFrame:
    """Normalise the archives (file) of ``raw`` into ``folder``; their index. Each archive is a task of its own."""
    files = max(1, archives.count())
    return archives.repartitionByRange(files, "file").mapInArrow(_normalise(raw, folder), INDEX)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of an index, each read by its offset; payloads are held against their digests."""
    block = F.concat_ws(":", "file", F.floor(F.col("offset") / READ_BLOCK).cast("string"))
    dealt = index.filter("record_type <> 'warcinfo'").select("file", "offset", "length", block.alias("block"))
    # Index rows are small, what they stand for is not: as many tasks as there are blocks to read.
    blocks = int(index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]) // READ_BLOCK + 1
    tasks = max(blocks, index.sparkSession.sparkContext.defaultParallelism)
    dealt = dealt.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("block", "offset")
    return dealt.mapInArrow(_read(folder), RECORDS)


def archived(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write all pages to archives, normalise them, and read every record back."""
    shelf = Shelf(pages.sparkSession, "warc")
    raw, whole = f"{shelf.folder}/raw", f"{shelf.folder}/warc"
    archives = shelf.put("archives", write_monolithic(with_revisits(pages, least_bytes), raw))
    index = shelf.put("index", normalised(archives, raw, whole))
    shelf.drop("raw")
    return read_records(index, whole)


ORACLE = f"""
SELECT page_id, strlen(html) AS payload_bytes, digest AS payload_digest,
    CASE WHEN strlen(html) >= {REVISIT_BYTES} AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN strlen(html) >= {REVISIT_BYTES} AND page_id > first THEN first END AS refers_to, url
FROM (SELECT *, sha256(html) AS digest, min(page_id) OVER (PARTITION BY html) AS first
    FROM (SELECT page_id, url, coalesce(html, '') AS html FROM pages))
"""
