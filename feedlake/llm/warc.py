"""WARC archives: writing, normalising to one gzip member a record with an offset index, and reading back.

``write`` puts a record for every page in archives that are gzipped as one stream each. Of pages with the same payload the
one with the largest page_id is a response, the others are revisits that name it and carry headers only. ``normalise`` inflates
each such archive once, as a stream, writes every record as a gzip member of its own and beside the archive an index with a
line for each record: offset, length, type, record id. ``read`` fetches records by that index and checks payload digests.

Payloads meet their response by a join on the digest, which adaptive execution splits where one payload is very common.
Archives are closed at ``ROLL`` bytes of records, so a task holds one record and a buffer. Tasks return the names of
the files that they have completed; a repeated task writes files of other names.

Null html is an empty payload, null urls an empty target. Rows with one page_id and payload are responses alike if it is the
largest; a null page_id is smaller than any other. Line breaks and spaces in urls are percent-encoded. No pages give no files.
Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.files import NewFile, read_random, read_stream
from feedlake.session import cut_lineage, run_folder

ROLL, CHUNK, LEVEL = 64_000_000, 1 << 18, 6
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVES = pa.schema([("archive", pa.string()), ("index", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
ARCHIVES_DDL = "archive string, index string, records long, bytes long"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to) -> bytes:
    """One WARC record, with the blank lines that end it; a revisit has no payload but the headers of the full one."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload or b"")
    target = quote(url or "", safe="".join(chr(c) for c in range(33, 127) if chr(c) != "%") + "%") if url else ""
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}",
             f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if payload is None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def headers_of(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, found, value = line.partition(":")
        if found:
            out[name.lower()] = value.strip()
    return out


class Reader:
    """Records of a byte stream, one at a time: (headers, whole record)."""

    def __init__(self, chunks):
        self.chunks, self.buffer = chunks, bytearray()

    def _more(self) -> bool:
        chunk = next(self.chunks, None)
        if chunk is None:
            return False
        self.buffer += chunk
        return True

    def __iter__(self):
        while True:
            looked = 0
            while (end := self.buffer.find(b"\r\n\r\n", max(0, looked - 3))) < 0:
                looked = len(self.buffer)
                if not self._more():
                    if self.buffer:
                        raise ValueError("the archive ends within a record")
                    return
            headers = headers_of(bytes(self.buffer[:end]))
            size = end + 4 + int(headers["content-length"]) + 4
            while len(self.buffer) < size:
                if not self._more():
                    raise ValueError("the archive ends within a record")
            yield headers, bytes(self.buffer[:size])
            del self.buffer[:size]


def inflated(stream):
    """Inflate a gzip file as it is read, one member or several."""
    inflater = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            out = inflater.decompress(data, CHUNK * 4)
            if out:
                yield out
            if inflater.eof:
                data, inflater = inflater.unused_data, zlib.decompressobj(31)
            else:
                data = inflater.unconsumed_tail


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` to archives in ``folder`` that are one gzip stream each; returns their list (archive, records)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.unhex(F.sha1(payload)).alias("digest"))
    last = rows.groupBy("digest").agg(F.max("page_id").alias("last"))
    same = F.col("page_id").eqNullSafe(F.col("last"))
    rows = rows.join(last, "digest").select("page_id", "url", F.when(same, F.col("payload")).alias("payload"),
                                            F.octet_length("payload").cast("long").alias("size"), "digest", "last")

    def run(batches):
        file = None
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "size", "digest", "last")]
            for row in zip(*columns):
                page_id, url, payload, size, digest, refers_to = (x.as_py() for x in row)
                if file is None:
                    file, deflater, records, inflated_size = NewFile(folder, ".warc.gz"), zlib.compressobj(LEVEL, wbits=31), 0, 0
                data = record(page_id, url, payload, size, base64.b32encode(digest).decode(), refers_to)
                file.write(deflater.compress(data))
                records, inflated_size = records + 1, inflated_size + len(data)
                if inflated_size >= ROLL:
                    yield _close(file, deflater, records)
                    file = None
        if file is not None:
            yield _close(file, deflater, records)

    return cut_lineage(rows.mapInArrow(run, ARCHIVES_DDL).select("archive", "records"))


def _close(file: NewFile, deflater, records: int):
    file.write(deflater.flush())
    file.close()
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((file.uri, None, records, file.size), ARCHIVES)], schema=ARCHIVES)


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive record by record into ``folder``; returns archive, index, records and bytes of the new ones."""
    def run(batches):
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                file, index, records = NewFile(folder, ".warc.gz"), NewFile(folder, ".idx"), 0
                with read_stream(archive) as stream:
                    for headers, data in Reader(inflated(stream)):
                        deflater = zlib.compressobj(LEVEL, wbits=31)
                        member = deflater.compress(data) + deflater.flush()
                        index.write(f"{file.size}\t{len(member)}\t{headers['warc-type']}\t{headers['warc-record-id']}\n".encode())
                        file.write(member)
                        records += 1
                file.close()
                index.close()
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((file.uri, index.uri, records, file.size), ARCHIVES)], schema=ARCHIVES)

    return cut_lineage(_spread(archives.select("archive")).mapInArrow(run, ARCHIVES_DDL))


def _spread(files: DataFrame) -> DataFrame:
    """One file a row, dealt out evenly to the tasks."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))


PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                   ("record_type", pa.string()), ("refers_to", pa.int64())])


def read(archives: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type and refers_to of every record, fetched by the index."""
    def run(batches):
        for batch in batches:
            for archive, index in zip(batch.column("archive").to_pylist(), batch.column("index").to_pylist()):
                rows, pending = [], b""
                with read_random(archive) as file, read_stream(index) as lines:
                    while data := lines.read(CHUNK):
                        *whole, pending = (pending + data).split(b"\n")
                        for line in whole:
                            offset, length, kind, _ = line.decode().split("\t")
                            rows.append(_row(zlib.decompress(file.read_at(int(length), int(offset)), 31), kind))
                        if len(rows) >= 1000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    return _spread(archives.select("archive", "index")).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _rows(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PAGES)], schema=PAGES)


def _row(data: bytes, kind: str):
    head, _, body = data.partition(b"\r\n\r\n")
    headers = headers_of(head)
    http, _, rest = body.partition(b"\r\n\r\n")
    size, digest = int(headers_of(http)["content-length"]), headers["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        payload = rest[:size]
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of {headers['warc-record-id']} differs from its digest")
    number = lambda name: int(headers[name]) if headers.get(name, "None") != "None" else None
    return number("page-id"), unquote(headers["warc-target-uri"]) or None, size, digest, kind, number("refers-to-page-id")


def archive(pages: DataFrame) -> DataFrame:
    """Write, normalise and list: the archives of ``pages`` in a new folder of the shared folder."""
    folder = run_folder(pages.sparkSession, "warc")
    return normalise(write(pages, f"{folder}/monolithic"), f"{folder}/members")
