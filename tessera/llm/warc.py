"""WARC archives in the shared folder, with revisit resolution by payload digest.

``write_archives`` stores one response record per page. ``resolve`` shuffles only the record headers by payload
digest and names, for each repeated payload, the record that the others revisit. ``write_deduplicated``
copies every archive with fresh headers, repeats becoming revisit records without payload. Payloads never
pass through a shuffle. ``read_archives`` parses archives back, whole records, in order.

File names carry task attempts, and the tables that follow name only files of attempts that ended well.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import Scratch, arrow_rows, join_by_size

#: Equal payloads of at least so many bytes are stored once.
LEAST_BYTES = 100
#: An archive file is closed after so many bytes of payload or records.
FILE_BYTES, FILE_RECORDS = 64 << 20, 20_000
#: Files are dealt over so many tasks at most.
MOST_TASKS = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = "X-Page-Id"
_HEADERS = "file string, ordinal bigint, page_id bigint, url string, payload_bytes bigint, digest string"


def open_fs(path: str):
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def record_id(page_id: int | None, place: str) -> str:
    """A stable record id: the page's number with a digest of the record's place, as a version 8 UUID."""
    tail = (page_id or 0) & 0xFFFFFFFFFFFFFFFF
    head = int.from_bytes(hashlib.sha256(place.encode()).digest()[:6], "big")
    mid = (0x800 if page_id is None else 0) | tail >> 62
    return uuid.UUID(int=head << 80 | 8 << 76 | mid << 64 | 2 << 62 | tail & ((1 << 62) - 1)).urn


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def encode_record(kind: str, fields: list[tuple[str, str | None]], http: bytes, payload: bytes) -> bytes:
    head = [("WARC-Type", kind), *fields, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + len(payload)))]
    lines = "".join(f"{k}: {_clean(v)}\r\n" for k, v in head if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + http + payload + b"\r\n\r\n"


def gzip_member(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def members(stream, step: int = 1 << 16):
    """The decompressed gzip members of a stream, one at a time."""
    rest = b""
    while True:
        d, out = zlib.decompressobj(31), []
        while not d.eof:
            rest = rest or stream.read(step)
            if not rest:
                if out:
                    raise EOFError("an archive ends within a record")
                return
            out.append(d.decompress(rest))
            rest = d.unused_data
        yield b"".join(out)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP header and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http + b"\r\n\r\n", payload


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


class _Files:
    """Archive files of one task attempt, in the folder of its partition; a file is closed when it is full."""

    def __init__(self, folder: str):
        t = TaskContext.get()
        self.folder = f"{folder}/part-{t.partitionId():06d}"
        self.fs, self.path = open_fs(self.folder)
        self.fs.create_dir(self.path, recursive=True)
        self.n, self.out = 0, None
        self.stem = f"part-{t.partitionId():06d}-{t.taskAttemptId()}"

    def add(self, data: bytes, size: int) -> tuple[str, int]:
        if self.out is not None and (self.bytes + size > FILE_BYTES or self.records >= FILE_RECORDS):
            self.close()
        if self.out is None:
            self.name, self.bytes, self.records = f"{self.stem}-{self.n:05d}.warc.gz", 0, 0
            self.out, self.n = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None), self.n + 1
        self.out.write(data)
        self.bytes, self.records = self.bytes + size, self.records + 1
        return f"{self.folder}/{self.name}", self.records - 1

    def close(self):
        if self.out is not None:
            self.out.close()
            self.out = None


def _write(folder: str, date: str, level: int):
    def run(batches):
        files = _Files(folder)
        for batch in batches:
            rows = []
            for page, url, html in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html").cast(pa.binary()).to_pylist(), strict=True):
                payload = html or b""
                digest = hashlib.sha256(payload).hexdigest()
                place = f"{files.stem}/{files.n}/{len(rows)}/{digest}"
                fields = [("WARC-Record-ID", f"<{record_id(page, place)}>"), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}"), (_PAGE, None if page is None else str(page))]
                file, ordinal = files.add(gzip_member(encode_record("response", fields, _http(len(payload)), payload), level), len(payload))
                rows.append((file, ordinal, page, url, len(payload), digest))
            names = [x.split()[0] for x in _HEADERS.split(", ")]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=names)
        files.close()

    return run


def write_archives(pages: DataFrame, folder: str, date: str, level: int = 1) -> DataFrame:
    """Write a response record per row of ``pages`` (page_id, url, html); lazily returns the record headers.

    A null html is an empty payload; a null id or url leaves its field out; control characters in a url are escaped.
    """
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_write(folder, date, level), _HEADERS)


def resolve(headers: DataFrame, scratch: Scratch, least: int = LEAST_BYTES) -> DataFrame:
    """The headers of records that revisit another, with the original's place, page and url.

    Of equal payloads of ``least`` bytes or more the record with the smallest page id is the original, null ids
    last; of repeated rows the first in the archives.
    """
    own = F.struct(F.isnull("page_id").alias("no_id"), "page_id", "file", "ordinal", "url")
    large = headers.where(F.col("payload_bytes") >= least)
    first = large.groupBy("digest").agg(F.min(own).alias("original"), F.count("*").alias("copies")).where("copies > 1").select("digest", "original")
    first = scratch.table(first, "originals")
    found = join_by_size(large, first, ["digest"], "inner", 400)
    return found.where("not (file = original.file and ordinal = original.ordinal)")


def _rewrite(folder: str, date: str, level: int):
    def run(batches):
        files = _Files(folder)
        for batch in batches:
            names = []
            for row in batch.to_pylist():
                refs = {r["ordinal"]: r for r in row["refs"] or ()}
                source, path = open_fs(row["file"])
                with source.open_input_stream(path, compression=None) as stream:
                    for ordinal, data in enumerate(members(stream)):
                        old, http, payload = parse_record(data)
                        ref = refs.get(ordinal)
                        page = int(old[_PAGE]) if _PAGE in old else None
                        fields = [("WARC-Record-ID", f"<{record_id(page, row['file'] + '/' + str(ordinal))}>"), ("WARC-Date", date), ("WARC-Target-URI", old.get("WARC-Target-URI")), ("WARC-Payload-Digest", old["WARC-Payload-Digest"]), (_PAGE, old.get(_PAGE))]
                        if ref:
                            fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_id(ref['page_id'], ref['file'] + '/' + str(ref['at']))}>"), ("WARC-Refers-To-Target-URI", ref["url"]), ("WARC-Refers-To-Date", date), ("WARC-Truncated", "length")]
                        new = encode_record("revisit" if ref else "response", fields, http, b"" if ref else payload)
                        name, _ = files.add(gzip_member(new, level), 0 if ref else len(payload))
                        if not names or names[-1] != name:
                            names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["file"])
        files.close()

    return run


def write_deduplicated(headers: DataFrame, revisits: DataFrame, folder: str, date: str, level: int = 6) -> DataFrame:
    """Copy the archives named in ``headers`` with fresh headers, revisits without payload; lazily returns the new files."""
    refs = revisits.groupBy("file").agg(F.collect_list(F.struct("ordinal", F.col("original.page_id").alias("page_id"), F.col("original.file").alias("file"), F.col("original.ordinal").alias("at"), F.col("original.url").alias("url"))).alias("refs"))
    work = headers.select("file").distinct()
    # a task for each file: the names alone are so few bytes that they would be merged into one
    return work.join(refs, "file", "left").repartition(_tasks(work.count())).mapInArrow(_rewrite(folder, date, level), "file string").distinct()


def _tasks(files: int) -> int:
    return max(1, min(files, MOST_TASKS))


def _pruned(batches):
    for batch in batches:
        gone = 0
        for row in batch.to_pylist():
            fs, path = open_fs(row["folder"])
            kept = {name.rsplit("/", 1)[1] for name in row["files"]}
            for info in fs.get_file_info(pafs.FileSelector(path)):
                if info.base_name not in kept:
                    fs.delete_file(info.path)
                    gone += 1
        yield pa.RecordBatch.from_arrays([pa.array([gone], pa.int64())], names=["gone"])


def prune(files: DataFrame) -> DataFrame:
    """Deletes, beside the named archives, what attempts that did not end well left in their folders; returns counts."""
    at = files.groupBy(F.regexp_extract("file", "^(.*)/[^/]*$", 1).alias("folder")).agg(F.collect_list("file").alias("files"))
    return at.mapInArrow(_pruned, "gone bigint")


def _page_of(urn: str) -> int | None:
    n = uuid.UUID(urn.strip("<>")).int
    if n >> 64 & 0x800:
        return None
    tail = (n >> 64 & 3) << 62 | n & ((1 << 62) - 1)
    return tail - (1 << 64) if tail >> 63 else tail


def _read(batches):
    for batch in batches:
        for file in batch.column("file").to_pylist():
            source, path = open_fs(file)
            rows = []
            with source.open_input_stream(path, compression=None) as stream:
                for data in members(stream):
                    fields, http, payload = parse_record(data)
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    kind = fields["WARC-Type"]
                    size = int(http.split(b"Content-Length: ")[1].split(b"\r\n")[0])
                    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or size != len(payload)):
                        raise ValueError(f"{file}: a payload differs from its header")
                    page = int(fields[_PAGE]) if _PAGE in fields else None
                    refers = _page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
                    rows.append((page, size, digest, kind, refers, fields.get("WARC-Target-URI")))
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=names)


def read_archives(files: DataFrame) -> DataFrame:
    """One row per record of the named archives; payloads of responses are checked against their digests."""
    return files.select("file").mapInArrow(_read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string")


def archive_pages(pages: DataFrame, date: str | None = None) -> DataFrame:
    """Write ``pages`` to archives, resolve revisits, write deduplicated archives and read them back.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to, url`` per row, the url as stored.
    Repeated rows are records of their own; no rows write no records; further columns are ignored.
    The deduplicated archives stay in the shared folder, without files of failed attempts in their partitions' folders.
    A payload of any length is one record, held whole by the task that writes or reads it.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    with arrow_rows(spark, 1000):
        headers = scratch.table(write_archives(pages, scratch.path("raw"), date), "headers")
        revisits = scratch.table(resolve(headers, scratch), "revisits")
    with arrow_rows(spark, 4):
        files = scratch.table(write_deduplicated(headers, revisits, scratch.path("archives"), date), "files")
        scratch.table(prune(files), "pruned")
    for name in ("raw", "headers", "originals", "revisits", "pruned"):
        scratch.drop(name)
    return read_archives(files.repartition(_tasks(files.count())))


def op5_warc_revisits(spark, sf_dir: str) -> DataFrame:
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
