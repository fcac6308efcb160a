"""WARC archives with a two-level capture index.

Each task writes its pages as records, one gzip member each, to archive files of bounded size in a shared folder. Every attempt of a task
has files of its own name, and only the entries of the attempt that Spark commits name them, so an attempt that was lost leaves unused files
and nothing else. Keys are URLs with the host reversed; entries sorted by key are packed into compressed blocks, at the end of each index
file its directory keeps every block's first key and place, and one row a file says where its keys begin. A lookup finds the file by
bisection, reads its directory and bisects in that, reads and unpacks one block, bisects in it, and reads the record's range.

Payloads are the html in UTF-8, null counting as empty. Of equal payloads of at least min_bytes, the record with the largest page_id is a
response and the others are revisits without payload; repeated rows of that page_id are all responses; a null page_id revisits any other.
Null urls have the empty key. Very long payloads are one record each. An empty table gives no files and no rows; columns other than
page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import os
import re
import uuid
import zlib
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, broadcast_if_small

FILE_BYTES, BLOCK_ENTRIES, FILE_BLOCKS, LEVEL = 64 << 20, 1024, 1024, 1
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY_SCHEMA = "key string, page_id long, file string, at long, size long"
#: A row for each index file: its first key and where its directory is.
DIRECTORY_SCHEMA = "key string, page_id long, file string, at long, size long, entries long"
#: Bytes of archives that one task reads back.
READ_BYTES = 16 << 20
CAPTURE_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def url_key(url: str | None) -> str:
    """com,example,www)/path?query: host reversed, scheme, user, port and fragment left out."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").rstrip(".")
    except ValueError:
        return f")/{url}"
    if not host:
        return f")/{url}" if url else ""
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


class Store:
    """Files below a folder that all machines share: by the operating system if it is a local path, else by the matching file system."""

    def __init__(self, root: str):
        if re.match(r"file:|/", root):
            self.fs, self.root = None, re.sub(r"^file:(//[^/]*)?", "", root)
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(root)
        self.open_files: OrderedDict[str, object] = OrderedDict()

    def write(self, name: str, data: bytes) -> None:
        path, part = f"{self.root}/{name}", f"{self.root}/.{name}.{uuid.uuid4().hex}"
        if self.fs is None:
            os.makedirs(self.root, exist_ok=True)
            with open(part, "wb") as f:
                f.write(data)
            os.replace(part, path)
        else:
            self.fs.create_dir(self.root, recursive=True)
            with self.fs.open_output_stream(part, compression=None) as f:
                f.write(data)
            self.fs.move(part, path)

    def read(self, name: str, at: int, size: int) -> bytes:
        f = self.open_files.get(name)
        if f is None:
            f = open(f"{self.root}/{name}", "rb") if self.fs is None else self.fs.open_input_file(f"{self.root}/{name}")  # noqa: SIM115
            self.open_files[name] = f
            if len(self.open_files) > 16:
                self.open_files.popitem(last=False)[1].close()
        else:
            self.open_files.move_to_end(name)
        f.seek(at)
        data = f.read(size)
        if len(data) != size:
            raise OSError(f"{name}: {len(data)} of {size} bytes at {at}")
        return data


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_uri(page_id: int | None) -> str:
    return f"<urn:bidlake:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, response: int | None) -> bytes:
    """A WARC/1.1 record; response is the page that a revisit refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if response is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if response is None else 'revisit'}", f"WARC-Record-ID: {page_uri(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(0x21, 0x7F)))))
    if response is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {page_uri(response)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest_of(payload)}", f"WARC-Block-Digest: sha1:{digest_of(body)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of the record and of its HTTP message, and the payload; lengths and the block's digest are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    body = rest[:size]
    if lines[0] != "WARC/1.1" or rest[size:] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{digest_of(body)}":
        raise ValueError("damaged record")
    http, _, payload = body.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _page(uri: str) -> int | None:
    value = uri.strip("<>").rpartition(":")[2]
    return int(value) if value else None


def _rows(columns: list[list], names: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    fields = [f.strip().split(" ") for f in names.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def attempt() -> str:
    """A name for this attempt of this task."""
    return f"{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"


def _writer(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, n, body, entries = Store(root), 0, bytearray(), []
        name = f"pages-{attempt()}"

        def close() -> pa.RecordBatch:
            nonlocal body, entries, n
            store.write(f"{name}-{n:04d}.warc.gz", bytes(body))
            n += 1
            out = _rows([list(c) for c in zip(*entries, strict=True)], ENTRY_SCHEMA)
            body, entries = bytearray(), []
            return out

        for batch in batches:
            for r in batch.to_pylist():
                payload = (r["html"] or "").encode()
                response = r["response"] if r["response"] is not None and r["response"] != r["page_id"] else None
                data = gzip.compress(record(r["page_id"], r["url"], payload, response), LEVEL, mtime=0)
                entries.append((url_key(r["url"]), r["page_id"], f"{name}-{n:04d}.warc.gz", len(body), len(data)))
                body += data
                if len(body) >= FILE_BYTES:
                    yield close()
        if entries:
            yield close()

    return write


def _packer(root: str):
    """Sorted entries to compressed blocks in index files, with each file's directory at its end; a row for each file."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, n, body, block, rows = Store(root), 0, bytearray(), [], []
        name = f"captures-{attempt()}"

        def close() -> None:
            data = zlib.compress(json.dumps(block, separators=(",", ":")).encode(), LEVEL)
            rows.append((block[0][0], block[0][1], len(body), len(data), len(block)))
            body.extend(data)
            block.clear()

        def end_file() -> pa.RecordBatch:
            nonlocal body, rows, n
            data, file, at = zlib.compress(json.dumps(rows, separators=(",", ":")).encode(), LEVEL), f"{name}-{n:04d}.idx", len(body)
            store.write(file, bytes(body) + data)
            out = _rows([[rows[0][0]], [rows[0][1]], [file], [at], [len(data)], [sum(r[4] for r in rows)]], DIRECTORY_SCHEMA)
            body, rows, n = bytearray(), [], n + 1
            return out

        for batch in batches:
            for r in batch.to_pylist():
                block.append([r["key"], r["page_id"], r["file"], r["at"], r["size"]])
                if len(block) == BLOCK_ENTRIES:
                    close()
                    if len(rows) == FILE_BLOCKS:
                        yield end_file()
        if block:
            close()
        if rows:
            yield end_file()

    return pack


def order(key: str, page_id: int | None) -> tuple[bytes, bool, int]:
    """The order in which Spark sorts keys (by bytes) and page_ids (nulls first)."""
    return key.encode(), page_id is not None, page_id or 0


def found(rows: list, want: tuple) -> Iterator[int]:
    """Places of the sorted rows, each beginning with a key and page_id, in whose range want may lie: it may go on in the next ones."""
    i = max(0, bisect_left(rows, want, key=lambda r: order(r[0], r[1])) - 1)
    while i < len(rows) and order(rows[i][0], rows[i][1]) <= want:
        yield i
        i += 1


class Index:
    """Lookups over the index files of a range of keys: bisect in the files, in a file's directory, and in an unpacked block of it."""

    def __init__(self, store: Store, files: list[tuple]):
        self.store, self.files = store, files
        self.held: OrderedDict[tuple, list[list]] = OrderedDict()

    def unpacked(self, name: str, at: int, size: int) -> list[list]:
        """A directory or a block; the last few stay in memory."""
        place = (name, at)
        if place not in self.held:
            self.held[place] = json.loads(zlib.decompress(self.store.read(name, at, size)))
            if len(self.held) > 6:
                self.held.popitem(last=False)
        self.held.move_to_end(place)
        return self.held[place]

    def find(self, key: str, page_id: int | None) -> Iterator[list]:
        """The entries of a capture."""
        want = order(key, page_id)
        for f in found(self.files, want):
            _, _, name, at, size, _ = self.files[f]
            directory = self.unpacked(name, at, size)
            for b in found(directory, want):
                entries = self.unpacked(name, directory[b][2], directory[b][3])
                k = bisect_left(entries, want, key=lambda e: order(e[0], e[1]))
                while k < len(entries) and order(entries[k][0], entries[k][1]) == want:
                    yield entries[k]
                    k += 1


def _reader(root: str, directory):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(root)
        index = Index(store, directory.value)
        for batch in batches:
            out = []
            for q in batch.to_pylist():
                for _, page_id, name, at, size in index.find(q["key"], q["page_id"]):
                    fields, http, payload = parsed(gzip.decompress(store.read(name, at, size)))
                    kind, digest, n = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"])
                    if kind == "response" and (len(payload) != n or digest_of(payload) != digest) or _page(fields["WARC-Record-ID"]) != page_id:
                        raise ValueError(f"{name}: the record at {at} isn't the one in the index")
                    out.append((page_id, n, digest, kind, _page(fields["WARC-Refers-To"]) if kind == "revisit" else None, fields.get("WARC-Target-URI")))
            if out:
                yield _rows([list(c) for c in zip(*out, strict=True)], CAPTURE_SCHEMA)

    return read


class Archive:
    """Archives and index of a table of pages, in a shared folder."""

    def __init__(self, spark: SparkSession, root: str, entries: DataFrame, directory: DataFrame):
        self.spark, self.root, self.entries, self.directory = spark, root, entries, directory

    @classmethod
    def write(cls, pages: DataFrame, min_bytes: int = 0) -> Archive:
        scratch = Scratch(pages.sparkSession, "warc")
        root = scratch.path("files")
        body = F.coalesce(F.col("html"), F.lit(""))
        rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.when(F.octet_length(body) >= min_bytes, F.sha1(body.cast("binary"))).alias("sha1"))
        equal = rows.where("sha1 is not null").groupBy("sha1").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").select("sha1", "response")
        equal = scratch.keep(equal, "equal")
        entries = rows.join(broadcast_if_small(equal, 80), "sha1", "left").select("page_id", "url", "html", "response").mapInArrow(_writer(root), ENTRY_SCHEMA)
        entries = scratch.keep(entries, "entries")
        directory = entries.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(_packer(root), DIRECTORY_SCHEMA)
        return cls(pages.sparkSession, root, entries, scratch.keep(directory, "directory"))

    def lookup(self, captures: DataFrame) -> DataFrame:
        """The records of captures (key, page_id), read back through the index.

        What goes to the workers is a row for each index file, about one in a million captures, in parts of bounded size, each with the captures
        of its range of keys; one part for all but the largest archives.
        """
        size = self.directory.agg(F.sum(F.length("key") + 60).alias("n"), F.count("*").alias("rows")).first()
        if not size["rows"]:
            return self.spark.createDataFrame([], CAPTURE_SCHEMA)
        parts = max(1, -(-int(size["n"]) // BROADCAST_BYTES))
        bounds: list[str | None] = [None, None]
        if parts > 1:
            keys = self.directory.select("key").repartitionByRange(parts, "key")
            bounds = [None, *sorted(r["k"] for r in keys.groupBy(F.spark_partition_id()).agg(F.min("key").alias("k")).collect())[1:], None]
        bytes_written = self.entries.agg(F.sum("size")).first()[0] or 0
        tasks = max(2 * self.spark.sparkContext.defaultParallelism, -(-bytes_written // READ_BYTES))
        captures = captures.select("key", "page_id").distinct().repartitionByRange(tasks, "key", "page_id").sortWithinPartitions("key", "page_id")
        found = None
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            rows, mine = self.directory, captures
            if lo is not None:
                # The file before the first one of this range may hold the range's first keys.
                before = self.directory.where(F.col("key") < lo).orderBy(F.desc("key"), F.desc("page_id")).limit(1)
                rows, mine = rows.where(F.col("key") >= lo).union(before), mine.where(F.col("key") >= lo)
            if hi is not None:
                rows, mine = rows.where(F.col("key") < hi), mine.where(F.col("key") < hi)
            held = sorted(map(tuple, rows.collect()), key=lambda r: order(r[0], r[1]))
            part = mine.mapInArrow(_reader(self.root, self.spark.sparkContext.broadcast(held)), CAPTURE_SCHEMA)
            found = part if found is None else found.union(part)
        return found

    def read_all(self) -> DataFrame:
        return self.lookup(self.entries)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every page, written to archives and read back from them."""
    return Archive.write(pages).read_all()


#: What the archive must hold, from the table alone; five digits of the digest are four of base 32.
ORACLE_SQL = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b FROM pages), d AS (SELECT page_id, url, octet_length(b)::BIGINT AS n, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS last FROM p),
c AS (SELECT *, list_transform(range(8), lambda i: list_reduce(range(1, 6), lambda s, k: s * 16 + instr('0123456789abcdef', h[i * 5 + k]) - 1, 0)) AS parts FROM d)
SELECT page_id, url, n AS payload_bytes, array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) % 32 + 1)::INT, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM c
"""
