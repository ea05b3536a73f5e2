"""WARC archives with a two-level capture index.

Pages are written as gzip-compressed WARC records, repeated payloads as revisit
records of the first. The index orders captures by a sort-friendly form of their
URL, host reversed, in compressed blocks of lines; at the end of each index file
a sparse directory holds the first key of each block. A look-up bisects the list
of files, then the directory, reads one block, and range-reads the record.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_path, shuffle_partitions, small_batches

#: Payloads of fewer bytes are never revisits.
MIN_REVISIT = 100
BLOCK_LINES = 3000
# Fixed value: the profile of a revisit record.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FOOTER = struct.Struct("<QQ8s")
_MAGIC = b"CDXBLOCK"


def sort_key(url: str | None) -> str:
    """The URL with its host's parts reversed: com,example,www)/path?query. Null and odd URLs have a key too."""
    text = re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), (url or "").strip())
    try:
        parts = urlsplit(text)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return text.lower()
    if not host:
        return text
    reverse = ",".join(reversed(host.split(".")))
    return f"{reverse}{f':{port}' if port else ''}){parts.path or '/'}{f'?{parts.query}' if parts.query else ''}"


def _record_id(page: int | None, row: str = "") -> str:
    """A record's id: its page's number (nothing, if null), and what tells it from other records of that page."""
    return f"<urn:page:{'' if page is None else page}{f':{row}' if row else ''}>"


def _page_of(record_id: str) -> int | None:
    page = record_id[len("<urn:page:") : -1].split(":")[0]
    return int(page) if page else None


def info(name: str, date: str) -> bytes:
    """The record that an archive of this name begins with."""
    body = b"software: paperloom\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:file:{name}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def record(page: int | None, url: str | None, html: str | None, digest: str, size: int, refers_to: int | None, date: str, row: str = "") -> bytes:
    """One WARC record, uncompressed: a response with its payload, or a revisit without. row makes its id one of its own."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if revisit else http + (html or "").encode("utf-8", "surrogatepass")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page, row)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        lines += [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers and payload of an uncompressed record; a revisit's payload is None."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    body = rest[: int(headers["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
    kind = headers["WARC-Type"]
    page = _page_of(headers["WARC-Record-ID"])
    if kind == "response":
        digest = hashlib.sha256(payload).hexdigest()
        if headers["WARC-Payload-Digest"] != f"sha256:{digest}" or size != len(payload):
            raise ValueError(f"record of page {page} doesn't match its digest")
    return {
        "page_id": page, "url": headers.get("WARC-Target-URI"), "payload": payload if kind == "response" else None,
        "payload_bytes": size, "payload_digest": headers["WARC-Payload-Digest"].removeprefix("sha256:"), "record_type": kind,
        "refers_to": _page_of(headers["WARC-Refers-To"]) if kind == "revisit" else None,
    }


def with_roles(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, digest, size, refers_to: the smallest page of equal payloads, null for itself and for small payloads.

    Only ids and digests are grouped; payloads are moved once, to meet their role.
    A null page id cannot be referred to, and is always a response.
    """
    binary = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(binary, 256).alias("digest"), F.octet_length(binary).cast("long").alias("size"))
    ids = rows.select("page_id", "digest").where((F.col("size") >= min_revisit) & F.col("page_id").isNotNull())
    first = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    roles = ids.join(first, "digest").where("page_id <> first").select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("first").alias("refers_to")).distinct()
    joined = rows.join(roles.hint("shuffle_hash"), (rows.page_id == F.col("_page")) & (rows.digest == F.col("_digest")), "left")
    return joined.drop("_page", "_digest")


def write(pages: DataFrame, uri: str, date: str = "1970-01-01T00:00:00Z", min_revisit: int = MIN_REVISIT) -> list[dict]:
    """Write archives and index below uri; returns the list of index files, in key order.

    Columns used: page_id, url, html. A null html is an empty payload, a null url
    has an empty key. Rows equal in page id and payload are records of one kind,
    each with an id of its own; a revisit refers to its page, without the row.
    An empty table writes nothing. Payloads are held one at a time.
    Each task writes under a name of its own and renames at the end.
    """
    spark = pages.sparkSession
    small_batches(spark)
    names = ["key", "page_id", "file", "at", "length"]

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(uri)
        fs.create_dir(base, recursive=True)
        # Named by attempt: a task that runs again leaves a file that no index names.
        name = f"part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.warc.gz"
        out, at = None, 0
        for batch in batches:
            rows = []
            for page, url, html, digest, size, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    at += out.write(zlib.compress(info(name, date), 5, 31))
                coder = zlib.compressobj(5, zlib.DEFLATED, 31)
                # Rows come in no order of page ids: place and task make a record's id its own.
                data = coder.compress(record(page, url, html, digest, size, refers_to, date, f"{ctx.partitionId()}-{at}")) + coder.flush()
                out.write(data)
                rows.append((sort_key(url), page, name, at, len(data)))
                at += len(data)
            if rows:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        if out is not None:
            out.close()

    captures = with_roles(pages, min_revisit).select("page_id", "url", "html", "digest", "size", "refers_to")
    captures = captures.mapInArrow(archive, "key string, page_id long, file string, at long, length long")
    # The table of captures settles which attempt of each task counts.
    path = own_path(spark, "captures")
    captures.write.option("compression", "zstd").parquet(path)
    captures = spark.read.parquet(path)
    ordered = captures.repartitionByRange(shuffle_partitions(captures), "key", "page_id").sortWithinPartitions("key", "page_id")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(uri)
        name = f"index-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.cdx"
        out, at, n, lines, directory = None, 0, 0, [], []

        def flush() -> None:
            nonlocal at, lines
            data = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
            out.write(data)
            directory.append((lines[0][0], at, len(data), len(lines)))
            at, lines = at + len(data), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                lines.append(row)
                n += 1
                if len(lines) == BLOCK_LINES:
                    flush()
        if out is not None:
            if lines:
                flush()
            data = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(data)
            out.write(_footer(at, len(data)))
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([ctx.partitionId()]), pa.array([name]), pa.array([directory[0][0]]), pa.array([n])], names=["part", "file", "first", "n"]
            )

    files = ordered.select(*names).mapInArrow(index, "part long, file string, first string, n long").collect()  # one row a file
    return [{"file": r["file"], "first": r["first"], "n": r["n"]} for r in sorted(files, key=lambda r: r["part"])]


def _footer(at: int, size: int) -> bytes:
    return _FOOTER.pack(at, size, _MAGIC)


class IndexFile:
    """An open index file: its directory, and blocks by range reads."""

    def __init__(self, source) -> None:
        self.source = source
        at, size, magic = _FOOTER.unpack(source.read_at(_FOOTER.size, source.size() - _FOOTER.size))
        if magic != _MAGIC:
            raise ValueError("not an index file")
        self.directory = json.loads(zlib.decompress(source.read_at(size, at)))
        self.keys = [d[0] for d in self.directory]

    def block(self, k: int) -> list[list]:
        _, at, size, _ = self.directory[k]
        return [json.loads(x) for x in zlib.decompress(self.source.read_at(size, at)).split(b"\n")]

    def find(self, key: str) -> list[list]:
        """The lines of one key. They may begin in the block before the first that opens with it."""
        out = []
        for k in range(max(0, bisect_left(self.keys, key) - 1), bisect_right(self.keys, key)):
            lines = self.block(k)
            keys = [x[0] for x in lines]
            out += lines[bisect_left(keys, key) : bisect_right(keys, key)]
        return out


_CAPTURE = "key string, page_id long, file string, at long, length long"
_KINDS = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())


def entries(spark: SparkSession, uri: str, files: list[dict]) -> DataFrame:
    """All lines of the index."""
    names = ["key", "page_id", "file", "at", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_file(f"{base}/{name}") as source:
                    found = IndexFile(source)
                    for k in range(len(found.directory)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found.block(k)), _KINDS)], names=names)

    listed = spark.createDataFrame([(f["file"],) for f in files], "file string").repartition(max(1, len(files)))
    return listed.mapInArrow(run, _CAPTURE)


def lookup(urls: DataFrame, uri: str, files: list[dict], url: str = "url") -> DataFrame:
    """The index lines of the captures of the given URLs."""
    names = ["key", "page_id", "file", "at", "length"]
    firsts = [f["first"] for f in files]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, spots = [], []
            for u in batch.column(0).to_pylist():
                key = sort_key(u)
                # A key's lines may run over from the file before the first that opens with it.
                for k in range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key)):
                    keys.append(key), spots.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(spots, pa.int32()), pa.array(keys, pa.string())], names=["spot", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(uri)
        spot, found = None, None
        for batch in batches:
            out = []
            for s, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if s != spot:
                    spot, found = s, IndexFile(fs.open_input_file(f"{base}/{files[s]['file']}"))
                out += found.find(key)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _KINDS)], names=names)

    placed = urls.select(F.col(url).alias("url")).mapInArrow(place, "spot int, key string").distinct()
    return placed.repartition(max(1, len(files)), "spot").sortWithinPartitions("spot", "key").mapInArrow(run, _CAPTURE)


def records(captures: DataFrame, uri: str, with_payload: bool = True) -> DataFrame:
    """The records of index lines, range-read from the archives, digests verified.

    page_id, url, payload_bytes, payload_digest, record_type, refers_to, and payload (null for revisits).
    """
    small_batches(captures.sparkSession)
    fields = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(uri)
        name, source = None, None
        for batch in batches:
            rows = []
            for file, at, length in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, fs.open_input_file(f"{base}/{file}")
                got = parse(zlib.decompress(source.read_at(length, at), 31))
                rows.append([got[f] for f in fields])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=fields)
        if source is not None:
            source.close()

    parts = shuffle_partitions(captures)
    # Captures of one file that lie together are read by one task, in the order of the file.
    spread = captures.repartition(parts, "file", F.shiftright("at", 24)).sortWithinPartitions("file", "at").select("file", "at", "length")
    return spread.mapInArrow(run, ddl)


def write_and_read(pages: DataFrame) -> DataFrame:
    """pages written to archives in the shared folder and read back by way of the index.

    Nulls, repeated rows, long payloads and empty tables are as for write(): each
    row is a record, and a null page_id is always a response.
    """
    spark = pages.sparkSession
    uri = own_path(spark, "warc")
    files = write(pages, uri)
    return records(entries(spark, uri, files), uri, with_payload=False).drop("url")
