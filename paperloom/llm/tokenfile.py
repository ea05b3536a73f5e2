"""Token ids in files of bit planes.

A file holds the ids of documents in ascending key order, cut into blocks of a
fixed number of ids. A block is transposed into planes (the four bytes of all
its ids apart, or their 32 bits apart), and each plane is compressed by itself:
high planes are nearly constant, and cost next to nothing. A chunk index tells
where each block lies and which ids it holds, a document index where documents
begin; both are at the end, so a file is written and read as a stream.

Layout, little-endian: magic; blocks; chunk index; document index; footer.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WHITE_SPACE, load
from .common import own_path, shuffle_partitions, small_batches

MAGIC = b"TKPLANE1"
BLOCK_IDS = 1 << 16
_FOOTER = struct.Struct("<QQQQQQ8s")  # chunk index at, length, document index at, length, ids, documents, magic
_CHUNK = np.dtype([("at", "<u8"), ("first", "<u8"), ("n", "<u4"), ("kind", "<u4"), ("size", "<u4", (32,))])
_DOC = np.dtype([("key", "<i8"), ("has_key", "u1"), ("start", "<u8"), ("n", "<u8")])

# A piece begins where the tokenizer's own split must: at the last white space
# before a word, at a run of white space that no word follows, and at ASCII
# punctuation between letters or digits and white space. An apostrophe may begin
# a contraction, so nothing is cut at one.
_PUNCTUATION = r"!-&(-/:-@\[-`{-~"
_PIECES = re.compile(
    f"[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])"
    rf"|[{WHITE_SPACE}]?[^\W_]+(?=[{WHITE_SPACE}{_PUNCTUATION}]|\Z)"
    rf"|[{_PUNCTUATION}]+(?=[{WHITE_SPACE}]|\Z)"
    f"|[{WHITE_SPACE}]?[^{WHITE_SPACE}]+"
)
_SPACES = frozenset(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: New pieces encoded as one text.
JOINED_PIECES = 1000
CACHE_PIECES = 1_000_000


def _slices(data: bytes, begin: np.ndarray) -> Iterator[bytes]:
    """data cut at the ascending positions begin."""
    return map(data.__getitem__, map(slice, begin.tolist(), [*begin[1:].tolist(), len(data)]))


class ByteCodec:
    """Encoder of a byte-level tokenizer that splits at white space; ids as little-endian bytes."""

    def __init__(self, path: str) -> None:
        self.tokenizer = tokenizer = load(path)
        special = tokenizer.get_added_tokens_decoder()
        self.special = {t.content: np.array([i], "<u4").tobytes() for i, t in special.items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if special else None
        self.cache: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        if self.at_special and self.at_special.search(text):
            out = []
            for part in self.at_special.split(text):
                out += [part] if part in self.special else _PIECES.findall(part)
            return out
        return _PIECES.findall(text)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text. Pieces met once the cache is full are forgotten after the batch:
        by then the frequent ones are in it, and what is new rarely returns."""
        cache = self.cache
        cut = [self.pieces(t) if t else [] for t in texts]
        new = [p for p in set().union(*cut) if p not in cache]
        # Pieces that begin, and do not end, with white space stay apart in a joined text.
        joined = [p for p in new if p[0] in _SPACES and p[-1] not in _SPACES]
        for at in range(0, len(joined), JOINED_PIECES):
            some = joined[at : at + JOINED_PIECES]
            size = np.fromiter(map(len, some), np.int64, len(some))
            got = self.tokenizer.encode("".join(some), add_special_tokens=False)
            begin = 4 * np.searchsorted([o[0] for o in got.offsets], np.cumsum(size) - size)
            cache.update(zip(some, _slices(np.array(got.ids, "<u4").tobytes(), begin)))
        alone = [p for p in new if p[0] not in _SPACES or p[-1] in _SPACES]
        ids = [e.ids for e in self.tokenizer.encode_batch(alone, add_special_tokens=False)]
        flat = np.array(list(chain.from_iterable(ids)), "<u4").tobytes()
        size = 4 * np.fromiter(map(len, ids), np.int64, len(ids))
        cache.update(zip(alone, _slices(flat, np.cumsum(size) - size)))
        out = [b"".join(map(cache.__getitem__, c)) for c in cut]
        for piece in new[max(0, CACHE_PIECES - len(cache) + len(new)) :]:
            del cache[piece]
        return out


_codecs: dict[str, ByteCodec] = {}


def codec(path: str) -> ByteCodec:
    if path not in _codecs:
        _codecs[path] = ByteCodec(path)
    return _codecs[path]


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The byte or bit planes of a block of ids, lowest first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    planes = np.ascontiguousarray(raw.T)
    if kind == "byte":
        return [p.tobytes() for p in planes]
    return [np.packbits((p >> bit) & 1).tobytes() for p in planes for bit in range(8)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    else:
        raw = np.zeros((4, n), np.uint8)
        for k, p in enumerate(planes):
            raw[k // 8] |= np.unpackbits(np.frombuffer(p, np.uint8), count=n) << (k % 8)
    return np.ascontiguousarray(raw.T).reshape(-1).view("<u4")


class PlaneWriter:
    """Writes one file; holds one block of ids at a time."""

    def __init__(self, out, kind: str = "byte", block_ids: int = BLOCK_IDS, level: int = 3) -> None:
        if kind not in ("byte", "bit"):
            raise ValueError("planes are of bytes or bits")
        self.out, self.kind, self.block = out, kind, block_ids
        self.coder = zstandard.ZstdCompressor(level=level)
        self.held, self.held_bytes, self.at, self.ids = [], 0, 0, 0
        self.chunks: list[tuple] = []
        self.docs: list[tuple] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: int | None, ids: bytes) -> None:
        self.docs.append((key or 0, key is not None, self.ids, len(ids) // 4))
        self.ids += len(ids) // 4
        self.held.append(ids)
        self.held_bytes += len(ids)
        if self.held_bytes >= 4 * self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        data, step = b"".join(self.held), 4 * self.block
        end = len(data) if last else len(data) // step * step
        for start in range(0, end, step):
            block = np.frombuffer(data[start : min(end, start + step)], "<u4")
            planes = [self.coder.compress(p) for p in to_planes(block, self.kind)]
            first = self.ids - (len(data) - start) // 4
            self.chunks.append((self.at, first, len(block), len(planes), [len(p) for p in planes] + [0] * (32 - len(planes))))
            for p in planes:
                self._put(p)
        self.held, self.held_bytes = [data[end:]], len(data) - end

    def close(self) -> None:
        self._flush(True)
        spots = []
        for rows, kind in ((self.chunks, _CHUNK), (self.docs, _DOC)):
            data = self.coder.compress(np.array(rows, kind).tobytes())
            spots += [self.at, len(data)]
            self._put(data)
        self._put(_FOOTER.pack(*spots, self.ids, len(self.docs), MAGIC))


class PlaneReader:
    """Reads a file by its indexes: ranges of ids, or all documents as a stream."""

    def __init__(self, source) -> None:
        self.source, self.coder = source, zstandard.ZstdDecompressor()
        size = source.size()
        c_at, c_len, d_at, d_len, self.ids, self.n_docs, magic = _FOOTER.unpack(source.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token file, or one that was not closed")
        self.chunks = np.frombuffer(self.coder.decompress(source.read_at(c_len, c_at)), _CHUNK)
        self.docs = np.frombuffer(self.coder.decompress(source.read_at(d_len, d_at)), _DOC)

    def block(self, k: int) -> np.ndarray:
        c = self.chunks[k]
        kind, n = ("byte" if c["kind"] == 4 else "bit"), int(c["n"])
        sizes = c["size"][: c["kind"]].tolist()
        data, planes, at = self.source.read_at(sum(sizes), int(c["at"])), [], 0
        for s in sizes:
            planes.append(self.coder.decompress(data[at : at + s]))
            at += s
        return from_planes(planes, n, kind)

    def range(self, start: int, n: int) -> np.ndarray:
        """n ids from start on; only the blocks that hold them are read."""
        if n <= 0:
            return np.zeros(0, "<u4")
        first = int(np.searchsorted(self.chunks["first"], start, side="right")) - 1
        out, k = [], first
        while k < len(self.chunks) and self.chunks[k]["first"] < start + n:
            lo = int(self.chunks[k]["first"])
            out.append(self.block(k)[max(0, start - lo) : start + n - lo])
            k += 1
        return np.concatenate(out)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Key, start in the file, and ids of each document; one block and one document are held."""
        held, k, lo = np.zeros(0, "<u4"), 0, 0
        for d in self.docs:
            start, n = int(d["start"]), int(d["n"])
            parts = [held]
            have = lo + len(held)
            while have < start + n:
                b = self.block(k)
                k += 1
                parts.append(b)
                have += len(b)
            if len(parts) > 1:
                held = np.concatenate(parts)
            yield (int(d["key"]) if d["has_key"] else None), start, held[start - lo : start - lo + n]
            held, lo = held[start - lo + n :], start + n


def write(
    docs: DataFrame,
    uri: str,
    path: str = "byte_bpe_50k.json",
    end_id: int | None = 2,
    key: str = "doc_id",
    text: str = "text",
    kind: str = "byte",
    block_ids: int = BLOCK_IDS,
) -> list[tuple[str, int, int]]:
    """Encode docs and write their ids below uri, ordered by key; returns the manifest.

    The manifest lists files in key order: (name, ids, documents). Rows of null
    key come first; rows of equal key are ordered by their text's hash; a null
    text counts as empty, and has the end id alone. A task writes under a name
    of its own and renames at the end, so a task that is run again after an
    executor was lost leaves one whole file.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    # Rows that share a key, or have none, are split by their texts, and equal ones by where they come from.
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    order = [F.col("key").asc_nulls_first(), F.col("h"), F.col("place")]
    rows = rows.repartitionByRange(shuffle_partitions(rows), *order).sortWithinPartitions(*order).select("key", "text")
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        part, name = ctx.partitionId(), f"part-{ctx.partitionId():06d}.tkp"
        fs, base = pafs.FileSystem.from_uri(uri)
        fs.create_dir(base, recursive=True)
        scratch, writer, out = f"{base}/.{name}.{ctx.taskAttemptId()}", None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                out = fs.open_output_stream(scratch)
                writer = PlaneWriter(out, kind, block_ids)
            for k, ids in zip(batch.column(0).to_pylist(), codec(path).encode_all(batch.column(1).to_pylist())):
                writer.add(k, ids + tail)
        if writer is not None:
            writer.close()
            out.close()
            fs.move(scratch, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([name]), pa.array([writer.ids]), pa.array([len(writer.docs)])], names=["part", "name", "ids", "docs"]
            )

    done = rows.mapInArrow(run, "part long, name string, ids long, docs long").collect()
    return [(r["name"], r["ids"], r["docs"]) for r in sorted(done, key=lambda r: r["part"])]


def read(spark, uri: str, manifest: list[tuple[str, int, int]], with_ids: bool = True) -> DataFrame:
    """The documents of a written set of files: key, start, n_tokens, ids_crc32, and ids if asked for.

    start counts the ids of all documents before. Files are read side by side.
    """
    small_batches(spark)
    base, spots = 0, []
    for name, ids, _ in manifest:
        spots.append((name, base))
        base += ids
    files = spark.createDataFrame(spots, "name string, base long").repartition(max(1, len(spots)))
    ddl = "key long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    names = ["key", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(f"{root}/{name}") as source:
                    rows: list[tuple] = []
                    size = 0
                    for k, start, ids in PlaneReader(source).documents():
                        rows.append((k, first + start, len(ids), zlib.crc32(ids.tobytes())) + ((ids.astype(np.int32),) if with_ids else ()))
                        size += len(ids) * with_ids + 1
                        if size > 1_000_000:
                            yield _batch(rows, names)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows, names)

    return files.mapInArrow(run, ddl)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def write_and_read(docs: DataFrame, path: str = "byte_bpe_50k.json", end_id: int = 2) -> DataFrame:
    """docs written to files in the shared folder and read back, as digests a document: doc_id, start, n_tokens, ids_crc32.

    Null keys come first, a null text counts as empty and has the end id alone,
    repeated rows each get their place, in the order of their texts' hashes, and
    an empty table gives no files and no rows. A long text's ids go through
    blocks of a file like any other's.
    """
    spark = docs.sparkSession
    uri = own_path(spark, "tokens")
    manifest = write(docs, uri, path, end_id)
    return read(spark, uri, manifest, with_ids=False).withColumnRenamed("key", "doc_id")
