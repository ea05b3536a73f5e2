"""Removal of passages that an earlier document has, by FM-indexes over shards.

An index over whole documents would have to be searched by all later documents.
So shards are dealt by content: every window of ``threshold`` words is filed under
one of its own short word sequences, the one of the smallest hash (its anchor).
Neighbouring windows mostly share it and make one *run*; equal windows always do,
so that whatever can match meets in one shard.

1. Runs meet by anchor. One that equals a whole run of a smaller document (told by
   128 bits of hashes, not by words) is gone as a whole, and asks no index. Where
   an anchor has runs that differ, the earliest of each kind goes on.
2. The words of these are sent once. A task gathers anchors until a shard is full,
   builds its FM-index (BWT in a wavelet matrix with packed ranks), and streams the
   shard's runs past it backwards: matching statistics, counting only matches in
   smaller documents. Windows whose match reaches the threshold are reported.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytehash import Rolling, mix, sliding_min
from .common import materialise, release, shuffle_partitions, small_batches, text_hash
from .fmindex import Index

#: Documents are scanned in stretches of so many windows, which bounds memory.
STRETCH = 1 << 19
_POS = np.uint64((1 << 20) - 1)
#: Words of a shard, but for the rest of its last anchor.
SHARD_WORDS = 1 << 19
#: An anchor with more differing runs than this has its windows compared through an exchange of their own.
MAX_GROUP = 5_000

_one, _two = Rolling(1), Rolling(2)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_WHOLE = -1  # in place of a mask: all windows of the run


def anchor_words(threshold: int) -> int:
    """Words of an anchor: a run's windows must fit the bits of a long."""
    return max(1, min(10, threshold // 3), threshold - 61)


def _sums(rolling: Rolling, values: np.ndarray) -> np.ndarray:
    rolling.reserve(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * rolling.up[: len(values)], out=out[1:])
    return out


class Runs:
    """The runs of one document: first window, number of windows, anchor, and whole content; lo is in words."""

    def __init__(self, raw: bytes, threshold: int) -> None:
        data = np.frombuffer(raw, np.uint8)
        edge = np.diff(np.r_[True, _SPACE[data], True].astype(np.int8))
        self.begin, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.threshold = threshold
        empty = [np.zeros(0, k) for k in (np.int64, np.int64, np.uint64, np.uint64)]
        n = len(self.begin)
        if n < threshold:
            self.lo, self.count, self.first, self.second = empty
            return
        byte = _one.prefix(data), _two.prefix(data)
        size = (self.end - self.begin).astype(np.uint64)
        one, two = (mix(r.stretch(s, self.begin, self.end) + size) for r, s in zip((_one, _two), byte))
        k = anchor_words(threshold)
        parts = []
        for at in range(0, n - threshold + 1, STRETCH):
            a, b = one[at : at + STRETCH + threshold - 1], two[at : at + STRETCH + threshold - 1]
            first, second = _sums(_one, a), _sums(_two, b)
            m = len(a) - k + 1
            grams = mix((first[k:] - first[:m]) * _one.down[:m])
            low = sliding_min((grams & ~_POS) | np.arange(m, dtype=np.uint64), threshold - k + 1)
            lo = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
            number = np.diff(np.r_[lo, len(low)])
            whole = mix(_two.stretch(second, lo, lo + number + threshold - 1) + number.astype(np.uint64))
            parts.append((lo + at, number, grams[(low[lo] & _POS).astype(np.int64)], whole))
        self.lo, self.count, self.first, self.second = (np.concatenate(c) for c in zip(*parts))

    def keys(self) -> np.ndarray:
        """Anchor and content of each run."""
        return np.stack([self.first.view(np.int64), self.second.view(np.int64)])


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


#: kind 0: the run may be its anchor's earliest; 1: a smaller document of the batch has it; 2: another text of the same key has it.
_KEYS = "first long, second long, d long, h long, kind int"


def _kinds(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows (first, second, d, h) in order, and their kinds among themselves."""
    rows = rows[:, np.lexsort(rows[::-1])]
    rows = rows[:, np.r_[True, (rows[:, 1:] != rows[:, :-1]).any(axis=0)]]
    new = np.r_[True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)]
    head = rows[2, np.maximum.accumulate(np.where(new, np.arange(rows.shape[1]), 0))]
    return rows, np.where(new, 0, np.where(rows[2] > head, 1, 2)).astype(np.int32)


def _run_keys(docs: DataFrame, threshold: int) -> DataFrame:
    """Each document's distinct runs: anchor, content, key, hash, and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros((4, 0), np.int64)]
            for d, h, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                runs = Runs(_raw(text), threshold)
                n = len(runs.lo)
                if n:
                    found.append(np.concatenate([runs.keys(), np.stack([np.full(n, d), np.full(n, h)])]))
            rows = np.concatenate(found, axis=1)
            if rows.shape[1]:
                rows, kind = _kinds(rows)
                yield pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(kind)], names=["first", "second", "d", "h", "kind"])
        release()

    return docs.select("d", "h", "text").mapInArrow(run, _KEYS)


def _meet(keys: DataFrame, parts: int) -> DataFrame:
    """Runs by kind. 1: a smaller document has it whole; 0: the earliest of its content, where its anchor has others; 2: as before.

    Rows stream in order past a state of one row. What a batch has told already
    is dealt by its own place, so that a hot passage does not meet in one task.
    """
    dealt = keys.repartition(parts, F.when(F.col("kind") == 0, F.col("first")).otherwise(F.xxhash64("first", "d", "h")))
    ordered = dealt.sortWithinPartitions("kind", "first", "second", "d", "h")
    names = ["first", "second", "d", "h", "kind"]

    def made(rows: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(kind.astype(np.int32))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The earliest row of the last content, and whether it may still have to be told.
        last, untold = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:4]])
            kind = batch.column(4).to_numpy()
            if (kind > 0).any():
                yield made(rows[:, kind > 0], kind[kind > 0])
                rows = rows[:, kind == 0]  # they come first
                if not rows.shape[1]:
                    continue
            if last is not None:
                rows = np.concatenate([last[:, None], rows], axis=1)
            index = np.arange(rows.shape[1])
            new_first = np.r_[True, rows[0, 1:] != rows[0, :-1]]
            new = new_first | np.r_[True, rows[1, 1:] != rows[1, :-1]]
            head = np.maximum.accumulate(np.where(new, index, 0))
            told = np.zeros(len(index), bool)
            later = new & ~new_first
            told[later] = True
            told[np.maximum.accumulate(np.where(new_first, index, 0))[later]] = True
            told[0] &= untold
            end = head[-1]
            untold = bool(new_first[end] and not told[end] and (end > 0 or untold))
            last = rows[:, end].copy()
            smaller = ~new & (rows[2] > rows[2, head])
            same = ~new & ~smaller & (rows[3] != rows[3, head])
            out = np.concatenate([rows[:, told], rows[:, smaller], rows[:, same]], axis=1)
            if out.shape[1]:
                yield made(out, np.repeat([0, 1, 2], [told.sum(), smaller.sum(), same.sum()]))

    return ordered.mapInArrow(run, _KEYS)


def _contents(docs: DataFrame, lists: DataFrame, threshold: int) -> DataFrame:
    """The words of the runs that lists names: first, second, d, h, words (as they stand in the text)."""
    joined = docs.join(lists.hint("shuffle_hash"), ["d", "h"]).select("d", "h", "text", "runs.first", "runs.second")
    kinds = [pa.int64()] * 4 + [pa.binary()]
    names = ["first", "second", "d", "h", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, h, text, first, second in zip(*(c.to_pylist() for c in batch.columns)):
                raw, wanted = _raw(text), set(zip(first, second))
                runs = Runs(raw, threshold)
                for a, b, lo, n in zip(*runs.keys().tolist(), runs.lo.tolist(), runs.count.tolist()):
                    if (a, b) in wanted:
                        wanted.remove((a, b))
                        rows.append((a, b, d, h, raw[runs.begin[lo] : runs.end[lo + n + threshold - 2]]))
            cols = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)
        release()

    return joined.mapInArrow(run, "first long, second long, d long, h long, words binary")


def matched_windows(texts: Sequence[bytes], owner: np.ndarray, threshold: int) -> np.ndarray:
    """For each text the windows, as bits, whose words also stand in a text of a smaller owner."""
    codes: defaultdict[bytes, int] = defaultdict(count(1).__next__)
    words = [np.fromiter(map(codes.__getitem__, t.split()), np.int64) for t in texts]
    masks = np.zeros(len(words), np.int64)
    for text, at, m in Index(words, owner).statistics(threshold):
        hit = m >= threshold
        masks[text[hit]] |= np.int64(1) << at[hit]
    return masks


_FOUND = "first long, second long, d long, h long, mask long"


def _search(contents: DataFrame, parts: int, threshold: int) -> DataFrame:
    """The matched windows of each run, by the shards' indexes: first, second, d, h, mask."""
    ordered = contents.repartition(parts, "first").sortWithinPartitions("first", "second")

    def found(keys: list[list[int]], texts: list[bytes]) -> pa.RecordBatch:
        masks = matched_windows(texts, np.array(keys[2], np.int64), threshold)
        hit = np.flatnonzero(masks)
        return pa.RecordBatch.from_arrays([*(pa.array(np.array(k, np.int64)[hit]) for k in keys), pa.array(masks[hit])], names=["first", "second", "d", "h", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], []]
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= SHARD_WORDS and row[0] != held[0][-1]:
                    yield found(held[:4], held[4])
                    held, size = [[], [], [], [], []], 0
                for c, v in zip(held, row):
                    c.append(v)
                size += len(row[4].split()) + 1
        if held[0]:
            yield found(held[:4], held[4])
        release()

    return ordered.mapInArrow(run, _FOUND)


def _compare_hot(contents: DataFrame, threshold: int) -> DataFrame:
    """As _search, for anchors with too many differing runs for one shard: each window meets its likes by 128 bits of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, second, d, h, words in zip(*(c.to_pylist() for c in batch.columns)):
                split = words.split()
                windows = [hashlib.blake2b(b" ".join(split[i : i + threshold]), digest_size=16).digest() for i in range(len(split) - threshold + 1)]
                n = len(windows)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.full(n, v)) for v in (first, second, d, h)), pa.array(1 << np.arange(n, dtype=np.int64)), pa.array(windows, pa.binary())],
                    names=["first", "second", "d", "h", "bit", "window"],
                )

    windows = materialise(contents.mapInArrow(run, "first long, second long, d long, h long, bit long, window binary"), "passage-windows")
    least = windows.groupBy("window").agg(F.min("d").alias("least"))
    later = windows.join(least, "window").where("d > least")
    return later.groupBy("first", "second", "d", "h").agg(F.bit_or("bit").alias("mask"))


def remove_passages(
    docs: DataFrame, threshold: int = 50, key: str = "doc_id", text: str = "text", kept: bool = True, max_group: int = MAX_GROUP
) -> DataFrame:
    """docs with n_words, n_removed, kept_sha256, and kept, the words left joined by one space; such columns are replaced.

    Words are what ASCII white space leaves. Removed is every word covered by a
    window of ``threshold`` words that also starts in a document of a smaller key;
    a null key counts as the smallest, and documents of one key do not remove each
    other's words nor repeats of their own. Null and empty texts have no words.
    Repeated rows each get their result; an empty table stays empty. kept False
    leaves out the column of that name.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("n_words", "n_removed", "kept_sha256", "kept")
    original, place = docs.schema.fields, docs.columns.index(text)
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text], F.lit(0).alias("no column")).alias("row"),
        F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(1 << 63))).alias("d"), text_hash(f"`{text}`").alias("h"), F.col(f"`{text}`").alias("text"),
    )
    parts = shuffle_partitions(docs)
    met = materialise(_meet(_run_keys(keyed, threshold), parts), "passage-runs")

    earliest = met.where("kind = 0").drop("kind")
    hot = earliest.groupBy("first").agg(F.count("*").alias("n")).where(F.col("n") > max_group).select("first")
    lists = earliest.groupBy("d", "h").agg(F.collect_list(F.struct("first", "second")).alias("runs"))
    contents = _contents(keyed, lists, threshold)
    if hot.isEmpty():
        found = _search(contents, parts, threshold)
    else:
        contents = materialise(contents, "passage-contents")
        found = _search(contents.join(hot, "first", "left_anti"), parts, threshold)
        found = found.unionByName(_compare_hot(contents.join(hot, "first", "left_semi"), threshold))
    found = materialise(found, "passage-matches")

    results = met.where("kind = 1").drop("kind").withColumn("mask", F.lit(_WHOLE).cast("long")).unionByName(found)
    others = met.where("kind = 2").select("first", "second", "d", "h")
    if not others.isEmpty():
        # Other texts of a key share what its first text with that run was found to hold.
        results = results.unionByName(others.join(results.select("first", "second", "d", "mask").distinct(), ["first", "second", "d"]).select(*results.columns))
    spans = results.groupBy("d", "h").agg(F.collect_list(F.struct("first", "second", "mask")).alias("found"))
    joined = keyed.join(spans.hint("shuffle_hash"), ["d", "h"], "left").select("row", "text", "found")
    ddl = "n_words long, n_removed long, kept_sha256 string" + (", kept string" if kept else "")
    schema = T.StructType([*original, *T.StructType.fromDDL(ddl).fields])
    names, made = schema.names, [pa.int64(), pa.int64(), pa.string(), pa.string()][: 4 if kept else 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = _raw(t)
                words, n = raw.split(), 0
                if f:
                    gone = _removed(Runs(raw, threshold), f)
                    n = int(gone.sum())
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                left = b" ".join(words)
                out.append((n + len(words), n, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace")))
            cols: Sequence = list(zip(*out)) if out else [()] * 4
            rows = batch.column(0).flatten()[:-1]
            yield pa.RecordBatch.from_arrays([*rows[:place], batch.column(1), *rows[place:], *(pa.array(c, k) for c, k in zip(cols, made))], names=names)

    return joined.mapInArrow(run, schema)


def _removed(runs: Runs, found: list[dict]) -> np.ndarray:
    """Which words of a document go, by the matched windows of its runs."""
    masks: dict[tuple[int, int], int] = {}
    for f in found:
        key = (f["first"], f["second"])
        masks[key] = masks.get(key, 0) | f["mask"]
    edge = np.zeros(len(runs.begin) + 1, np.int64)
    for first, second, lo, n in zip(*runs.keys().tolist(), runs.lo.tolist(), runs.count.tolist()):
        mask = masks.get((first, second))
        if mask is None:
            continue
        windows = np.arange(lo, lo + n) if mask == _WHOLE else lo + np.flatnonzero(np.int64(mask) >> np.arange(n) & 1)
        np.add.at(edge, windows, 1)
        np.add.at(edge, windows + runs.threshold, -1)
    return np.cumsum(edge)[:-1] > 0
