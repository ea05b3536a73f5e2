"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only as far as ``threshold`` bytes, by passes over digits,
most significant first, and only members of groups that are still shared go on
to the next pass. What is equal after the last pass are the repeated windows.

Sorting every suffix of every text through exchanges would move twenty bytes and
more a byte of text, so the first two passes sort a sample of the suffixes that
stands for all of them. Every window of ``threshold`` bytes is filed under one of
its own ``digit``-byte strings: the one of the smallest hash. Neighbouring windows
mostly share it, and make one *run*; equal windows always share it.

1. First pass: runs are dealt by a fingerprint of the string they are filed under.
2. Second pass: within it they are ordered by a fingerprint of all bytes that the
   run's windows cover. A run that equals an earlier one repeats it whole (this
   is told by both fingerprints, 128 bits, and not by the bytes).
3. Where one string has runs that differ, their bytes are sent, once, and all
   their suffixes are sorted as far as ``threshold`` bytes: by eight bytes at a
   time, from the left, each pass taking only members of groups still shared.

Of equal runs in one batch of documents only the earliest is dealt by its string;
the others are known to be repeats there and then, and are dealt by their own
place. So a string that everything holds does not meet in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytehash import Rolling, mix, sliding_min
from .common import materialise, release, shuffle_partitions, small_batches, text_hash

#: Documents are scanned in stretches of so many windows, which bounds memory.
STRETCH = 1 << 19
#: Positions within a stretch take the low bits of a sort key.
_POS = np.uint64((1 << 20) - 1)
#: A first digit with more differing runs than this sends its windows through an exchange of their own.
MAX_GROUP = 50_000

_one, _two = Rolling(1), Rolling(2)


class Runs:
    """The runs of one document: first window, number of windows, and both digits."""

    def __init__(self, data: np.ndarray, threshold: int) -> None:
        digit = max(1, min(32, threshold // 3))
        width = threshold - digit + 1
        parts = []
        for at in range(0, max(0, len(data) - threshold + 1), STRETCH):
            piece = data[at : at + STRETCH + threshold - 1]
            sums = _one.prefix(piece)
            n = len(piece) - digit + 1
            grams = mix((sums[digit:] - sums[:n]) * _one.down[:n])
            low = sliding_min((grams & ~_POS) | np.arange(n, dtype=np.uint64), width)
            lo = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
            count = np.diff(np.r_[lo, len(low)])
            whole = mix(_one.stretch(sums, lo, lo + count + threshold - 1) + count.astype(np.uint64))
            parts.append((lo + at, count, grams[(low[lo] & _POS).astype(np.int64)], whole))
        self.lo, self.count, self.first, self.second = (
            [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, k) for k in (np.int64, np.int64, np.uint64, np.uint64)]
        )

    def repeats(self) -> np.ndarray:
        """Which runs equal an earlier run of the same document."""
        out = np.ones(len(self.lo), bool)
        out[np.unique(self.first + mix(self.second), return_index=True)[1]] = False
        return out


def _data(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _combined(rows: np.ndarray, copies: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows (first, second, d, h, lo) in order: the earliest of each (first, second), and all that repeat one.

    With copies, rows of the earliest's own document (key and hash) are copies of it and left out; else they repeat it.
    """
    rows = rows[:, np.lexsort(rows[::-1])]
    new = np.r_[True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)]
    head = rows[2 : 4 if copies else 5, np.maximum.accumulate(np.where(new, np.arange(rows.shape[1]), 0))]
    return rows[:, new], rows[:, ~new & (rows[2 : 4 if copies else 5] != head).any(axis=0)]


def _key_batch(heads: np.ndarray, again: np.ndarray) -> pa.RecordBatch:
    """Both kinds of rows as one batch: first, second, d, h, lo, again."""
    rows = np.concatenate([heads, again], axis=1)
    mark = np.repeat(np.array([0, 1], np.int32), [heads.shape[1], again.shape[1]])
    return pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(mark)], names=["first", "second", "d", "h", "lo", "again"])


_KEYS = "first long, second long, d long, h long, lo long, again int"


def _sort_keys(docs: DataFrame, threshold: int) -> DataFrame:
    """first, second, d, h, lo of each document's distinct runs, and whether one repeats an earlier one of its batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros((5, 0), np.int64)]
            for d, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                runs = Runs(_data(text), threshold)
                new = ~runs.repeats()
                n = int(new.sum())
                found.append(np.stack([runs.first[new].view(np.int64), runs.second[new].view(np.int64), np.full(n, d), np.full(n, h), runs.lo[new]]))
            rows = np.concatenate(found, axis=1)
            if rows.shape[1]:
                yield _key_batch(*_combined(rows, copies=True))
        release()

    return docs.select("d", "h", "text").mapInArrow(run, _KEYS)


def _pass(keys: DataFrame, parts: int, differing: bool) -> DataFrame:
    """Equal (first, second) beyond the earliest; kind 0. With differing, kind 1: the
    earliest of each second digit, where a first digit has several.

    Rows stream in order past a state of one row, so a hot digit costs no memory.
    Rows of the earliest's own document are that document's copies in the table.
    Rows that are known to repeat another are dealt by their own place, and pass.
    """
    dealt = keys.repartition(parts, F.when(F.col("again") == 0, F.col("first")).otherwise(F.xxhash64("d", "h", "lo")))
    ordered = dealt.sortWithinPartitions("again", "first", "second", "d", "h", "lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The earliest row of the last pair of digits, and whether it may still have to be told.
        head_row, untold = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:5]])
            known = rows[:, batch.column(5).to_numpy() == 1]
            if known.shape[1]:
                yield pa.RecordBatch.from_arrays([*(pa.array(known[k]) for k in (0, 2, 3, 4)), pa.array(np.zeros(known.shape[1], np.int32))], names=["first", "d", "h", "lo", "kind"])
                rows = rows[:, : rows.shape[1] - known.shape[1]]  # they come last
                if not rows.shape[1]:
                    continue
            if head_row is not None:
                rows = np.concatenate([head_row[:, None], rows], axis=1)
            first, second, index = rows[0], rows[1], np.arange(rows.shape[1])
            new_first = np.r_[True, first[1:] != first[:-1]]
            new = new_first | np.r_[True, second[1:] != second[:-1]]
            head = np.maximum.accumulate(np.where(new, index, 0))
            other = (rows[2] != rows[2][head]) | (rows[3] != rows[3][head])
            if not differing:  # windows of one document may repeat each other
                other |= rows[4] != rows[4][head]
            told = np.zeros(len(index), bool)
            if differing:
                later = new & ~new_first
                told[later] = True
                told[np.maximum.accumulate(np.where(new_first, index, 0))[later]] = True
                told[0] &= untold
            last = head[-1]
            untold = bool(new_first[last] and not told[last] and (last > 0 or untold))
            head_row = rows[:, last].copy()
            again = ~new & other
            made = np.concatenate([rows[:, again], rows[:, told]], axis=1)
            kind = np.repeat(np.array([0, 1], np.int32), [again.sum(), told.sum()])
            if len(kind):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(made[0]), pa.array(made[2]), pa.array(made[3]), pa.array(made[4]), pa.array(kind)], names=["first", "d", "h", "lo", "kind"]
                )

    return ordered.mapInArrow(run, "first long, d long, h long, lo long, kind int")


def _surroundings(docs: DataFrame, lists: DataFrame, threshold: int) -> DataFrame:
    """The bytes of the runs that lists names: first, d, h, lo, bytes."""
    joined = docs.join(lists.hint("shuffle_hash"), ["d", "h"]).select("d", "h", "text", "los")
    kinds = [pa.int64()] * 4 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, h, text, los in zip(*(c.to_pylist() for c in batch.columns)):
                data = _data(text)
                runs = Runs(data, threshold)
                at = np.searchsorted(runs.lo, np.unique(np.array(los, np.int64)))
                raw = data.tobytes()
                for first, lo, n in zip(runs.first[at].view(np.int64).tolist(), runs.lo[at].tolist(), runs.count[at].tolist()):
                    rows.append((first, d, h, lo, raw[lo : lo + n + threshold - 1]))
            cols = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["first", "d", "h", "lo", "bytes"])
        release()

    return joined.mapInArrow(run, "first long, d long, h long, lo long, bytes binary")


def _starts(rows: list[np.ndarray], stretches: list[bytes], threshold: int) -> tuple[np.ndarray, ...]:
    """All bytes of the stretches, and for each of their windows: its place in these, its row, and its start in the document."""
    size = np.array([len(s) for s in stretches])
    begin = np.cumsum(size) - size
    count = size - threshold + 1
    row = np.repeat(np.arange(len(size)), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.frombuffer(b"".join(stretches), np.uint8), begin[row] + step, row, rows[3][row] + step


def radix_groups(data: np.ndarray, at: np.ndarray, group: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes data[at:] of one group that agree on threshold bytes: indexes into at, and which set of several each is in.

    Digits of eight bytes are taken from the left; only suffixes that share all
    digits so far with another go on. Within a set, indexes ascend.
    """
    alive = np.arange(len(at))
    for depth in range(0, threshold, 8):
        # The last digit ends at the threshold: bytes that it has in common with the one before are equal already.
        lo = max(0, min(depth, threshold - 8))
        width = min(8, threshold - lo)
        digit = np.zeros(len(alive), np.uint64)
        for k in range(width):
            digit = (digit << np.uint64(8)) | data[at[alive] + lo + k]
        order = np.lexsort((digit, group))
        alive, group, digit = alive[order], group[order], digit[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])] if len(alive) else np.zeros(0, bool)
        group = np.cumsum(new)
        shared = np.bincount(group)[group] > 1 if len(alive) else new
        alive, group = alive[shared], group[shared]
    return alive, group


def _compare(stretches: DataFrame, parts: int, threshold: int) -> DataFrame:
    """Repeated windows among runs of one first digit: d, h, lo, last (both window starts)."""
    ordered = stretches.repartition(parts, "first").sortWithinPartitions("first", "d", "h", "lo")

    def spans(cols: list[np.ndarray], bytes_: list[bytes]) -> pa.RecordBatch:
        data, at, row, start = _starts(cols, bytes_, threshold)
        # Rows are in document order within a string, so the first of equal windows is the earliest.
        order, group = radix_groups(data, at, cols[0][row], threshold)
        same = np.r_[False, group[1:] == group[:-1]] if len(order) else np.zeros(0, bool)
        head = order[np.maximum.accumulate(np.where(~same, np.arange(len(order)), 0))]
        d, h = cols[1][row], cols[2][row]
        own = (d[order] == d[head]) & (h[order] == h[head]) & (start[order] == start[head])
        hit = np.sort(order[same & ~own])
        if not len(hit):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, names=["d", "h", "lo", "last"])
        cut = np.flatnonzero(np.r_[True, (row[hit[1:]] != row[hit[:-1]]) | (start[hit[1:]] != start[hit[:-1]] + 1)])
        end = np.r_[cut[1:], len(hit)] - 1
        return pa.RecordBatch.from_arrays(
            [pa.array(d[hit[cut]]), pa.array(h[hit[cut]]), pa.array(start[hit[cut]]), pa.array(start[hit[end]])], names=["d", "h", "lo", "last"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], []]
        for batch in batches:
            for c, v in zip(held, batch.columns):
                c.extend(v.to_pylist())
            # The last digit may go on in the next batch.
            cut = len(held[0])
            while cut and held[0][cut - 1] == held[0][-1]:
                cut -= 1
            if cut >= 2000:
                yield spans([np.array(c[:cut], np.int64) for c in held[:4]], held[4][:cut])
                held = [c[cut:] for c in held]
        if held[0]:
            yield spans([np.array(c, np.int64) for c in held[:4]], held[4])
        release()

    return ordered.mapInArrow(run, "d long, h long, lo long, last long")


def _compare_hot(stretches: DataFrame, parts: int, threshold: int) -> DataFrame:
    """As _compare, for strings with too many differing runs for one task: each window is dealt by two hashes of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:4]]
            data, at, row, start = _starts(cols, batch.column(4).to_pylist(), threshold)
            hashes = []
            for rolling in (_one, _two):
                hashes.append(mix(rolling.stretch(rolling.prefix(data), at, at + threshold)).view(np.int64))
            yield _key_batch(*_combined(np.stack([*hashes, cols[1][row], cols[2][row], start]), copies=False))

    keys = stretches.mapInArrow(run, _KEYS)
    return _pass(keys, parts, differing=False).select("d", "h", "lo", F.col("lo").alias("last"))


def remove_repeats(
    docs: DataFrame, threshold: int = 100, key: str = "doc_id", text: str = "text", kept: str | None = "bytes", max_group: int = MAX_GROUP
) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256, and kept; such columns are replaced.

    kept is what is left as "bytes", as "text" (without the characters that a
    cut went through), or not given (None).

    Removed is every byte covered by a string of ``threshold`` bytes that also
    starts earlier: in a document of smaller key, or in the same one before.
    A null key counts as the smallest; documents of equal key are ordered by
    their texts' hash; rows equal in key and text are one document, and each
    gets its result. A null text counts as empty. Matches never cross documents,
    and texts shorter than the threshold are kept whole.
    """
    small_batches(docs.sparkSession)
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    docs = docs.drop(*made)
    original, place = docs.schema.fields, docs.columns.index(text)
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"),
        F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("d"), text_hash(text).alias("h"), F.col(text).alias("text"),
    )
    parts = shuffle_partitions(docs)
    repeats = materialise(_pass(_sort_keys(keyed, threshold), parts, differing=True), "suffix-groups")

    differing = repeats.where("kind = 1")
    groups = differing.groupBy("first").agg(F.count("*").alias("n")).where(F.col("n") > max_group).select("first")
    lists = differing.groupBy("d", "h").agg(F.collect_list("lo").alias("los"))
    stretches = _surroundings(keyed, lists, threshold)
    if groups.isEmpty():
        windows = _compare(stretches, parts, threshold)
    else:
        calm = stretches.join(groups, "first", "left_anti")
        hot = stretches.join(groups, "first", "left_semi")
        windows = _compare(calm, parts, threshold).unionByName(_compare_hot(hot, parts, threshold))

    whole = repeats.where("kind = 0").select("d", "h", F.struct("lo", F.lit(-1).cast("long").alias("last")).alias("span"))
    spans = whole.unionByName(windows.select("d", "h", F.struct("lo", "last").alias("span")))
    spans = spans.groupBy("d", "h").agg(F.collect_list("span").alias("spans"))
    joined = keyed.join(spans.hint("shuffle_hash"), ["d", "h"], "left").select("row", "text", "spans")
    ddl = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + {None: "", "bytes": ", kept binary", "text": ", kept string"}[kept]
    schema = T.StructType([*original, *T.StructType.fromDDL(ddl).fields])
    names = schema.names
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary() if kept == "bytes" else pa.string())[: len(names) - len(original)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                *counts, left = _removed(t, s, threshold)
                found.append((*counts, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if kept == "text" else left))
            cols: Sequence = list(zip(*found)) if found else [()] * 5
            others = batch.column(0).flatten()
            yield pa.RecordBatch.from_arrays([*others[:place], batch.column(1), *others[place:], *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    return joined.mapInArrow(run, schema)


def _removed(text: str | None, spans: list[dict] | None, threshold: int) -> tuple[int, int, int, bytes]:
    data = _data(text)
    edge = np.zeros(len(data) + 1, np.int64)
    runs = Runs(data, threshold)
    again = runs.repeats()
    lo, last = [runs.lo[again]], [runs.lo[again] + runs.count[again] - 1]
    if spans:
        a = np.array([s["lo"] for s in spans], np.int64)
        b = np.array([s["last"] for s in spans], np.int64)
        run = b < 0
        b[run] = a[run] + runs.count[np.searchsorted(runs.lo, a[run])] - 1
        lo.append(a), last.append(b)
    np.add.at(edge, np.concatenate(lo), 1)
    np.add.at(edge, np.concatenate(last) + threshold, -1)
    gone = np.cumsum(edge)[:-1] > 0
    spans_n = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return len(data), int(gone.sum()), spans_n, data[~gone].tobytes()
