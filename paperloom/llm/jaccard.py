"""Exact self-join of word n-gram sets by Jaccard similarity, and its groups.

1. Every document's set of hashed n-grams is reduced to a node: documents of one
   set share it, so copies are one node from the start. The same scan counts
   n-grams in a fixed table of buckets, over all documents.
2. The global order of n-grams puts those of rare buckets first, and the most
   common last. Linked sets share one of their first few n-grams in any such
   order (the prefix filter), so each node is filed under those; the order
   keeps lists short where many documents share a passage.
3. Sets carry the parities of their members in 512 buckets. Two sets differ in
   no more parities than members, which bounds their overlap from above at 64
   bytes a set. In a few turns over the long lists and an eighth of all, every node is
   verified against the list mate that may link with most others: groups of near
   copies become components at one pair a member, however large they are.
4. In all lists that hold several components, all pairs of different ones are
   put to the bound where they meet, and only those that it lets pass are
   emitted and verified. So no link is missed, and few pairs move.

Verification is a prefix-tree join: the sets to be compared with one set are
ordered as in a trie, which is traversed with the overlaps of shared prefixes
computed once, and subtrees whose remaining lengths cannot reach the needed
overlap are cut off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytehash import Rolling, mix
from .common import bucketed, materialise, release, shuffle_partitions, small_batches, text_hash
from .components import components

_U = np.uint64
BUCKET_BITS, SLICE_BITS = 22, 16
#: Sets verified against one other set in one go.
BLOCK_SETS = 256
PARITY_BITS = 512
#: Members of a list that meet in one task, on either side.
LIST_BLOCK = 4096
#: Turns over some lists before all are searched: one in so many, and all of so many rows.
TURNS, TURN_LISTS, LONG_LIST = 2, 8, 64

_words = Rolling(3, fold_case=True)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEPS = mix(np.arange(1, 65, dtype=_U)) | _U(1)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Ascending hashes of the distinct k-word n-grams; of all words as one if there are fewer."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, _U)
    word = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    n = len(start)
    if not n:
        return np.zeros(0, _U)
    own = mix(_words.stretch(_words.prefix(data), start, end) + (end - start).astype(_U))
    size = min(k, n)
    total = np.full(n - size + 1, _U(size))
    for j in range(size):
        total += own[j : n - size + 1 + j] * _STEPS[j % 64]
    return np.unique(mix(total))


def node_of(found: np.ndarray) -> int:
    """A set's own hash, as a signed 64-bit number."""
    return int(mix(np.array([mix(found ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U) + _U(len(found))], _U)).view(np.int64)[0])


def parities(found: np.ndarray) -> bytes:
    """Whether the members in each of PARITY_BITS buckets are odd in number."""
    return np.packbits(np.bincount((found >> _U(55)).astype(np.int64), minlength=PARITY_BITS) & 1).tobytes()


def _needed(n: np.ndarray | int, percent: int):
    """Fewest common members of a set of n and any set linked with it."""
    return -(-percent * n // 100)


def _scan(docs: DataFrame, k: int) -> DataFrame:
    """A row of (d, h, node, n, parity) for each document, and each task's bucket counts in slices."""
    schema = "d long, h long, node long, n int, parity binary, slice int, counts binary"
    names = ["d", "h", "node", "n", "parity", "slice", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.uint32)
        for batch in batches:
            sets = [shingles(t, k) for t in batch.column(2).to_pylist()]
            joined = np.concatenate([*sets, np.zeros(0, _U)])
            buckets, counts = np.unique(joined & _U((1 << BUCKET_BITS) - 1), return_counts=True)
            total[buckets] += counts.astype(np.uint32)
            m = len(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
                 pa.array([parities(s) for s in sets], pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names,
            )
        if total.any():
            coder = zstandard.ZstdCompressor(level=1)
            cut = [coder.compress(c.tobytes()) for c in total.reshape(-1, 1 << SLICE_BITS)]
            none = pa.nulls(len(cut), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, none, pa.nulls(len(cut), pa.int32()), pa.nulls(len(cut), pa.binary()), pa.array(range(len(cut)), pa.int32()), pa.array(cut, pa.binary())], names=names
            )
        release()

    return docs.select("d", "h", "text").mapInArrow(run, schema)


def _sum_slices(slices: DataFrame) -> np.ndarray:
    """The tasks' counts added up, as quarters of their binary logarithm: one byte a bucket.

    Slices stream past one accumulator each, however many tasks there were.
    """
    n = 1 << (BUCKET_BITS - SLICE_BITS)
    ordered = slices.repartition(n, "slice").sortWithinPartitions("slice")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, at, total = zstandard.ZstdDecompressor(), None, None

        def done() -> pa.RecordBatch:
            ranks = np.round(4 * np.log2(total + 1.0)).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([ranks.tobytes()])], names=["slice", "ranks"])

        for batch in batches:
            for s, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if s != at:
                    if at is not None:
                        yield done()
                    at, total = s, np.zeros(1 << SLICE_BITS, np.uint64)
                total += np.frombuffer(coder.decompress(counts), np.uint32)
        if at is not None:
            yield done()

    out = np.zeros(1 << BUCKET_BITS, np.uint8)
    for row in ordered.mapInArrow(run, "slice int, ranks binary").collect():  # one byte for each of a fixed number of buckets
        out[row["slice"] << SLICE_BITS : (row["slice"] + 1) << SLICE_BITS] = np.frombuffer(row["ranks"], np.uint8)
    return out


def _prefixes(docs: DataFrame, k: int, percent: int, rank) -> DataFrame:
    """(gram, node, n) for the first members of each node's set in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = rank.value
        for batch in batches:
            grams, nodes, sizes, seen = [], [], [], set()
            for text in batch.column(0).to_pylist():
                found = shingles(text, k)
                n = len(found)
                if not n:
                    continue
                node = node_of(found)
                if node in seen:
                    continue
                seen.add(node)
                first = n - _needed(n, percent) + 1
                late = order[(found & _U((1 << BUCKET_BITS) - 1)).astype(np.int64)]
                if late.any():
                    found = found[np.argsort(late, kind="stable")]
                grams.append(found[:first])
                nodes.append(np.full(first, node))
                sizes.append(np.full(first, n, np.int32))
            if grams:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes))], names=["gram", "node", "n"]
                )
        release()

    return docs.select("text").mapInArrow(run, "gram long, node long, n int")


def _shared(prefixes: DataFrame, parts: int) -> DataFrame:
    """The rows of lists that hold several nodes, without repeats.

    Rows stream past in order; a list costs no memory however long it is.
    """
    ordered = prefixes.repartition(parts, "gram").sortWithinPartitions("gram", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the last list's first row and last node, and whether the first row has been passed on
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            lead = 0
            if last is not None:
                lead = 2
                rows = np.concatenate([last[0][:, None], last[1][:, None], rows], axis=1)
            gram, node, index = rows[0], rows[1], np.arange(rows.shape[1])
            new = np.r_[True, gram[1:] != gram[:-1]]
            head = np.maximum.accumulate(np.where(new, index, 0))
            other = ~new & (node != node[np.maximum(index - 1, 0)])
            other[:lead] = False  # these were seen before
            tell_head = np.zeros(len(index), bool)
            tell_head[head[other]] = True
            if last is not None and last[2]:
                tell_head[0] = False
            keep = other | tell_head
            h = head[-1]
            passed = bool(tell_head[h] or (h == 0 and last is not None and last[2]))
            last = (rows[:, h].copy(), rows[:, -1].copy(), passed)
            if keep.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram[keep]), pa.array(node[keep]), pa.array(rows[2][keep])], names=["gram", "node", "n"]
                )

    return ordered.mapInArrow(run, "gram long, node long, n long")


def _blocks(rows: DataFrame, long: DataFrame, hubs: bool, size: int = LIST_BLOCK) -> DataFrame:
    """rows with the pair of blocks (x, y) of their list in which they meet others, and their own block.

    Lists of more than ``size`` rows are dealt to blocks by node; each pair of blocks is a task's
    work, so no list has to fit one task. Hubs are chosen within blocks.
    """
    several = long.where(F.col("long") > size).select("gram", F.ceil(F.col("long") / size).cast("int").alias("blocks"))
    dealt = rows.join(several, "gram", "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("node"), "blocks").cast("int"), F.lit(0)))
    if hubs:
        return dealt.select("*", F.col("own").alias("x"), F.col("own").alias("y"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    return dealt.select("*", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))


def _list_pairs(rows: DataFrame, long: DataFrame, parts: int, percent: int, hubs: bool) -> DataFrame:
    """Plausible pairs (a, b) of nodes of one list and different roots.

    Plausible are pairs whose sizes and parities allow a link, and that meet in
    as many lists as their sizes ask for. With hubs, for each node b only the
    partner a that has most plausible partners itself. Input: gram, node, n, root, parity; long: the sizes of long lists.
    """
    dealt = _blocks(rows, long, hubs).repartition(parts, "gram", "x", "y").sortWithinPartitions("gram", "x", "y", "n", "node")
    ordered = dealt.select("gram", "x", "y", "node", "n", "root", "own", "parity")
    block = 64

    def pairs(node: np.ndarray, n: np.ndarray, root: np.ndarray, own: np.ndarray, across: bool, parity: np.ndarray) -> tuple[np.ndarray, ...]:
        def plausible() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for at in range(0, len(node), block):
                a = np.arange(at, min(at + block, len(node)))
                # Sizes ascend, so partners of a row end where sizes exceed its reach.
                b = np.arange(at, int(np.searchsorted(n, n[a[-1]] * 100 // percent, side="right")))
                both = n[a][:, None] + n[b][None, :]
                apart = np.bitwise_count(parity[a][:, None, :] ^ parity[b][None, :, :]).sum(axis=2, dtype=np.int64)
                ok = (b[None, :] > a[:, None]) & (root[a][:, None] != root[b][None, :]) & (n[b][None, :] * percent <= n[a][:, None] * 100)
                ok &= (both - apart) * (100 + percent) >= 2 * percent * both
                if across:  # pairs within a block meet where it meets itself
                    ok &= own[a][:, None] != own[b][None, :]
                if ok.any():
                    yield a, b, ok

        if not hubs:
            found = [(node[a[i]], node[b[j]], n[a[i]], n[b[j]]) for a, b, ok in plausible() for i, j in (np.nonzero(ok),)]
            return tuple(np.concatenate(c) for c in zip(*found)) if found else ()
        degree = np.zeros(len(node), np.int64)
        for a, b, ok in plausible():
            degree[a] += ok.sum(axis=1)
            degree[b] += ok.sum(axis=0)
        best, mate = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
        for a, b, ok in plausible():
            for mine, others, most in ((a, b, np.where(ok, degree[b][None, :], 0)), (b, a, np.where(ok, degree[a][:, None], 0).T)):
                at = most.argmax(axis=1)
                top = most[np.arange(len(mine)), at]
                more = top > best[mine]
                best[mine[more]] = top[more]
                mate[mine[more]] = others[at[more]]
        hit = np.flatnonzero(best)
        return (node[mate[hit]], node[hit], best[hit], best[hit]) if len(hit) else ()

    def lists(cols: list[np.ndarray], parity: np.ndarray) -> Iterator[pa.RecordBatch]:
        gram, x, y, node, n, root, own = cols
        bounds = np.flatnonzero(_changes(cols))
        out = []
        for lo, hi in zip(bounds, [*bounds[1:], len(gram)]):
            if hi - lo > 1 and (root[lo:hi] != root[lo]).any() and (got := pairs(node[lo:hi], n[lo:hi], root[lo:hi], own[lo:hi], x[lo] != y[lo], parity[lo:hi])):
                out.append(got)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["a", "b", "x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 7
        marks = np.zeros((0, PARITY_BITS // 64), _U)
        for batch in batches:
            if not batch.num_rows:
                continue
            held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns)]
            marks = np.concatenate([marks, np.frombuffer(b"".join(batch.column(7).to_pylist()), _U).reshape(batch.num_rows, -1)])
            cut = int(np.flatnonzero(_changes(held))[-1])  # the last pair of blocks may go on
            if cut:
                yield from lists([h[:cut] for h in held], marks[:cut])
                held, marks = [h[cut:] for h in held], marks[cut:]
        if len(marks):
            yield from lists(held, marks)

    found = ordered.mapInArrow(run, "a long, b long, x long, y long")
    if hubs:
        return found.groupBy("b").agg(F.max_by("a", F.struct("x", "a")).alias("a")).select("a", "b")
    first = F.col("a") < F.col("b")
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(first, F.col("x")).otherwise(F.col("y")).alias("na"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("nb"))
    found = found.groupBy("a", "b").agg(F.count("*").alias("common"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    # Common members are in both prefixes, or beyond the prefix that ends first.
    beyond = F.greatest(*[F.ceil(F.col(n) * percent / 100) - 1 for n in ("na", "nb")])
    return found.where((F.col("common") + beyond) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b")


def _changes(cols: list[np.ndarray]) -> np.ndarray:
    """Where the first three columns differ from the row before."""
    return np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])]


def _several_roots(rows: DataFrame, long: DataFrame, parts: int) -> DataFrame:
    """The rows of lists that hold several roots.

    Lists of up to a block of rows stream past, roots of a list in order; longer
    ones, which no task may hold or read alone, are told by their least and greatest root.
    """
    names = ["gram", "node", "n", "root"]
    longer = long.where(F.col("long") > LIST_BLOCK).select("gram")
    if not longer.isEmpty():
        hot = rows.join(longer, "gram", "left_semi").select(*names)
        mixed = hot.groupBy("gram").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("gram")
        return _several_roots(rows.join(longer, "gram", "left_anti"), long.limit(0), parts).unionByName(hot.join(mixed, "gram", "left_semi"))
    ordered = rows.repartition(parts, "gram").sortWithinPartitions("gram", "root").select("gram", "node", "n", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last list while they have one root only
        gram = root = None
        several = False
        for batch in batches:
            if not batch.num_rows:
                continue
            g, r = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 3))
            bounds = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
            keep = np.zeros(len(g), bool)
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                if g[lo] != gram:
                    held, several, gram, root = [], False, g[lo], r[lo]
                if not several and (r[lo] != root or r[lo] != r[hi - 1]):
                    several = True
                    yield from held
                    held = []
                if several:
                    keep[lo:hi] = True
                elif hi == len(g):
                    held.append(batch.slice(lo, hi - lo))
            if keep.any():
                yield batch.filter(pa.array(keep))

    return ordered.mapInArrow(run, "gram long, node long, n long, root long")


def trie_links(one: np.ndarray, others: list[np.ndarray], percent: int) -> list[int]:
    """Which of the ascending arrays others are linked with one.

    Sorted lexicographically, the arrays that share a prefix are a range, and
    its first and last array share no more than all do: ranges are the trie's
    nodes. A node's overlap is added to its parent's.
    """
    order = sorted(range(len(others)), key=lambda i: others[i].astype(">u8").tobytes())
    sets = [others[i] for i in order]
    size = np.array([len(s) for s in sets])
    out, stack = [], [(0, len(sets), 0, 0)]
    while stack:
        lo, hi, depth, overlap = stack.pop()
        first, last = sets[lo], sets[hi - 1]
        most = min(len(first), len(last))
        apart = np.flatnonzero(first[depth:most] != last[depth:most])
        deep = depth + int(apart[0]) if len(apart) else most
        at = np.searchsorted(one, first[depth:deep])
        inside = at < len(one)
        overlap += int((one[at[inside]] == first[depth:deep][inside]).sum())
        # What one still has: the members after those passed, of which the last counts only if it was met.
        used = int(at[-1]) + int(at[-1] < len(one) and one[at[-1]] == first[deep - 1]) if len(at) else 0
        longest, shortest = int(size[lo:hi].max()), int(size[lo:hi].min())
        reach = overlap + min(longest - deep, max(0, len(one) - used) if len(at) else len(one))
        if reach * (100 + percent) < percent * (len(one) + shortest):
            continue
        while lo < hi and size[lo] == deep:  # sets that end here come first
            if overlap * (100 + percent) >= percent * (len(one) + deep):
                out.append(order[lo])
            lo += 1
        begin = lo
        for x in range(lo + 1, hi + 1):
            if x == hi or sets[x][deep] != sets[begin][deep]:
                if begin < hi:
                    stack.append((begin, x, deep, overlap))
                begin = x
    return out


def _flags(keys: DataFrame) -> np.ndarray:
    """Which of a fixed number of buckets some key falls into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.uint32)
        for batch in batches:
            total[batch.column(0).to_numpy(zero_copy_only=False) & ((1 << BUCKET_BITS) - 1)] = 1
        if total.any():
            coder = zstandard.ZstdCompressor(level=1)
            cut = [coder.compress(c.tobytes()) for c in total.reshape(-1, 1 << SLICE_BITS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array(cut, pa.binary())], names=["slice", "counts"])

    return _sum_slices(keys.mapInArrow(run, "slice int, counts binary")) > 0


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, members) of wanted nodes, each with the hash h of a text that has its set.

    Texts are scanned where they lie: a table of flags of fixed size tells the
    scan which may be wanted, and only their sets are dealt out.
    """
    flags = docs.sparkSession.sparkContext.broadcast(np.packbits(_flags(wanted.select("h"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(flags.value)
        for batch in batches:
            maybe = bits[batch.column(0).to_numpy(zero_copy_only=False) & ((1 << BUCKET_BITS) - 1)]
            seen: dict[int, bytes] = {}
            for i in np.flatnonzero(maybe):
                found = shingles(batch.column(1)[int(i)].as_py(), k)
                if len(found):
                    seen[node_of(found)] = found.tobytes()
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.binary())], names=["node", "members"])
        release()

    found = docs.select("h", "text").mapInArrow(run, "node long, members binary")
    found = found.join(wanted.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("members").alias("members"))
    return bucketed(found, "node", shuffle_partitions(docs), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """Those of the pairs (a, b) that are linked, as (a, b)."""
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK_SETS).alias("blocks"))
    dealt = pairs.join(blocks, "a").select("a", F.pmod(F.xxhash64("b"), "blocks").alias("block"), "b")
    left = dealt.select("a", "block").distinct().join(sets, F.col("a") == F.col("node")).select("a", "block", F.lit(None).cast("long").alias("b"), "members")
    right = dealt.join(sets, F.col("b") == F.col("node")).select("a", "block", "b", "members")
    ordered = left.unionByName(right).repartition(parts, "a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, one, nodes, others = None, None, [], []

        def done() -> pa.RecordBatch:
            hit = [nodes[i] for i in trie_links(one, others, percent)] if others else []
            return pa.RecordBatch.from_arrays([pa.array([at[0]] * len(hit), pa.int64()), pa.array(hit, pa.int64())], names=["a", "b"])

        for batch in batches:
            for a, block, b, members in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, block) != at:
                    if at is not None:
                        yield done()
                    at, nodes, others = (a, block), [], []
                found = np.frombuffer(members, _U)
                if b is None:
                    one = found
                else:
                    nodes.append(b)
                    others.append(found)
        if at is not None:
            yield done()

    return ordered.mapInArrow(run, "a long, b long")


def _members(docs: DataFrame, k: int, percent: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(d, h, n, root) of each row, and (root, least) of each root that several rows share: least is their smallest key."""
    spark = docs.sparkSession
    small_batches(spark)
    keyed = docs.select(F.col(key).cast("long").alias("d"), text_hash(text).alias("h"), F.col(text).alias("text"))
    parts = shuffle_partitions(keyed)
    scanned = materialise(_scan(keyed, k), "ngram-scan")
    rows = scanned.where("slice IS NULL").select("d", "h", "node", "n")
    nodes = scanned.where("slice IS NULL AND n > 0").groupBy("node").agg(F.min("h").alias("h"), F.first("n").alias("n"), F.first("parity").alias("parity"))
    nodes = materialise(nodes, "ngram-nodes")
    counted = _sum_slices(scanned.where("slice IS NOT NULL").select("slice", "counts"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    # Buckets beyond twice the mean and a margin hold common n-grams.
    usual = 4 * np.log2(2 * total / (1 << BUCKET_BITS) + 64)
    rank = spark.sparkContext.broadcast(np.maximum(counted - usual, 0).astype(np.uint8))
    lists = materialise(_shared(_prefixes(keyed, k, percent, rank), parts), "ngram-lists")

    marks = nodes.select("node", "parity")
    ends = lambda pairs: pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()

    def sets_of(found: DataFrame) -> DataFrame:
        return _sets(keyed, materialise(found.join(nodes, "node").select("node", "h"), "wanted"), k)

    long = materialise(lists.groupBy("gram").agg(F.count("*").alias("long")).where(F.col("long") >= LONG_LIST), "long-lists")
    near = sets = None
    for turn in range(TURNS):
        some = lists.join(long, "gram", "left").where((F.pmod(F.xxhash64("gram"), F.lit(TURN_LISTS)) == turn) | F.col("long").isNotNull()).drop("long")
        if near is None:
            rooted = some.withColumn("root", F.col("node"))
        else:
            rooted = some.join(sets.select("node"), "node", "left_semi").join(near, "node", "left").select("gram", "node", "n", F.coalesce("root", "node").alias("root"))
        pairs = materialise(_list_pairs(rooted.join(marks, "node"), long, parts, percent, hubs=True), "pairs")
        if sets is None:
            sets = sets_of(ends(pairs))
        found = _verified(pairs, sets, percent, parts)
        if near is not None:
            found = found.unionByName(near.select(F.col("node").alias("a"), F.col("root").alias("b")))
        near = components(found)

    rooted = lists.join(near, "node", "left").select("gram", "node", "n", F.coalesce("root", "node").alias("root"))
    pairs = _list_pairs(_several_roots(rooted, long, parts).join(marks, "node"), long, parts, percent, hubs=False)
    pairs = materialise(pairs, "pairs")
    rest = sets_of(ends(pairs).join(sets.select("node"), "node", "left_anti"))
    far = _verified(pairs, sets.unionByName(rest), percent, parts)
    roots = components(near.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(far))

    member = rows.join(roots, "node", "left").select("d", "h", "n", F.when(F.col("n") > 0, F.coalesce("root", "node")).alias("root"))
    least = member.where("n > 0").groupBy("root").agg(F.min("d").alias("least"), F.count("*").alias("size"))
    return member, least.where("size > 1").select("root", "least")


def groups(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_shingles, component_id, text_hash.

    Documents link when 100 times their common n-grams are at least ``percent``
    times those in either. component_id is the smallest key reachable by links.
    Null, empty and blank texts have no n-grams and link with nothing; for them,
    and for all without a partner, component_id is their own key. Repeated rows
    get equal rows. A null key is smaller than no other: a group that has keys
    takes the smallest of them.
    """
    member, several = _members(docs, k, percent, key, text)
    out = member.join(several, "root", "left")
    return out.select(
        F.col("d").alias(key), F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "d").alias("component_id"), F.col("h").alias("text_hash")
    )


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group: that of the smallest key, and of its texts the one of smallest hash.

    Every row without a partner stays, whatever other rows share its key or
    have none; so do all rows of null, empty and blank texts.
    """
    member, several = _members(docs, k, percent, key, text)
    none = F.lit(-(1 << 63))  # stands for a null key, so that both sides are dealt by plain columns
    grouped = member.join(several, "root").select("root", "d", "h", F.col("d").eqNullSafe(F.col("least")).alias("least"))
    first = grouped.where("least").groupBy("root").agg(F.min("h").alias("first"))
    fate = grouped.join(first, "root").select(F.coalesce("d", none).alias("_key"), F.col("h").alias("_hash"), (F.col("least") & (F.col("h") == F.col("first"))).alias("_first"))
    fate = fate.groupBy("_key", "_hash").agg(F.max("_first").alias("_first"))
    left = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(key).cast("long"), none).alias("_key"), text_hash(text).alias("_hash"))
    dealt = left.join(fate, ["_key", "_hash"], "left").where("_first IS NULL OR _first")
    # Only the survivors' own repeats are dropped: rows without a partner are told apart.
    dealt = dealt.withColumn("_row", F.when(F.col("_first").isNull(), F.monotonically_increasing_id()))
    return dealt.dropDuplicates(["_key", "_hash", "_row"]).select("row.*")
