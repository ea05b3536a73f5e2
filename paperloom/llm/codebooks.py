"""Vector codes: each part of a vector as the index of its nearest codebook entry.

Codebooks are fitted in rounds, in integers throughout, so that results do not
depend on how rows are dealt. In a round the driver builds a kd-tree over each
codebook and broadcasts them (their size is fixed by entries and dimensions); tasks
assign their rows by branch and bound and send up integer sums, one row an entry;
Spark adds these up, and the driver floors sums by counts to the next entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, release, small_batches

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Entries of a kd-tree's leaf, and rows searched at once.
LEAF, STRIP = 8, 4096


def is_kept(vector: Column) -> Column:
    """Not null, and no component null, infinite or not a number."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def limit(dim: int) -> int:
    """Components are clamped to this, far beyond which a long could not hold a vector's error."""
    return int((2.0**62 / max(dim, 1)) ** 0.5) // 2


def integers(flat: np.ndarray, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, as rows."""
    peak = limit(dim)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(flat.astype(np.float64) * scale), -peak, peak).astype(np.int64).reshape(-1, dim)


def cuts(dim: int, parts: int) -> list[int]:
    """Where a vector is cut into consecutive parts; the first are longer by one where they cannot be equal."""
    return [sum(dim // parts + (k < dim % parts) for k in range(p)) for p in range(parts + 1)]


class Tree:
    """A kd-tree over the entries of one codebook."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        #: (low, high, index of the child with smaller values, of the other, entries); children are -1 in leaves, which alone have entries.
        self.nodes: list[tuple[np.ndarray, np.ndarray, int, int, np.ndarray]] = []
        if len(entries):
            self._grow(np.arange(len(entries)))

    def _grow(self, at: np.ndarray) -> int:
        low, high = self.entries[at].min(axis=0), self.entries[at].max(axis=0)
        me = len(self.nodes)
        self.nodes.append((low, high, -1, -1, at))
        if len(at) > LEAF and (low < high).any():
            axis = int(np.argmax(high - low))
            order = at[np.argsort(self.entries[at, axis], kind="stable")]
            half = len(at) // 2
            self.nodes[me] = (low, high, self._grow(np.sort(order[:half])), self._grow(np.sort(order[half:])), at[:0])
        return me

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row, the lower index where several are as near.

        A node is visited by the rows whose distance to its box is not above their
        best so far: at an equal distance it may hold the lower index. Every row
        goes down to the leaf it lies nearest to first, which makes bounds tight.
        """
        n, dim = rows.shape
        best, index = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        # In double precision products run faster, and as long as no sum reaches 2**53 they are exact.
        peak = max(int(np.abs(a).max(initial=0)) for a in (rows, self.entries))
        kind = np.float64 if 4 * peak * peak * max(dim, 1) < 1 << 53 else np.int64
        x = rows.astype(kind)
        square = (x * x).sum(axis=1)

        def bound(node: int, at: np.ndarray) -> np.ndarray:
            low, high = self.nodes[node][:2]
            part = x[at]
            off = np.maximum(np.maximum(low - part, part - high), 0)
            return (off * off).sum(axis=1)

        def leaf(node: int, at: np.ndarray) -> None:
            own = self.nodes[node][4]
            e = self.entries[own].astype(kind)
            found = square[at, None] - 2 * (x[at] @ e.T) + (e * e).sum(axis=1)
            k = found.argmin(axis=1)  # entries of a leaf are in order, so the first is the lowest
            least = found[np.arange(len(at)), k].astype(np.int64)
            better = (least < best[at]) | (least == best[at]) & (own[k] < index[at])
            best[at[better]], index[at[better]] = least[better], own[k[better]]

        def descend(node: int, at: np.ndarray) -> None:
            left, right = self.nodes[node][2:4]
            if left < 0:
                leaf(node, at)
                home[at] = node
                return
            nearer = bound(left, at) <= bound(right, at)
            for child, some in ((left, at[nearer]), (right, at[~nearer])):
                if len(some):
                    descend(child, some)

        def search(node: int, at: np.ndarray) -> None:
            left, right = self.nodes[node][2:4]
            if left < 0:
                at = at[home[at] != node]
                if len(at):
                    leaf(node, at)
                return
            for child in (left, right):
                some = at[bound(child, at) <= best[at]]
                if len(some):
                    search(child, some)

        home = np.full(n, -1, np.int64)
        if self.nodes and n:
            descend(0, np.arange(n))
            search(0, np.arange(n))
        return index, best


@dataclass(frozen=True)
class Codebooks:
    """The codebooks of each part, for vectors of one dimension; dim is None where there was no vector to fit."""

    dim: int | None
    entries: tuple[np.ndarray, ...]
    scale: int = SCALE

    def sha256(self) -> str:
        """Digest of all components as decimals, by part, entry, and position."""
        return hashlib.sha256(",".join(str(v) for part in self.entries for v in part.ravel().tolist()).encode()).hexdigest()

    def trees(self) -> list[Tree]:
        return [Tree(e) for e in self.entries]


def _assigned(column: pa.Array, dim: int, scale: int, trees: list[Tree]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """In strips, of the vectors of this dimension: places in the column, components, entry and error of each part."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    own = np.flatnonzero(size == dim)
    at = cuts(dim, len(trees))
    for start in range(0, len(own), STRIP):
        place = own[start : start + STRIP]
        x = integers(column.take(pa.array(place)).flatten().to_numpy(zero_copy_only=False), dim, scale) if dim else np.zeros((len(place), 0), np.int64)
        found = [tree.nearest(x[:, lo:hi]) for tree, lo, hi in zip(trees, at, at[1:])]
        yield place, x, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _sums(vectors: DataFrame, model: Codebooks, trees: Broadcast) -> list:
    """part, entry, n, sums (by position) over all vectors, of the entries that any is nearest to."""
    dim, scale = model.dim, model.scale
    at = cuts(dim, len(model.entries))
    widest = max(hi - lo for lo, hi in zip(at, at[1:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(t.entries), np.int64) for t in trees.value]
        sums = [np.zeros(t.entries.shape, np.int64) for t in trees.value]
        for batch in batches:
            for _, x, entry, _ in _assigned(batch.column(0), dim, scale, trees.value):
                for p, (lo, hi) in enumerate(zip(at, at[1:])):
                    order = np.argsort(entry[:, p], kind="stable")
                    used, first, n = np.unique(entry[order, p], return_index=True, return_counts=True)
                    counts[p][used] += n
                    if hi > lo:
                        sums[p][used] += np.add.reduceat(x[order, lo:hi], first, axis=0)
        for p, (n, s) in enumerate(zip(counts, sums)):
            used = np.flatnonzero(n)
            if len(used):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(s[used].tolist(), pa.list_(pa.int64()))],
                    names=["part", "entry", "n", "sums"],
                )
        release()

    found = vectors.select("vector").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    total = [F.sum(F.get("sums", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in range(widest)]
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect()


def fit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks over all usable vectors, after rounds of assigning them and taking means.

    The first entries are the parts of the vectors of the smallest keys, null keys
    last, equal keys in the vectors' order. Only vectors of the first one's
    dimension count. Each entry becomes floor(sum / count) of the parts nearest to
    it, ties to the lower index; one that is nearest to none stays.
    """
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("vector")).where(is_kept(F.col("vector")))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(1).collect()
    if not first:
        return Codebooks(None, tuple(np.zeros((0, 0), np.int64) for _ in range(parts)), scale)
    dim = len(first[0]["vector"])
    rows = rows.where(F.size("vector") == dim)
    seeds = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    x = integers(np.array([r["vector"] for r in seeds], np.float64).ravel(), dim, scale) if dim else np.zeros((len(seeds), 0), np.int64)
    at = cuts(dim, parts)
    model = Codebooks(dim, tuple(x[:, lo:hi].copy() for lo, hi in zip(at, at[1:])), scale)
    for _ in range(rounds):
        trees = vectors.sparkSession.sparkContext.broadcast(model.trees())
        new = [e.copy() for e in model.entries]
        for row in _sums(rows, model, trees):
            width = new[row["part"]].shape[1]
            new[row["part"]][row["entry"]] = [int(row[f"s{k}"]) // row["n"] for k in range(width)]
        trees.unpersist()
        model = Codebooks(dim, tuple(new), scale)
    return model


def encode(vectors: DataFrame, model: Codebooks, vector: str = "embedding") -> DataFrame:
    """vectors with code (two hex digits a part; four where a codebook has over 256 entries) and error; such columns are replaced.

    Vectors that hold nulls or no finite numbers, and those of another dimension
    than the codebooks, get null for both.
    """
    small_batches(vectors.sparkSession)
    vectors = vectors.drop("code", "error")
    trees = vectors.sparkSession.sparkContext.broadcast(model.trees())
    digits = 2 if max(len(e) for e in model.entries) <= 256 else 4
    at, dim, scale, n_columns = vectors.columns.index(vector), model.dim, model.scale, len(vectors.columns)
    names = [*vectors.columns, "code", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
            for place, _, entry, error in _assigned(batch.column(n_columns), dim, scale, trees.value) if dim is not None else ():
                codes[place] = ["".join(f"{v:0{digits}x}" for v in row) for row in entry.tolist()]
                errors[place] = error.sum(axis=1).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_columns], pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=names)
        release()

    usable = F.when(is_kept(F.col(f"`{vector}`")), F.col(f"`{vector}`")).alias("usable vector")
    rows = vectors.select(*[F.col(f"`{c}`") for c in vectors.columns], usable)
    return rows.mapInArrow(run, T.StructType([*vectors.schema.fields, *T.StructType.fromDDL("code string, error long").fields]))


def decode(encoded: DataFrame, model: Codebooks, code: str = "code") -> DataFrame:
    """encoded with a column decoded: the vector that a code stands for, in the vectors' own scale; null for null."""
    small_batches(encoded.sparkSession)
    encoded = encoded.drop("decoded")
    at = encoded.columns.index(code)
    books = encoded.sparkSession.sparkContext.broadcast(model.entries)
    scale = model.scale
    names = [*encoded.columns, "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c in batch.column(at).to_pylist():
                size = len(c) // len(books.value) if c else 0
                out.append(np.concatenate([e[int(c[p * size : (p + 1) * size], 16)] for p, e in enumerate(books.value)]) / scale if c else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], names=names)

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.ArrayType(T.DoubleType()))]))


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", **options) -> DataFrame:
    """Usable vectors as codes: key, code, error, label_error, codebooks_sha256; the options are fit()'s.

    Vectors that are null, or hold null or non-finite components, are left out;
    those of another dimension than the first have null code and error. label_error
    adds up the errors of equal labels, nulls together. Repeated rows count each
    time and stay. Components are clamped to limit(dim), beyond which errors would
    not fit a long. An empty table gives no rows.
    """
    model = fit(vectors, key, vector, **options)
    kept = vectors.where(is_kept(F.col(f"`{vector}`"))).select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("vector"))
    coded = materialise(encode(kept, model, "vector").drop("vector"), "vector-codes")
    errors = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    out = coded.join(errors, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(model.sha256()).alias("codebooks_sha256"))
