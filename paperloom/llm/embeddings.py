"""Near-duplicate embeddings by sorted projection passes.

Each pass hashes every vector to the signs of random projections, concatenated
to one key, orders vectors by that key, and compares each with a bounded window
of its neighbours; pairs whose cosine, in double precision, reaches the threshold
are united across passes. Equal vectors are one from the start.

Projections are taken from the mean of a label's vectors, so that signs tell them
apart where they cluster. How many passes a label gets follows from its size and
its spread: a pass brings a pair together if their keys agree on as many signs as
leave one window of the label, and passes go on until a pair at the threshold is
missed with a probability of ``miss`` at most. A label that one window holds gets one pass,
which misses nothing.

Links are counted inside the groups that passes have united, all members against
all, in blocks; vectors that no pass united with another are in no such group.
With ``exact`` all vectors of a label are compared instead, block against block,
whose work grows with the square of a label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions, small_batches
from .components import components

KEY_BITS, WINDOW = 32, 64
#: Probability that all passes together miss a pair at the threshold, and vectors ordered in one task.
MISS, BUCKET = 0.005, 4096
#: Vectors of a label that meet in one task, on either side, and rows compared at once.
BLOCK, STRIP = 4096, 512


def is_usable(vector: Column) -> Column:
    """Not null, not zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(column: pa.Array) -> np.ndarray:
    """Rows of unit length, in double precision; all of one dimension."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(n, -1)
    # Scaled first, so that neither very large nor very small components are lost in the square.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _by_dimension(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes of the rows of each dimension, and their unit vectors."""
    sizes = np.array([len(v) for v in batch.column(column)], np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, _units(batch.column(column).take(pa.array(at)))


def _means(classes: DataFrame) -> DataFrame:
    """label, dim, n, mean: of each label's vectors of a dimension, at unit length; means to three decimals, which no order of adding changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for at, x in _by_dimension(batch, 1):
                encoded = batch.column(0).take(pa.array(at)).dictionary_encode()
                code = encoded.indices.to_numpy()
                order = np.argsort(code, kind="stable")
                first = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]])
                sums, n = np.add.reduceat(x[order], first, axis=0), np.diff(np.r_[first, len(order)])
                yield pa.RecordBatch.from_arrays(
                    [encoded.dictionary.take(pa.array(code[order][first])), pa.array(np.full(len(n), x.shape[1], np.int32)), pa.array(n), pa.array(sums.tolist(), pa.list_(pa.float64()))],
                    names=["label", "dim", "n", "sums"],
                )

    kind = classes.schema["label"].dataType.simpleString()
    parts = classes.select("label", "vector").mapInArrow(run, f"label {kind}, dim int, n long, sums array<double>")
    each = parts.select("label", "dim", "n", F.posexplode("sums").alias("k", "s")).groupBy("label", "dim", "k").agg(F.sum("n").alias("n"), F.round(F.sum("s") / F.sum("n"), 3).alias("m"))
    return each.groupBy("label", "dim").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda e: e["m"]).alias("mean"))


def passes_for(n: int, mean: np.ndarray, threshold: float, window: int, miss: float) -> int:
    """Passes over n vectors of unit length around a mean."""
    bits = np.log2(n / window)
    if bits <= 0:
        return 1
    # The angle, seen from the mean, of two vectors at the threshold, and how likely a sign tells them apart.
    chord, spread = np.sqrt(max(2 - 2 * threshold, 0.0)), np.sqrt(max(1 - float(mean @ mean), 1e-6))
    angle = 2 * np.arcsin(min(1.0, chord / 2 / spread))
    meets = (1 - angle / np.pi) ** bits
    return max(1, int(np.ceil(np.log(miss) / np.log1p(-meets)))) if 0 < meets < 1 else 1


def _passes(classes: DataFrame, threshold: float, window: int, miss: float, passes: int | None, seed: int) -> DataFrame:
    """Each vector once a pass, if its label has others: pass, label, dim, key, bits (that choose the task), node, vector."""
    means = _means(classes).where("n > 1")
    joined = classes.withColumn("dim", F.size("vector")).join(means, ["label", "dim"]).select("node", "label", "vector", "dim", "n", "mean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        known: dict[tuple[int, bytes], int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for at, x in _by_dimension(batch, 2):
                part, dim = batch.take(pa.array(at)), x.shape[1]
                n = part.column(4).to_numpy()
                mean = part.column(5).flatten().to_numpy(zero_copy_only=False).reshape(len(x), dim)
                often = np.zeros(len(x), np.int64)
                for i, of in enumerate(zip(n.tolist(), map(bytes, mean))):
                    if of not in known:
                        known[of] = passes or passes_for(of[0], mean[i], threshold, window, miss)
                    often[i] = known[of]
                bits = np.ceil(np.log2(np.maximum(n / BUCKET, 1))).astype(np.int32)
                off = x - mean
                for p in range(int(often.max())):
                    if (dim, p) not in planes:
                        planes[dim, p] = np.random.default_rng([seed, dim, p]).standard_normal((dim, KEY_BITS))
                    mine = np.flatnonzero(often > p)
                    key = (off[mine] @ planes[dim, p] > 0) @ (1 << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64))
                    some = part.take(pa.array(mine))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(mine), p, np.int32)), some.column(1), some.column(3), pa.array(key), pa.array(bits[mine]), some.column(0), some.column(2)],
                        names=["pass", "label", "dim", "key", "bits", "node", "vector"],
                    )

    kinds = [classes.schema[c].dataType.simpleString() for c in ("label", "vector")]
    out = "pass int, label {}, dim int, key long, bits int, node long, vector {}".format(*kinds)
    return joined.mapInArrow(run, out)


def _window_links(rows: DataFrame, parts: int, threshold: float, window: int) -> DataFrame:
    """Edges (a, b) that span the links found within windows; at most one a row and batch."""
    keyed = rows.withColumn("bucket", F.xxhash64("pass", "label", "dim", F.expr(f"shiftright(key, {KEY_BITS} - bits)")))
    ordered = keyed.repartition(parts, "bucket").sortWithinPartitions("bucket", "key", "node").select("bucket", "node", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last rows of each dimension, as rows of several may come in one batch.
        state: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]
            for at, x in _by_dimension(batch, 2):
                b, n = new[0][at], new[1][at]
                dim = x.shape[1]
                if dim in state:
                    b, n, x = (np.concatenate(pair) for pair in zip(state[dim], (b, n, x)))
                label = np.arange(len(n))
                i_all, j_all = [], []
                for d in range(1, min(window, len(n) - 1) + 1):
                    same = b[d:] == b[:-d]
                    if not same.any():
                        break  # buckets are in order: no farther row shares one either
                    hit = np.flatnonzero(same & (np.einsum("ij,ij->i", x[d:], x[:-d]) >= threshold))
                    i_all.append(hit + d)
                    j_all.append(hit)
                if i_all:
                    i, j = np.concatenate(i_all), np.concatenate(j_all)
                    while True:
                        before = label.copy()
                        low = np.minimum(label[i], label[j])
                        np.minimum.at(label, i, low)
                        np.minimum.at(label, j, low)
                        label = label[label]
                        if (label == before).all():
                            break
                    moved = np.flatnonzero(label != np.arange(len(n)))
                    if len(moved):
                        yield pa.RecordBatch.from_arrays([pa.array(n[moved]), pa.array(n[label[moved]])], names=["a", "b"])
                state[dim] = (b[-window:], n[-window:], x[-window:])

    return ordered.mapInArrow(run, "a long, b long")


def _count_links(members: DataFrame, parts: int, threshold: float) -> DataFrame:
    """(node, links, other): how many other vectors, copies included, each node links with; and pairs of linked roots.

    members: lot, node, root, copies, vector. The nodes of a lot are dealt to
    blocks, and each pair of blocks meets in one task, which adds up links and
    emits sums, and each pair of roots (node, null, other) once.
    """
    sizes = members.groupBy("lot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sizes, "lot").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("lot", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "copies", "vector", "root")
    ordered = dealt.repartition(parts, "lot", "x", "y").sortWithinPartitions("lot", "x", "y", "own", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None

        def done() -> Iterator[pa.RecordBatch]:
            group = pa.Table.from_batches(held).combine_chunks()
            own = group["own"].to_numpy()
            node, copies, root = group["node"].to_numpy(), group["copies"].to_numpy(), group["root"].to_numpy()
            x, y = at[1], at[2]
            for k, unit in _by_dimension(group.to_batches()[0], 6):
                left, right = np.flatnonzero(own[k] == x), np.flatnonzero(own[k] == y)
                if not len(left) or not len(right):
                    continue
                links = np.zeros(len(k), np.int64)
                across, facing = np.zeros((2, 0), np.int64), unit[right].T
                for start in range(0, len(left), STRIP):
                    i, j = np.nonzero(unit[left[start : start + STRIP]] @ facing >= threshold)
                    i, j = left[start + i], right[j]
                    if x == y:
                        i, j = i[i != j], j[i != j]
                    np.add.at(links, i, copies[k][j])
                    if x != y:
                        np.add.at(links, j, copies[k][i])
                    a, b = root[k][i], root[k][j]
                    across = np.unique(np.concatenate([across, np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b]], axis=1), axis=1)
                hit = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(node[k][hit]), pa.array(links[hit]), pa.nulls(len(hit), pa.int64())], names=["node", "links", "other"])
                yield pa.RecordBatch.from_arrays([pa.array(across[0]), pa.nulls(across.shape[1], pa.int64()), pa.array(across[1])], names=["node", "links", "other"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
            start = 0
            for i, key in enumerate([*keys, None]):
                if i == len(keys) or key != at:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    if i < len(keys):
                        if at is not None and held:
                            yield from done()
                        held, at, start = [], key, i
        if held:
            yield from done()

    return ordered.mapInArrow(run, "node long, links long, other long").groupBy("node", "other").agg(F.sum("links").alias("links"))


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.98,
    miss: float = MISS,
    window: int = WINDOW,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    seed: int = 17,
    passes: int | None = None,
    exact: bool = False,
) -> DataFrame:
    """One row per vector: key, n_links, component_id, kept.

    Vectors are compared only within equal labels (not null) and equal dimension.
    Null, zero and non-finite vectors, and those of null label or key, link with
    nothing: n_links 0, and their own key as component_id. Rows equal in key,
    label and vector are one vector, and give one row; an empty table gives none.
    passes, if given, is the number of passes of every label.
    """
    small_batches(vectors.sparkSession)
    kind = vectors.schema[vector].dataType.simpleString()
    # Single precision stays as it is, as its products in double precision are exact; all else becomes double.
    kind = kind if kind == "array<float>" else "array<double>"
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast(kind).alias("vector"))
    usable = is_usable(F.col("vector")) & F.col("label").isNotNull() & F.col("id").isNotNull()
    rows = rows.withColumn("node", F.when(usable, F.xxhash64("label", "vector")))
    parts = shuffle_partitions(rows)

    classes = rows.where("node IS NOT NULL").groupBy("node", "label", "vector").agg(F.count_distinct("id").alias("copies"))
    classes = materialise(classes, "vector-classes")
    edges = _window_links(_passes(classes, threshold, window, miss, passes, seed), parts, threshold, window)
    roots = components(edges)
    if exact:
        members = classes.join(roots, "node", "left").select(F.xxhash64("label", F.size("vector")).alias("lot"), "node", F.coalesce("root", "node").alias("root"), "copies", "vector")
    else:
        united = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        members = classes.join(united, "node").select(F.col("root").alias("lot"), "node", "root", "copies", "vector")
    found = materialise(_count_links(members, parts, threshold), "vector-links")
    links = found.where("other IS NULL").select("node", "links")
    if exact:  # unite what the passes left apart
        across = found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))
        roots = components(across.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    rooted = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())

    ids = rows.select("id", "node").distinct()
    known = classes.select("node", "copies").join(links, "node", "left").join(rooted, "node", "left")
    known = known.select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    # Only vectors with a link need their component's smallest key; the rest, most of all, are their own.
    joined = ids.join(known, "node", "left").select("id", "n_links", F.when(F.col("n_links") > 0, F.col("root")).alias("root"))
    least = joined.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("least"))
    out = joined.join(least, "root", "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "id").alias("component_id")
    )
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
