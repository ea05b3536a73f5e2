"""Phrases whose words keep company, by hierarchical pair naming.

Texts become sequences of word ids, cut into chunks of many documents. Then, level
by level, each two neighbouring ids of frequent (k-1)-grams are replaced by the id
of their pair, which is a k-gram. A chunk lists its distinct pairs with their
counts, a row each; the rows of all chunks meet by pair in one exchange, where a pair gets its
total, an id if it is frequent, and where its id goes back to the chunks that hold
it, many ids packed into one row. So a pair costs a row for each chunk, wherever and however
often it occurs. A task holds one chunk with its ids at a time, however many it gets.

Each frequent k-gram keeps the ids of the two (k-1)-grams it was made of. These
pointers lead to the parts of every cut (drop the last word by the left parent,
the first by the right), and from a phrase to the longer ones that hold it: the
most frequent of those is always one word longer, so parents are told by children.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_named, made_so_far, materialise, release, shuffle_partitions, small_batches

#: Words of a chunk, but for the rest of its last document.
CHUNK_WORDS = 1 << 20
#: Places of ids that a task gathers before it packs them by chunk, and rows of an Arrow batch that goes out.
MAX_PLACES, BATCH_ROWS = 1 << 21, 1 << 16
#: Lots in which a language's phrases are ranked.
LOTS = 64
_BREAKS = ".,;:!?\n\x0b\x0c\r"
_TOKENS = re.compile(rf"[{_BREAKS}]|[^ \t{_BREAKS}]+")
_BREAK = -1

#: A cut's score. Counts have up to 16 digits, so that products stay within a decimal's 38.
SCORE = "(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * 1000000BD) div (cast(c.l as decimal(16,0)) * cast(c.r as decimal(16,0)))"

#: Of each chunk a row of kind 1 with its n codes, packed, and rows of kind 0: the left and right of each code, and how often it occurs.
_CHUNK = "kind int, chunk long, codes binary, left {key}, right {key}, code int, n long"


def _planes(values: np.ndarray) -> bytes:
    """The bytes of numbers, all first ones, then all second ones, and so on: those of small numbers are mostly alike."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _whole(planes: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _packed(codes: np.ndarray, ids: np.ndarray | None = None) -> bytes:
    """Codes, and the ascending ids they stand for, if these are given, compressed."""
    steps = b"" if ids is None else _planes(np.diff(ids, prepend=0).astype(np.int64))
    return zstandard.ZstdCompressor(level=1).compress(_planes(codes.astype(np.int32)) + steps)


def _unpacked(data: bytes | memoryview, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return _whole(raw[: 4 * n], np.int32), np.cumsum(_whole(raw[4 * n :], np.int64))


def _rows(chunk: int, codes: np.ndarray | None, left: pa.Array, right: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A chunk as rows of _CHUNK, its codes last."""
    kinds = [pa.int32(), pa.int64(), pa.binary(), left.type, right.type, pa.int32(), pa.int64()]
    names = ["kind", "chunk", "codes", "left", "right", "code", "n"]
    for at in range(0, len(counts), BATCH_ROWS):
        n = min(BATCH_ROWS, len(counts) - at)
        columns = [np.zeros(n, np.int32), np.full(n, chunk), pa.nulls(n, pa.binary()), left.slice(at, n), right.slice(at, n), np.arange(at, at + n, dtype=np.int32), counts[at : at + n]]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)
    if codes is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip((1, chunk, _packed(codes), None, None, None, len(codes)), kinds)], names=names)


def _chunks(docs: DataFrame) -> DataFrame:
    """Chunks of documents: the code of each word in turn, -1 between pieces; and of each code its language, word and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        codes: list[np.ndarray] = []
        words: dict[str, defaultdict] = {}
        number = count()
        size = 0

        def done() -> Iterator[pa.RecordBatch]:
            left, right, at = [], [], []
            for lang, known in words.items():
                for c in _BREAKS:
                    del known[c]
                left += [lang] * len(known)
                right += known
                at += known.values()
            every = np.concatenate(codes)
            counts = np.bincount(every[every != _BREAK], minlength=len(at))
            take = pa.array(np.argsort(np.array(at, np.int64)))
            return _rows(first + made, every, pa.array(left, pa.string()).take(take), pa.array(right, pa.string()).take(take), counts)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                if lang not in words:
                    words[lang] = defaultdict(number.__next__, dict.fromkeys(_BREAKS, _BREAK))
                found = _TOKENS.findall(text.encode().lower().decode())  # of bytes, A-Z alone are lowered
                codes.append(np.fromiter(map(words[lang].__getitem__, found), np.int32, len(found)))
                codes.append(np.full(1, _BREAK, np.int32))
                size += len(found)
                if size >= CHUNK_WORDS:
                    yield from done()
                    codes, words, number, size, made = [], {}, count(), 0, made + 1
        if codes:
            yield from done()
        release()

    return docs.mapInArrow(run, _CHUNK.format(key="string"))


def _named(chunks: DataFrame, parts: int, min_count: int, name: str) -> DataFrame:
    """Frequent pairs by kind. 0: id, left, right, total of each; 1: of a chunk that holds some, how many (total), their codes there and their ids, packed.

    Rows of a pair stream past in order; fewer than min_count wait until the pair is known to be frequent.
    """
    rows = chunks.where("kind = 0").select("left", "right", "chunk", "code", "n")
    # A hash in front makes nearly all comparisons those of one number; rows of a pair are together in any order.
    ordered = rows.repartition(parts, "left", "right").sortWithinPartitions(F.xxhash64("left", "right"), "left", "right")
    kind = chunks.schema["left"].dataType.simpleString()
    schema = f"kind int, id long, left {kind}, right {kind}, total long, chunk long, codes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        next_id = TaskContext.get().partitionId() << 40
        last: tuple | None = None  # the pair that may go on: left, right
        last_id, total = 0, 0
        held: list[tuple[np.ndarray, np.ndarray]] = []  # its places, while it is not known to be frequent

        known: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # id, chunk, code of frequent pairs' places, in order of ids
        size = 0

        def pairs(ids: np.ndarray, left: pa.Array, right: pa.Array, totals: np.ndarray) -> pa.RecordBatch:
            n = len(ids)
            none = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(ids), left, right, pa.array(totals), *none], names=names)

        def places() -> pa.RecordBatch:
            ids, chunk, code = (np.concatenate(c) for c in zip(*known))
            order = np.argsort(chunk, kind="stable")
            ids, chunk, code = ids[order], chunk[order], code[order]
            start = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
            stop = np.r_[start[1:], len(chunk)]
            n = len(start)
            packed = pa.array([_packed(code[a:b], ids[a:b]) for a, b in zip(start, stop)], pa.binary())
            none = [pa.nulls(n, pa.int64()), pa.nulls(n, types[0]), pa.nulls(n, types[1])]
            return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), *none, pa.array(stop - start), pa.array(chunk[start]), packed], names=names)

        names = ["kind", "id", "left", "right", "total", "chunk", "codes"]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            left, right = batch.column(0), batch.column(1)
            types = left.type, right.type
            chunk, code, counts = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4))
            new = np.ones(n, bool)
            for column in (left, right):
                same = pc.equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
                new[1:] &= same
            new[1:] = ~new[1:]
            goes_on = last == (left[0].as_py(), right[0].as_py())
            new[0] = not goes_on
            if last is not None and not goes_on and total >= min_count:
                yield pairs(np.array([last_id]), pa.array([last[0]], types[0]), pa.array([last[1]], types[1]), np.array([total]))
            start = np.flatnonzero(np.r_[True, new[1:]])
            sums = np.add.reduceat(counts, start)
            ids = next_id + np.arange(len(start))
            next_id += len(start)
            if goes_on:
                ids[0], sums[0] = last_id, sums[0] + total
            else:
                held = []
            group = np.cumsum(np.r_[False, new[1:]])
            often = sums >= min_count
            if often[0] and held:
                chunks_, codes_ = (np.concatenate(c) for c in zip(*held))
                known.append((np.full(len(chunks_), ids[0]), chunks_, codes_))
                size += len(chunks_)
                held = []
            hit = often[group]
            if hit.any():
                known.append((ids[group[hit]], chunk[hit], code[hit]))
                size += len(known[-1][0])
            if size >= MAX_PLACES:
                yield places()
                known, size = [], 0
            whole = np.flatnonzero(often[:-1])
            if len(whole):
                at = pa.array(start[whole])
                yield pairs(ids[whole], left.take(at), right.take(at), sums[whole])
            if not often[-1]:
                mine = slice(start[-1], n)
                held = [*(held if goes_on and len(start) == 1 else []), (chunk[mine].copy(), code[mine].copy())]
            else:
                held = []
            last, last_id, total = (left[n - 1].as_py(), right[n - 1].as_py()), int(ids[-1]), int(sums[-1])
        if last is not None and total >= min_count:
            yield pairs(np.array([last_id]), pa.array([last[0]], types[0]), pa.array([last[1]], types[1]), np.array([total]))
        if known:
            yield places()
        release()

    return materialise(ordered.mapInArrow(run, schema), name)


def _replaced(chunks: DataFrame, named: DataFrame, parts: int, name: str, last: bool) -> DataFrame:
    """Chunks one level up: neighbouring ids of frequent grams as pairs, each chunk's pairs numbered anew."""
    known = named.where("kind = 1").select("chunk", "kind", F.col("total").alias("n"), "codes")
    codes = chunks.where("kind = 1").select("chunk", F.lit(2).alias("kind"), "n", "codes")
    # A chunk's ids stream past before its codes.
    ordered = known.unionByName(codes).repartition(parts, "chunk").sortWithinPartitions("chunk", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for chunk, kind, n, data in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                if chunk != now:
                    now, held = chunk, []
                if kind == 1:
                    held.append(_unpacked(data.as_buffer(), n))
                elif held:
                    codes = _unpacked(data.as_buffer(), n)[0]
                    code, ids = (np.concatenate(c) for c in zip(*held))
                    held = []
                    # One place more than there are codes, so that -1 is a gram that is not frequent.
                    spot = np.full(max(int(codes.max(initial=0)), int(code.max(initial=0))) + 2, -1, np.int64)
                    spot[code] = np.arange(len(ids))
                    at = spot[codes]
                    both = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
                    pair, number, counts = np.unique(at[both] * len(ids) + at[both + 1], return_inverse=True, return_counts=True)
                    out = np.full(max(0, len(at) - 1), -1, np.int32)
                    out[both] = number
                    yield from _rows(chunk, None if last else out, pa.array(ids[pair // len(ids)]), pa.array(ids[pair % len(ids)]), counts)
        release()

    return materialise(ordered.mapInArrow(run, _CHUNK.format(key="long")), name)


def phrases(docs: DataFrame, max_words: int = 3, min_count: int = 10, percent: int = 50, text: str = "text", lang: str = "lang") -> DataFrame:
    """Candidate phrases of 2 to max_words words that no longer one subsumes: lang, phrase, words, a, l, r, n, score.

    Words are what ``[.,;:!?\\x0A-\\x0D]``, blanks and tabs leave, A-Z in lower case; a
    phrase lies within one piece between such marks. All is by language; a null
    language is "und". a counts the phrase's occurrences, l and r those of the two
    parts of its worst cut, n the language's words; score is
    floor(1,000,000 a^2 / (l r)). A phrase is a candidate if a >= min_count, and
    subsumed by a longer candidate that holds it and has 100 f >= percent * a.
    Null and empty texts have no words; repeated rows count each time.
    """
    small_batches(docs.sparkSession)
    parts = shuffle_partitions(docs)
    docs = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    since = made_so_far()
    chunks = materialise(_chunks(docs), "phrase-pairs-1")
    sizes = materialise(chunks.where("kind = 0").groupBy(F.col("left").alias("lang")).agg(F.sum("n").alias("n")), "phrase-sizes")
    named = _named(chunks, parts, min_count, "phrase-names-1")
    words = named.where("kind = 0").select("id", F.col("left").alias("lang"), F.col("right").alias("phrase"), F.col("total").alias("a"))
    # Of each gram: the counts of its first 1, 2, ... words, and of its last.
    grams = words.select("id", "lang", "phrase", F.col("phrase").alias("last"), "a", F.array("a").alias("heads"), F.array("a").alias("tails"))
    levels, above = [], []
    for k in range(2, max_words + 1):
        chunks = _replaced(chunks, named, parts, f"phrase-pairs-{k}", last=k == max_words)
        drop_named(docs.sparkSession, [f"phrase-pairs-{k - 1}"], since)
        named = _named(chunks, parts, min_count, f"phrase-names-{k}")
        pairs = named.where("kind = 0").select("id", "left", "right", F.col("total").alias("a"))
        first = grams.select(F.col("id").alias("left"), "lang", "phrase", "heads")
        second = grams.select(F.col("id").alias("right"), "last", "tails")
        grams = pairs.join(first, "left").join(second, "right").select(
            "id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "a", "left", "right",
            F.concat("heads", F.array("a")).alias("heads"), F.concat("tails", F.array("a")).alias("tails"),
        )
        grams = materialise(grams, f"phrase-grams-{k}")
        drop_named(docs.sparkSession, [f"phrase-names-{k - 1}", *([f"phrase-pairs-{k}", f"phrase-names-{k}"] if k == max_words else [])], since)
        # The parts of each cut: the first j words, and the last k - j.
        cut = F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda j: F.struct(F.col("heads")[j - 1].alias("l"), F.col("tails")[k - j - 1].alias("r"), j.alias("j")))
        levels.append(grams.select("id", "lang", "phrase", F.lit(k).alias("words"), "a", cut.alias("cuts")))
        parents = grams.select(F.explode(F.array("left", "right")).alias("id"), "a")
        above.append(parents.groupBy("id").agg(F.max("a").alias("above")))
    out = None
    for k, level in enumerate(levels):
        if k + 1 < len(levels):
            level = level.join(above[k + 1], "id", "left").where(F.col("above").isNull() | (F.col("above") * 100 < F.col("a") * percent)).drop("above")
        out = level if out is None else out.unionByName(level)
    out = out.withColumn("cut", F.array_min(F.expr(f"transform(cuts, c -> struct({SCORE} as score, c.j as j, c.l as l, c.r as r))")))
    return out.join(sizes, "lang").select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, top: int = 2000, **options) -> DataFrame:
    """The first ``top`` phrases of each language by score, then a, both descending, then phrase: lang, rank, phrase, a, l, r, n, score.

    The options are those of phrases(). An empty table has no phrases.
    """
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # A language's phrases are ranked in lots first, of which each passes on its own first ones: no task orders all of them.
    dealt = phrases(docs, **options).withColumn("lot", F.pmod(F.xxhash64("phrase"), F.lit(LOTS)))
    best = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "lot").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
