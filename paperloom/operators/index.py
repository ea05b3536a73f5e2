"""A stored BM25 index: segments that are added and merged, and searches that read little of them.

A segment holds the postings of some documents. Documents lie in blocks, and a row
of ``postings`` is a term in a block: its documents, how often each has it, their
lengths, and the highest frequency and lowest length, from which follows what the
term can add to a score there at most, whatever the corpus grows to. Rows lie in
folders by term, sorted by term and block.

A search sums up these bounds by query and block, without opening a document. Its
most promising blocks are scored first; the k-th score found there is what any
other block must be able to reach to be opened at all. So results are exact, and
most blocks of most queries are never read.

What idf and length normalisation need of the corpus (documents, tokens, document
frequencies) adds up over segments: each commit holds the sums so far.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from ..sources import commits, stores
from . import lexical
from .lexical import B, EPSILON, K1, has_text

#: Documents of a block, folders of terms, and segments that are searched side by side before append merges them.
BLOCK_DOCS, FOLDERS, MERGE_AFTER = 64, 32, 8
#: The folder of rows without a term.
NO_TERM = -1


def _folder(term: Column | str) -> Column:
    term = T._col(term)
    return F.when(term.isNull(), NO_TERM).otherwise(F.pmod(F.xxhash64(term), F.lit(FOLDERS))).cast("int")


def _blocks(docs: DataFrame, key: str, text: str, tokenizer: Callable[[Column | str], Column], block_docs: int) -> DataFrame:
    """term, block, keys, tfs, dls, tf (highest), dl (lowest) of each term in each block of documents, and of all its documents one row without a term."""
    lexical.bounded_batches(docs.sparkSession)
    rows = lexical.spread(docs.select(key, text)).where(has_text(text)).select(F.col(key).alias("key"), tokenizer(text).alias("tokens"))
    # Documents of a block are of like lengths, which makes what their scores can reach tight.
    rows = rows.sortWithinPartitions(F.size("tokens"), "key")
    kind = to_arrow_type(rows.schema["key"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        keys: list = []
        tokens: list[list[str]] = []

        def done() -> pa.RecordBatch:
            sizes = np.array([len(t) for t in tokens], np.int32)
            words: dict[str, int] = {}
            code = np.array([words.setdefault(w, len(words)) for t in tokens for w in t], np.int64)
            pair, tf = np.unique(code * len(tokens) + np.repeat(np.arange(len(tokens)), sizes), return_counts=True)
            term, doc = pair // len(tokens), pair % len(tokens)
            start = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
            listed = lambda values: pa.ListArray.from_arrays(offsets, values)
            # One row more has all documents, once each, with their lengths: what says which are stored.
            every = np.arange(len(tokens))
            most, least = np.maximum.reduceat(tf, start), np.minimum.reduceat(sizes[doc], start)
            doc, tf = np.r_[doc, every], np.r_[tf, np.zeros(len(every), tf.dtype)]
            offsets, n = pa.array(np.r_[start, len(pair), len(doc)].astype(np.int32)), len(start) + 1
            return pa.RecordBatch.from_arrays(
                [pa.array([*words, None], pa.string()), pa.array(np.full(n, first + made)), listed(pa.array(keys, kind).take(pa.array(doc))), listed(pa.array(tf.astype(np.int32))), listed(pa.array(sizes[doc])),
                 pa.array(np.r_[most, 0].astype(np.int32)), pa.array(np.r_[least, 0].astype(np.int32))],
                names=["term", "block", "keys", "tfs", "dls", "tf", "dl"],
            )

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t:
                    keys.append(k)
                    tokens.append(t)
                if len(keys) == block_docs:
                    yield done()
                    keys, tokens, made = [], [], made + 1
        if keys:
            yield done()

    key_type = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"term string, block long, keys array<{key_type}>, tfs array<int>, dls array<int>, tf int, dl int")


def _store(postings: DataFrame, path: str) -> None:
    dealt = postings.withColumn("folder", _folder("term")).repartition("folder", F.pmod("block", F.lit(8))).sortWithinPartitions("folder", "term", "block")
    dealt.write.partitionBy("folder").parquet(path)


def _statistics(spark: SparkSession, path: str, segments: list[str]) -> DataFrame:
    """(term, df) over segments."""
    rows = spark.read.parquet(*[f"{path}/{s}/terms" for s in segments])
    return rows.groupBy("term").agg(F.sum("df").alias("df"))


def _sums(spark: SparkSession, path: str, segments: list[dict]) -> dict:
    """Documents, tokens, and the floor of negative idf, over segments."""
    n, tokens = sum(s["n"] for s in segments), sum(s["tokens"] for s in segments)
    raw = F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    row = _statistics(spark, path, [s["name"] for s in segments]).agg(F.avg(raw).alias("mean")).first() if n else {"mean": None}
    return {"n": n, "tokens": tokens, "floor": (row["mean"] or 0.0) * EPSILON}


def append(docs: DataFrame, path: str, key: str = "chunk_id", text: str = "text", tokenizer: Callable[[Column | str], Column] = T.technical_tokens, block_docs: int = BLOCK_DOCS) -> dict:
    """Add documents to the index at path, which is made if there is none; returns its new state.

    Documents whose key the index has stay as they are; of several rows of a new key
    one is taken; blank and null texts are left out, null keys too. Nothing that is
    stored is read again but keys and term counts. With many segments, all are merged.
    """
    spark = docs.sparkSession
    state = commits.read(spark, path)[1]
    new = docs.where(F.col(key).isNotNull() & has_text(text)).select(key, text).dropDuplicates([key])
    if state:
        known = spark.read.parquet(*[f"{path}/{s['name']}/keys" for s in state["segments"]])
        new = new.join(known.withColumnRenamed("key", key), key, "left_anti")
    name = f"segment-{uuid.uuid4().hex}"
    made = _blocks(new, key, text, tokenizer, block_docs)
    _store(made, f"{path}/{name}/postings")
    stored = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in made.schema)}, folder int").parquet(f"{path}/{name}/postings")
    counts = stored.where(f"folder <> {NO_TERM}").groupBy("term").agg(F.sum(F.size("keys")).cast("long").alias("df"))
    counts.write.parquet(f"{path}/{name}/terms")
    lengths = stored.where(f"folder = {NO_TERM}").select(F.explode(F.arrays_zip("keys", "dls")).alias("p")).select(F.col("p.keys").alias("key"), F.col("p.dls").alias("dl"))
    lengths.write.parquet(f"{path}/{name}/keys")
    total = spark.read.parquet(f"{path}/{name}/keys").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
    segment = {"name": name, "n": total["n"], "tokens": total["tokens"]}
    if not segment["n"]:  # nothing new
        stores.delete(spark, f"{path}/{name}")
        return state or {"segments": [], "sums": {"n": 0, "tokens": 0, "floor": 0.0}, "old": []}

    def change(now: dict | None) -> dict:
        if (now or {}).get("segments", []) != (state or {}).get("segments", []):
            raise commits.Conflict(f"another writer changed the index at {path}; append again")
        segments = [*(now["segments"] if now else []), segment]
        return {"segments": segments, "sums": _sums(spark, path, segments), "old": []}

    after = commits.update(spark, path, change)
    return merge(spark, path) if len(after["segments"]) > MERGE_AFTER else after


def merge(spark: SparkSession, path: str) -> dict:
    """Make one segment of all, which is searched as they were; returns the new state."""
    state = commits.read(spark, path)[1]
    if not state or len(state["segments"]) < 2:
        return state
    name, names = f"segment-{uuid.uuid4().hex}", [s["name"] for s in state["segments"]]
    _store(_postings(spark, path, state).where(f"folder <> {NO_TERM}"), f"{path}/{name}/postings")
    _statistics(spark, path, names).write.parquet(f"{path}/{name}/terms")
    spark.read.parquet(*[f"{path}/{s}/keys" for s in names]).write.parquet(f"{path}/{name}/keys")
    merged = {"name": name, "n": state["sums"]["n"], "tokens": state["sums"]["tokens"]}

    def change(now: dict) -> dict | None:
        if now["segments"][: len(names)] != state["segments"]:
            return None  # another merge came first
        return now | {"segments": [merged, *now["segments"][len(names) :]], "old": names}

    after = commits.update(spark, path, change)
    for gone in state.get("old", []):
        stores.delete(spark, f"{path}/{gone}")
    return after


def _postings(spark: SparkSession, path: str, state: dict) -> DataFrame:
    """All rows of postings; block numbers are apart over segments."""
    out = None
    for s in state["segments"]:
        rows = spark.read.parquet(f"{path}/{s['name']}/postings").withColumn("block", F.xxhash64("block", F.lit(s["name"])))
        out = rows if out is None else out.unionByName(rows)
    return out


def _plan(queries: DataFrame, path: str, query_key: str, tokenizer: Callable[[Column | str], Column]) -> tuple[DataFrame, DataFrame, dict] | None:
    """Weighted terms (q, term, w), the postings of the folders that hold any, and the index's sums; None for an empty index."""
    spark = queries.sparkSession
    state = commits.read(spark, path)[1]
    if not state or not state["sums"]["n"]:
        return None
    sums = state["sums"]
    terms = queries.select(F.col(query_key).alias("q"), F.explode(tokenizer("text")).alias("term")).groupBy("q", "term").agg(F.count("*").alias("qf"))
    raw = F.log(F.lit(float(sums["n"])) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    df = _statistics(spark, path, [s["name"] for s in state["segments"]])
    weighted = df.join(terms, "term").select("q", "term", (F.col("qf") * F.when(raw < 0, F.lit(sums["floor"])).otherwise(raw)).alias("w"))
    folders = [r[0] for r in terms.select(_folder("term")).distinct().collect()]  # as many as there are folders, at most
    return weighted, _postings(spark, path, state).where(F.col("folder").isin(folders)), sums


def _impact(tf: Column | np.ndarray, dl: Column | np.ndarray, avgdl: float) -> Column | np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _scored(wanted: DataFrame, weighted: DataFrame, postings: DataFrame, avgdl: float, k: int, digits: int) -> DataFrame:
    """(q, key, score) of documents in the wanted blocks (q, block) that share a term with their query: among them each query's k best.

    Postings of queried terms are dealt by block, once, and a block's documents are
    scored where its postings meet, for a bounded lot of queries at once. A task passes on
    little more than its own k best a query, so pairs of query and document are not shuffled.
    """
    spark = wanted.sparkSession
    lexical.bounded_batches(spark)
    size = weighted.agg(F.count("*").alias("pairs"), F.count_distinct("q").alias("queries")).first()
    lots = max(1, -(-size["pairs"] // lexical.MAX_PAIRS), -(-size["queries"] // lexical.MAX_QUERIES))
    mine = lambda rows, lot: rows if lots == 1 else rows.where(F.pmod(F.xxhash64("q"), F.lit(lots)) == lot)
    found = [_lot_scored(mine(wanted, lot), mine(weighted, lot), postings, avgdl, k, digits) for lot in range(lots)]
    return stores.kept(reduce(DataFrame.unionByName, found), "scores")


def _lot_scored(wanted: DataFrame, weighted: DataFrame, postings: DataFrame, avgdl: float, k: int, digits: int) -> DataFrame:
    weights = lexical.Weights.of((r["q"], r["term"], r["w"]) for r in weighted.collect())  # no more than a lot
    shared = wanted.sparkSession.sparkContext.broadcast(weights)
    q_type, key_type = weighted.schema["q"].dataType, postings.schema["keys"].dataType.elementType
    arrow = to_arrow_type(q_type)
    asks = wanted.groupBy("block").agg(F.collect_list("q").alias("qs"))
    posts = postings.join(weighted.select("term").distinct(), "term", "left_semi").join(asks.select("block"), "block", "left_semi")
    rows = posts.select("block", "term", "keys", "tfs", "dls").unionByName(asks, allowMissingColumns=True)
    # By a hash of its own: an exchange on the joins' key is left out as needless, though each part of the union then has partitions of its own.
    dealt = rows.repartition(F.xxhash64("block")).sortWithinPartitions("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        names, terms, best = pa.array(weights.queries, arrow), pa.array(weights.terms, pa.string()), lexical.Floor(len(weights.queries), k)
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            block = pa.Table.from_batches(held).combine_chunks()
            columns = {c: block[c].combine_chunks() if block[c].num_chunks != 1 else block[c].chunk(0) for c in block.column_names}
            keys = columns["keys"].flatten().dictionary_encode()
            sizes = pc.list_value_length(columns["keys"]).fill_null(0).to_numpy(zero_copy_only=False)
            term = np.repeat(pc.index_in(columns["term"], terms).fill_null(-1).to_numpy(zero_copy_only=False), sizes).astype(np.int64)
            tf, dl = (columns[c].flatten().to_numpy(zero_copy_only=False) for c in ("tfs", "dls"))
            doc = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            score = weights.scores(doc, term, _impact(tf, dl, avgdl), len(keys.dictionary), digits)
            others = np.ones(len(names), bool)
            others[pc.index_in(columns["qs"].flatten(), names).to_numpy(zero_copy_only=False)] = False
            score[others] = -np.inf
            q, j, score = best.pick(score)
            if len(q):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), keys.dictionary.take(pa.array(j)), pa.array(score)], names=["q", "key", "score"])

        last = None
        for batch in batches:
            block = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else []
            for start, end in zip(cuts, [*cuts[1:], len(block)]):
                if held and block[start] != last:
                    yield from done()
                    held = []
                held.append(batch.slice(start, end - start))
                last = block[start]
        if held:
            yield from done()

    return dealt.mapInArrow(run, f"q {q_type.simpleString()}, key {key_type.simpleString()}, score double")


def _best(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc("score"), "key")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def opened(queries: DataFrame, path: str, k: int, query_key: str = "query_id", tokenizer: Callable[[Column | str], Column] = T.technical_tokens, digits: int = 6) -> DataFrame:
    """(q, block, bound, first, open): the blocks that hold a query's terms, what they can reach, and whether a search opens them, at first or at all."""
    return _opened(queries, path, k, query_key, tokenizer, digits)[0]


def _opened(queries: DataFrame, path: str, k: int, query_key: str, tokenizer: Callable[[Column | str], Column], digits: int) -> tuple:
    plan = _plan(queries, path, query_key, tokenizer)
    if plan is None:
        return None, None, None, None, 1.0
    weighted, postings, sums = plan
    weighted = stores.kept(weighted, "query-terms")
    avgdl = sums["tokens"] / sums["n"]
    # A document may lack the term, so one of negative weight adds nothing at most.
    most = F.greatest(F.col("w") * _impact(F.col("tf"), F.col("dl"), avgdl), F.lit(0.0))
    bounds = postings.select("term", "block", "tf", "dl").join(weighted, "term")
    bounds = stores.kept(bounds.groupBy("q", "block").agg(F.sum(most).alias("bound")), "block-bounds")
    # The first are the k blocks of the highest bounds: in most of them some document comes near.
    w = Window.partitionBy("q").orderBy(F.desc("bound"), "block")
    first = bounds.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("q", "block")
    found = _scored(first, weighted, postings, avgdl, k, digits)
    reached = _best(found, k).where(F.col("rank") == k).select("q", F.col("score").alias("least"))
    # Half a digit of rounding, and the order in which sums are added, may lift a score.
    slack = 10.0**-digits
    marked = bounds.join(first.withColumn("first", F.lit(True)), ["q", "block"], "left").join(reached, "q", "left")
    first_ = F.coalesce("first", F.lit(False))
    can = F.col("least").isNull() | (F.col("bound") + slack >= F.col("least"))
    return marked.select("q", "block", "bound", first_.alias("first"), (first_ | can).alias("open")), found, weighted, postings, avgdl


def search(queries: DataFrame, path: str, k: int, query_key: str = "query_id", key: str = "chunk_id", tokenizer: Callable[[Column | str], Column] = T.technical_tokens, digits: int = 6) -> DataFrame:
    """(query_key, key, score, rank): as lexical.search over the indexed documents, from the index alone.

    A query without an indexed term has no rows, nor has any over an empty index.
    """
    marked, found, weighted, postings, avgdl = _opened(queries, path, k, query_key, tokenizer, digits)
    if marked is None:
        return queries.select(F.col(query_key), F.lit(None).cast("string").alias(key), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    rest = marked.where("open AND NOT first").select("q", "block")
    scored = found.unionByName(_scored(rest, weighted, postings, avgdl, k, digits))
    return _best(scored, k).select(F.col("q").alias(query_key), F.col("key").alias(key), "score", "rank")
