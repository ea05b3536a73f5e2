"""Exact nearest neighbours by cosine, and selection for diversity."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources import stores

#: Queries compared in one pass over the vectors, which bounds what is broadcast; and rows multiplied with them at once.
BLOCK_QUERIES, STRIP = 4096, 1024


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _block_search(rows: DataFrame, wanted: DataFrame, ddl: str, k: int, part: slice, exclude_self: bool, digits: int, threshold: float | None) -> DataFrame:
    """Candidates (q, key, score) for one block of queries: among them each query's k best rows.

    A task passes on a row if no more than k of its rows so far score higher, so
    what leaves it shrinks as it goes on; nothing is sorted.
    """
    got = wanted.collect()  # no more than a block
    ids, own = [r["q"] for r in got], {r["q"]: i for i, r in enumerate(got)}
    matrix = _unit(np.array([r["v"] for r in got], dtype=float)[:, part]) if got else np.zeros((0, 0))
    shared = rows.sparkSession.sparkContext.broadcast((ids, own, matrix))
    arrow = to_arrow_type(wanted.schema["q"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own, matrix = shared.value
        names, floor = pa.array(ids, arrow), np.full(len(ids), -np.inf)
        for whole in batches:
            for at in range(0, whole.num_rows if len(ids) else 0, STRIP):
                batch = whole.slice(at, STRIP)
                x = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(float)[:, part]
                score = np.round(matrix @ _unit(x).T, digits) + 0.0
                if exclude_self:
                    for j, key in enumerate(batch.column(0).to_pylist()):
                        if key in own:
                            score[own[key], j] = -np.inf
                if threshold is not None:
                    score[score < threshold] = -np.inf
                if score.shape[1] > k:
                    floor = np.maximum(floor, np.partition(score, score.shape[1] - k, axis=1)[:, -k])
                q, j = np.nonzero((score >= floor[:, None]) & (score > -np.inf))
                if len(q):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), batch.column(0).take(pa.array(j)), pa.array(score[q, j])], names=["q", "key", "score"])

    return rows.mapInArrow(run, ddl)


def search(
    vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", query_key: str = "query_id", vector: str = "embedding",
    part: slice = slice(None), exclude_self: bool = False, where: Column | None = None, digits: int = 6, threshold: float | None = None,
) -> DataFrame:
    """(query_key, key, score, rank): the k rows of largest cosine for each query; ties by key. Keys may be of any type.

    Queries go in blocks of about BLOCK_QUERIES, dealt by a hash, against all
    rows: a block is broadcast, and each task passes on little more than its own k
    best rows a query. Filters and the threshold come before the k are chosen.
    Rows of a null vector never match; a zero vector has cosine 0.
    """
    rows = (vectors if where is None else vectors.where(where)).where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("v"))
    wanted = queries.where(F.col(vector).isNotNull()).select(F.col(query_key).alias("q"), F.col(vector).alias("v")).dropDuplicates(["q"])
    blocks = max(1, -(-wanted.count() // BLOCK_QUERIES))
    ddl = f"q {wanted.schema['q'].dataType.simpleString()}, key {rows.schema['key'].dataType.simpleString()}, score double"
    lots = [wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b) for b in range(blocks)]
    found = reduce(DataFrame.unionByName, [_block_search(rows, lot, ddl, k, part, exclude_self, digits, threshold) for lot in lots])
    w = Window.partitionBy("q").orderBy(F.desc("score"), "key")
    # At most k rows a query are left, and plans read them several times: the vectors are compared once.
    ranked = stores.kept(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), "ranking")
    return ranked.select(F.col("q").alias(query_key), F.col("key").alias(key), "score", "rank")


def mmr_order(query: np.ndarray, candidates: np.ndarray, k: int, weight: float = 0.5) -> list[int]:
    """Positions picked one by one: most relevant, least similar to those picked. Ties go to the first."""
    unit, target = _unit(np.atleast_2d(candidates).astype(float)), _unit(np.atleast_2d(query).astype(float))[0]
    relevance, nearest = unit @ target, np.zeros(len(unit))
    left, out = np.ones(len(unit), bool), []
    while left.any() and len(out) < k:
        gain = np.where(left, weight * relevance - (1 - weight) * nearest, -np.inf)
        pick = int(np.argmax(gain))
        sims = unit @ unit[pick]
        nearest = sims if not out else np.maximum(nearest, sims)
        out.append(pick)
        left[pick] = False
    return out


def mmr(candidates: DataFrame, k: int, weight: float = 0.5, group: str = "query_id", key: str = "vec_id") -> DataFrame:
    """(group, key, score, rank): candidates re-picked for diversity within each group.

    Input: group, key, rank, score, query_vector, vector. A group is a query's
    candidate list, which is bounded by the search's k. Keys may be of any type.
    """
    kinds = [candidates.schema[c].dataType.simpleString() for c in (group, key)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", key]).reset_index(drop=True)
        at = mmr_order(np.array(pdf["query_vector"][0]), np.stack(pdf["vector"].to_numpy()), k, weight)
        out = pdf.loc[at, [group, key, "score"]]
        return out.assign(rank=np.arange(1, len(out) + 1, dtype=np.int32))

    return candidates.groupBy(group).applyInPandas(run, f"{group} {kinds[0]}, {key} {kinds[1]}, score double, rank int")
