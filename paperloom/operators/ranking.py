"""Fusion, filtering and selection of ranked lists."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed value: the constant of reciprocal-rank fusion.
RRF_K = 60
RANGE_OPS = {"gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}


def compile_filter(filters: Mapping[str, Any], columns: list[str], mode: str = "sparse") -> Column:
    """A condition from {name: value | list | {gt, gte, lt, lte}}; all must hold.

    A name that is no column is looked up in the map column ``metadata``. Plain
    equality is null-safe. Ranges compare as numbers if their bound is one; a
    value of another type fails. An empty list matches nothing in sparse mode
    and is an error in dense mode.
    """
    if not isinstance(filters, Mapping):
        raise TypeError("filters must be a mapping")
    out: Column = F.lit(True)
    for name, value in filters.items():
        if not isinstance(name, str) or not name.strip():
            raise ValueError("filter names must be non-blank strings")
        field = F.col(name) if name in columns else F.try_element_at(F.col("metadata"), F.lit(name))
        if isinstance(value, Mapping):
            unknown = set(value) - set(RANGE_OPS)
            if unknown or not value:
                raise ValueError(f"unknown range operators: {sorted(unknown)}")
            for op, bound in value.items():
                left = field.try_cast("double") if isinstance(bound, (int, float)) else field
                out = out & F.coalesce(RANGE_OPS[op](left, F.lit(bound)), F.lit(False))
        elif isinstance(value, (list, tuple, set, frozenset)):
            if not value and mode == "dense":
                raise ValueError("an empty list cannot be matched")
            out = out & (F.coalesce(field.isin(*value), F.lit(False)) if value else F.lit(False))
        else:
            out = out & field.eqNullSafe(F.lit(value))
    return out


def first_occurrence(ranked: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return ranked.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def rerank_rows(rows: DataFrame, group: str, order: list[Column | str], name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def reciprocal_rank_fusion(lists: DataFrame, k: int = RRF_K, limit: int | None = None, group: str = "query_id", key: str = "doc_id", source: str = "source", distinct: bool = True) -> DataFrame:
    """(group, key, score, best_rank, rank) from the union of lists (group, source, key, rank).

    Within a list only a key's first rank counts, unless ``distinct`` is off. One
    aggregation, no outer join. Order: score, best rank, key.
    """
    if distinct:
        lists = lists.groupBy(group, source, key).agg(F.min("rank").alias("rank"))
    fused = lists.groupBy(group, key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.min("rank").alias("best_rank"))
    out = rerank_rows(fused, group, [F.desc("score"), F.asc("best_rank"), F.asc(key)])
    return out if limit is None else out.where(F.col("rank") <= limit)


def diversify(ranked: DataFrame, top_k: int = 8, per_paper: int = 2, per_section: int = 1, group: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """At most per_section chunks a section and per_paper a paper; papers' first chunks before second ones.

    Two row numbers, the second over what the first keeps, give what two greedy
    passes would: no loop and no UDF. Input: group, key, paper, section, rank.
    """
    section = F.regexp_replace(F.lower(F.trim(F.coalesce("section", F.lit("")))), r"[\s-]+", "_")
    rows = ranked.withColumn("_section", section).where(~F.col("_section").isin(*T.EXCLUDED_SECTIONS))
    rows = first_occurrence(rows, [group, key], ["rank"])
    rows = rerank_rows(rows.withColumn("_g", F.struct(group, "paper", "_section")), "_g", ["rank", key], "_in_section").where(F.col("_in_section") <= per_section)
    rows = rerank_rows(rows.withColumn("_g", F.struct(group, "paper")), "_g", ["rank", key], "_in_paper").where(F.col("_in_paper") <= per_paper)
    out = rerank_rows(rows.withColumnRenamed("rank", "in_rank"), group, [F.col("_in_paper") > 1, F.col("in_rank"), F.col(key)])
    return out.where(F.col("rank") <= top_k).drop("_section", "_g", "_in_section", "_in_paper")


def round_robin(lists: DataFrame, group: str = "query_id", key: str = "doc_id", source: str = "source") -> DataFrame:
    """Lists dealt in turn, each key at its first place."""
    return rerank_rows(first_occurrence(lists, [group, key], ["rank", source]), group, ["rank", source], "position")


def collapse(ranked: DataFrame, to: str = "paper_id", group: str = "query_id") -> DataFrame:
    """(group, to, rank): each paper at the place of its first chunk."""
    return rerank_rows(first_occurrence(ranked, [group, to], ["rank"]).withColumnRenamed("rank", "_in"), group, ["_in", to]).select(group, to, "rank")


def prioritise(ranked: DataFrame, matches: Column, group: str = "query_id") -> DataFrame:
    """Matching rows first, in the order they had."""
    return rerank_rows(ranked.withColumnRenamed("rank", "in_rank"), group, [(~F.coalesce(matches, F.lit(False))).cast("int"), F.col("in_rank")])


def stratified_take(rows: DataFrame, stratum: str, order: list[Column | str], cap: int, strata: list[str]) -> DataFrame:
    """Rows drawn from the strata in turn until there are cap; the strata's order is given."""
    place = F.array_position(F.array(*map(F.lit, strata)), F.col(stratum))
    numbered = rerank_rows(rows.withColumn("_place", place).where("_place > 0"), stratum, order, "_turn")
    return numbered.orderBy("_turn", "_place").limit(cap).drop("_turn", "_place")


def proxy_score(query: Column, passage: Column) -> Column:
    """Lexical stand-in for a cross-encoder: common tokens over the geometric mean of both counts."""
    n = F.sqrt(F.size(query) * F.size(passage))
    return F.when(n > 0, F.size(F.array_intersect(query, passage)) / n).otherwise(F.lit(0.0))
