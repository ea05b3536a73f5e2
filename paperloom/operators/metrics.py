"""Retrieval metrics and their summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 6


def _ideal(n_relevant: Column, k: int) -> Column:
    """Sum of 1/log2(rank+1) over the ranks a perfect list would fill."""
    table = F.array(F.lit(0.0), *[F.lit(sum(1.0 / math.log2(i + 1) for i in range(1, j + 1))) for j in range(1, k + 1)])
    return F.element_at(table, F.least(n_relevant, F.lit(k)).cast("int") + 1)


def per_query(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (5, 8, 20), group: list[str] | None = None, key: str = "doc_id", digits: int | None = None) -> DataFrame:
    """recall, precision, hit and ndcg at each k, and mrr, for each group of ``ranked`` (group..., key, rank).

    ``relevant`` has the last group column and key. Groups without relevant keys
    score 0. Missing places count against precision. Means are taken of unrounded
    values; ``digits`` rounds them, for display.
    """
    group = group or ["config", "query_id"]
    query = group[-1]
    marked = ranked.join(relevant.select(query, key).distinct().withColumn("_hit", F.lit(1)), [query, key], "left")
    return _measured(marked, relevant.groupBy(query).agg(F.count_distinct(key).alias("n_relevant")), ks, group, digits)


def per_query_by_label(
    ranked: DataFrame, queries: DataFrame, labels: DataFrame, ks: tuple[int, ...] = (5, 8, 20), group: list[str] | None = None, key: str = "doc_id", label: str = "label", digits: int | None = None
) -> DataFrame:
    """As per_query, where relevant is what has the query's label, but for the query itself.

    queries (last group column, label), labels (key, label). A label's keys are counted, not paired
    with its queries, so a label may have any number of both. A null label is nothing's.
    """
    group = group or ["config", "query_id"]
    query = group[-1]
    held = labels.where(F.col(label).isNotNull()).select(key, label).distinct()
    own = queries.where(F.col(label).isNotNull()).select(query, label).distinct()
    hits = ranked.select(query, key).distinct().where(F.col(query) != F.col(key)).join(own, query).join(held, [key, label]).select(query, key).distinct()
    sizes = own.join(held.groupBy(label).agg(F.count("*").alias("n")), label)
    itself = held.select(F.col(key).alias(query), label, F.lit(1).alias("self"))
    total = sizes.join(itself, [query, label], "left").groupBy(query).agg(F.sum(F.col("n") - F.coalesce("self", F.lit(0))).alias("n_relevant"))
    return _measured(ranked.join(hits.withColumn("_hit", F.lit(1)), [query, key], "left"), total, ks, group, digits)


def _measured(marked: DataFrame, total: DataFrame, ks: tuple[int, ...], group: list[str], digits: int | None) -> DataFrame:
    """Metrics of ranked rows of which those with _hit = 1 are relevant, and of each query's number of relevant keys."""
    def rounded(c: Column) -> Column:
        return c if digits is None else F.round(c, digits)

    query = group[-1]
    gain = F.when(F.col("_hit") == 1, 1.0 / F.log2(F.col("rank") + 1))
    sums = [F.min(F.when(F.col("_hit") == 1, F.col("rank"))).alias("best")]
    for k in ks:
        inside = (F.col("_hit") == 1) & (F.col("rank") <= k)
        sums += [F.count_if(inside).alias(f"hits_{k}"), F.coalesce(F.sum(F.when(inside, gain)), F.lit(0.0)).alias(f"dcg_{k}")]
    rows = marked.groupBy(*group).agg(*sums).join(total, query, "left").withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0)))
    n, out = F.col("n_relevant"), [*map(F.col, group), F.col("best"), rounded(F.coalesce(1.0 / F.col("best"), F.lit(0.0))).alias("mrr")]
    for k in ks:
        hits = F.col(f"hits_{k}")
        out += [
            rounded(F.when(n > 0, hits / F.greatest(n, F.lit(1))).otherwise(0.0)).alias(f"recall_{k}"), rounded(hits / k).alias(f"precision_{k}"),
            F.when(hits > 0, 1.0).otherwise(0.0).alias(f"hit_{k}"), rounded(F.when(n > 0, F.col(f"dcg_{k}") / F.greatest(_ideal(n, k), F.lit(1e-9))).otherwise(0.0)).alias(f"ndcg_{k}"),
        ]
    return rows.select(*out)


def summary(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Means of metrics by group, with the number of rows; nulls are left out of means."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.round(F.avg(m), DIGITS).alias(m) for m in metrics])


def summary_with_total(rows: DataFrame, by: str, metrics: list[str], total: str = "overall") -> DataFrame:
    """As summary, with a row over all groups; one pass by grouping sets."""
    out = rows.rollup(by).agg(F.grouping(by).alias("_all"), F.count("*").alias("n"), *[F.round(F.avg(m), DIGITS).alias(m) for m in metrics])
    return out.withColumn(by, F.when(F.col("_all") == 1, F.lit(total)).otherwise(F.col(by).cast("string"))).drop("_all")


def latency_profile(rows: DataFrame, by: str, value: str, total: str = "overall", means: tuple[str, ...] = ()) -> DataFrame:
    """n, mean, p50 and p95 by group and over all, and the means of other columns; percentiles interpolate."""
    out = rows.rollup(by).agg(
        *[F.round(F.avg(m), DIGITS).alias(m) for m in means], F.grouping(by).alias("_all"), F.count(value).alias("n"), F.round(F.avg(value), DIGITS).alias("mean"), F.round(F.median(value), DIGITS).alias("p50"), F.round(F.percentile(value, 0.95), DIGITS).alias("p95")
    )
    return out.withColumn(by, F.when(F.col("_all") == 1, F.lit(total)).otherwise(F.col(by).cast("string"))).drop("_all")


def spread(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, population standard deviation, smallest and largest value by group; nulls are left out."""
    return rows.groupBy(*by).agg(
        F.count(value).alias("n"), F.round(F.avg(value), DIGITS).alias("mean"), F.round(F.stddev_pop(value), DIGITS).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most")
    )


def lift(rows: DataFrame, before: str, after: str, short: int = 8, long: int = 20, threshold: float = 0.02) -> DataFrame:
    """Recall of two configurations: before at both depths, after at the short one, lift and promotion efficiency."""
    def mean(config: str, k: int) -> Column:
        return F.avg(F.when(F.col("config") == config, F.col(f"recall_{k}")))

    got = rows.agg(mean(before, short).alias("pre_short"), mean(before, long).alias("pre_long"), mean(after, short).alias("post_short"))
    room = F.col("pre_long") - F.col("pre_short")
    gain = F.col("post_short") - F.col("pre_short")
    return got.select(
        *[F.round(c, DIGITS).alias(c) for c in got.columns], F.round(gain, DIGITS).alias("lift"),
        F.round(F.when(F.abs(room) > 1e-12, gain / F.when(F.abs(room) > 1e-12, room)).otherwise(0.0), DIGITS).alias("promotion_efficiency"), (F.round(gain, DIGITS) >= threshold).alias("meets_threshold"),
    )


def miss_stage(best: DataFrame, fused: str, final: str, depth: int = 20, cut: int = 4) -> DataFrame:
    """For queries whose final list misses: was the key never a candidate, or was it demoted?

    best: config, query_id, best (smallest rank of a relevant key, or null).
    """
    ranks = best.groupBy("query_id").pivot("config", [fused, final]).agg(F.first("best"))
    missed = ranks.where(F.col(final).isNull() | (F.col(final) > cut))
    stage = F.when(F.col(fused).isNull() | (F.col(fused) > depth), "candidate_generation").otherwise("reranker_demotion")
    return missed.select("query_id", stage.alias("stage"))


def recommend(means: DataFrame, order: list[Column]) -> DataFrame:
    """The configuration that is largest in the given order of criteria."""
    return means.agg(F.max_by("config", F.struct(*order)).alias("config"))


def nullable_means(log: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Mean over scored rows, and how many are scored, unavailable and in all; null is no zero."""
    return log.groupBy(*by).agg(
        F.round(F.avg(value), DIGITS).alias("mean"), F.count(value).alias("scored"), (F.count("*") - F.count(value)).alias("unavailable"), F.count("*").alias("total")
    )


def latest(log: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """The last entry of each key; one aggregation, no sort."""
    row = F.max_by(F.struct(*fields), F.col(order)).alias("_row")
    return log.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row.{f}").alias(f) for f in fields])


def status_rollup(entries: DataFrame, run: str, expected: int | Column) -> DataFrame:
    """Terminal and unavailable counts of a run, and completed, partial or failed."""
    n = F.lit(expected) if isinstance(expected, int) else expected
    got = entries.groupBy(run).agg(
        F.count_if(F.col("status").isin("completed", "unavailable")).alias("terminal"), F.count_if(F.col("status") == "unavailable").alias("unavailable"), F.count_if(F.col("status") == "completed").alias("completed")
    )
    state = F.when(F.col("completed") == 0, "failed").when(F.col("terminal") < n, "partial").otherwise("completed")
    return got.withColumn("state", state)
