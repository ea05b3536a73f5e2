"""Summaries of generation runs, layers, buckets and runs against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 6


def generation_summary(rows: DataFrame, rates: dict[str, Column], means: list[str], by: list[str] | None = None) -> DataFrame:
    """Rates of conditions, and means: null where nothing was scored, and 0 then in the ``_mean`` twin."""
    aggs = [F.count("*").alias("n"), *[F.round(F.avg(c.cast("double")), DIGITS).alias(name) for name, c in rates.items()]]
    for m in means:
        aggs += [F.round(F.avg(m), DIGITS).alias(m), F.round(F.coalesce(F.avg(m), F.lit(0.0)), DIGITS).alias(f"{m}_mean")]
    return rows.groupBy(*(by or [])).agg(*aggs)


def layers(rows: DataFrame, retrieved: str, reference: str, metrics: list[str]) -> DataFrame:
    """Means over three layers: all with a reference, those whose context is the reference, and all end to end.

    One pass: each row is counted in each layer that it belongs to.
    """
    same = F.array_sort(F.array_distinct(retrieved)) == F.array_sort(F.array_distinct(reference))
    member = F.array_compact(F.array(F.when(F.size(reference) > 0, F.lit("retrieval")), F.when(same & (F.size(reference) > 0), F.lit("controlled")), F.lit("end_to_end")))
    return rows.withColumn("layer", F.explode(member)).groupBy("layer").agg(F.count("*").alias("n"), *[F.round(F.avg(m), DIGITS).alias(m) for m in metrics])


def buckets(rows: DataFrame, tier: str, bucket: str, names: tuple[str, ...], total: str = "overall") -> DataFrame:
    """(tier, bucket, n, share) for every tier, over all, and every bucket, empty ones too."""
    both = rows.select(F.explode(F.array(F.col(tier).cast("string"), F.lit(total))).alias(tier), bucket)
    counted = both.groupBy(tier).agg(F.count("*").alias("_all"), *[F.count_if(F.col(bucket) == b).alias(b) for b in names])
    long = counted.select(tier, "_all", F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(b).alias("n")) for b in names])).alias("x"))
    return long.select(tier, F.col("x.bucket").alias("bucket"), F.col("x.n").alias("n"), F.round(F.col("x.n") / F.col("_all"), DIGITS).alias("share"))


def pairwise_agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Exact agreement over pairs of which both verdicts are given."""
    pairs = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return pairs.agg(F.count("*").alias("pairs"), F.round(F.avg((F.col(a) == F.col(b)).cast("double")), DIGITS).alias("agreement"))


def tier_report(rows: DataFrame, tier: str, reason: str) -> DataFrame:
    """available, aligned (no reason to skip), the alignment rate, and a histogram of reasons."""
    counts = rows.groupBy(tier, reason).agg(F.count("*").alias("n"))
    got = counts.groupBy(tier).agg(
        F.sum("n").alias("available"), F.coalesce(F.sum(F.when(F.col(reason).isNull(), F.col("n"))), F.lit(0)).alias("aligned"),
        F.array_sort(F.collect_list(F.when(F.col(reason).isNotNull(), F.struct(F.col(reason).alias("reason"), "n")))).alias("skipped"),
    )
    return got.withColumn("alignment_rate", F.round(F.col("aligned") / F.col("available"), DIGITS))


def lowest_examples(log: DataFrame, n: int = 5, key: str = "question_id") -> DataFrame:
    """The n lowest rows of the metric whose mean is lowest."""
    means = log.groupBy("metric").agg(F.round(F.avg("value"), DIGITS).alias("mean")).where("mean IS NOT NULL")
    worst = means.agg(F.min_by("metric", F.struct("mean", "metric")).alias("metric"))
    return log.where("value IS NOT NULL").join(F.broadcast(worst), "metric").orderBy("value", key).limit(n)


def anomalies(log: DataFrame, relevancy: str = "answer_relevancy", key: str = "question_id") -> DataFrame:
    """(key, metric, kind): judgements that were no valid JSON, and relevancies of exactly zero."""
    kind = F.when(F.lower(F.coalesce("reason", F.lit(""))).contains("unavailable"), "invalid_json").when((F.col("metric") == relevancy) & (F.col("value") == 0), "hard_zero")
    return log.select(key, "metric", kind.alias("kind")).where("kind IS NOT NULL").dropDuplicates([key, "metric"])


def transitions(runs: DataFrame, key: str, run: str, value: str, deadband: float = 0.001) -> DataFrame:
    """Each value against the run before: up, down or same."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(run))
    change = F.col(value) - before
    state = F.when(before.isNull(), F.lit(None)).when(change > deadband, "up").when(change < -deadband, "down").otherwise("same")
    return runs.select(key, run, state.alias("transition"))


def run_delta(now: DataFrame, before: DataFrame, key: str, value: str) -> DataFrame:
    """(key, delta): a value minus that of an earlier run; null where either has none."""
    return now.select(key, F.col(value).alias("_a")).join(before.select(key, F.col(value).alias("_b")), key, "left").select(key, F.round(F.col("_a") - F.col("_b"), DIGITS).alias("delta"))


def newest_compatible(checkpoints: DataFrame, signature: str, order: str = "modified") -> DataFrame:
    """The newest checkpoint of a run with the same inputs."""
    return checkpoints.where(F.col("signature") == signature).orderBy(F.desc(order), "path").limit(1)


def with_metrics(questions: DataFrame, log: DataFrame, names: list[str], key: str = "question_id") -> DataFrame:
    """questions with a column for each metric; null where it was not scored."""
    wide = log.groupBy(key).pivot("metric", names).agg(F.first("value"))
    return questions.join(wide, key, "left")


def packing_comparison(rows: DataFrame, by: str = "mode") -> DataFrame:
    """Contexts, words and used share of budgets by packing mode."""
    return rows.groupBy(by).agg(F.count("*").alias("contexts"), F.sum("used").alias("used"), F.round(F.avg(F.col("used") / F.col("budget")), DIGITS).alias("utilisation"))
