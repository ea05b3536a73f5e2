"""Metrics of generated answers: per answer as columns, per run as one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

DIGITS = 6
# Verdicts that count as judged.
JUDGED = ("supported", "partially_supported", "unsupported")


def names(values: Column) -> Column:
    """Distinct names in normal form, blank ones left out; null has none."""
    low = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: T.fold(T.squeezed(x)))
    return F.array_distinct(F.filter(low, lambda x: x != ""))


def _share(common: Column, of: Column) -> Column:
    return F.size(common) / F.greatest(F.size(of), F.lit(1))


def item_precision(predicted: Column, expected: Column) -> Column:
    """Share of the named items that are expected; 0 if none is named, null if none is expected."""
    return context_precision(names(predicted), names(expected), F.lit(True))


def item_recall(predicted: Column, expected: Column) -> Column:
    """Share of the expected items that are named; null if none is expected."""
    return context_recall(names(predicted), names(expected), F.lit(True))


def completeness(present: Column, required: Column) -> Column:
    """Share of the required fields that are there; 1 if none is required."""
    return F.coalesce(item_recall(present, required), F.lit(1.0))


def context_precision(retrieved: Column, reference: Column, reviewed: Column) -> Column:
    """Share of the retrieved keys that are in the reference; null if that is empty or nobody reviewed it."""
    got, gold = F.array_distinct(retrieved), F.array_distinct(reference)
    return F.when(reviewed & (F.size(gold) > 0), _share(F.array_intersect(got, gold), got))


def context_recall(retrieved: Column, reference: Column, reviewed: Column) -> Column:
    """Share of the reference that was retrieved; null if that is empty or nobody reviewed it."""
    got, gold = F.array_distinct(retrieved), F.array_distinct(reference)
    return F.when(reviewed & (F.size(gold) > 0), _share(F.array_intersect(got, gold), gold))


def claim_coverage(claims: Column) -> Column:
    """Share of claims (structs with citations) that cite something; 0 without claims."""
    return F.when(F.size(claims) > 0, F.size(F.filter(claims, lambda c: F.size(c["citations"]) > 0)) / F.size(claims)).otherwise(F.lit(0.0))


def _verdicts(check: str) -> Column:
    """The verdicts of one check, folded."""
    mine = F.filter("judge_verdicts", lambda v: v["check"] == check)
    return F.transform(mine, lambda v: F.lower(F.trim(v["verdict"])))


def _count(verdicts: Column, *labels: str) -> Column:
    return F.sum(F.size(F.filter(verdicts, lambda v: v.isin(*labels))))


def aggregate(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The rates and means of a run's answers, in one pass; null where a nullable one was never scored, 0 for the others.

    Input: citation_valid, claim_citation_coverage, required_field_completeness,
    concept_recall, finish_reason, retry_count, max_item_compliant,
    qualifying_item_precision and _recall, judge_verdicts (array of check and
    verdict), judge_status, calibration_exact_agreement, latency_ms,
    estimated_cost, direct_context_precision and _recall.
    """
    def mean(c: Column) -> Column:
        return F.round(F.coalesce(F.avg(c.cast("double")), F.lit(0.0)), DIGITS)

    def nullable(name: str) -> Column:
        return F.round(F.avg(name), DIGITS)

    claims, items = _verdicts("claim_support"), _verdicts("item_qualification")

    def unsupported(verdicts: Column) -> Column:
        judged = _count(verdicts, *JUDGED)
        return F.round(F.when(judged > 0, _count(verdicts, JUDGED[2]) / F.greatest(judged, F.lit(1))), DIGITS)

    grounded = F.filter("judge_verdicts", lambda v: (v["check"] == "claim_support") & (v["verdict"] == JUDGED[0]))
    every = F.sum(F.size(claims))
    out = {
        "questions": F.count("*"), "citation_validity_rate": mean(F.col("citation_valid")), "claim_level_citation_coverage": mean(F.col("claim_citation_coverage")),
        "required_field_completeness": mean(F.col("required_field_completeness")), "concept_recall": nullable("concept_recall"), "truncation_rate": mean(T.is_truncated("finish_reason")),
        "retry_rate": mean(F.col("retry_count") > 0), "max_item_compliance_rate": mean(F.col("max_item_compliant")), "qualifying_item_precision": nullable("qualifying_item_precision"),
        "qualifying_item_recall": nullable("qualifying_item_recall"), "unsupported_claim_rate": unsupported(claims), "incorrect_classification_rate": unsupported(items),
        "unsupported_qualifying_items": F.coalesce(_count(items, JUDGED[2]), F.lit(0)), "grounded_claim_rate": F.round(F.when(every > 0, F.sum(F.size(grounded)) / F.greatest(every, F.lit(1))), DIGITS),
        "judge_coverage": mean(F.col("judge_status") == "judged"), "calibration_exact_agreement": nullable("calibration_exact_agreement"), "avg_latency_ms": mean(F.col("latency_ms")),
        "avg_cost": nullable("estimated_cost"), "direct_context_precision": nullable("direct_context_precision"), "direct_context_recall": nullable("direct_context_recall"),
    }
    return runs.groupBy(*(by or [])).agg(*[c.alias(name) for name, c in out.items()])


def dataset_coverage(questions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many questions there are, are reviewed, and have a reference answer."""
    has = F.coalesce(F.trim("reference_answer") != "", F.lit(False))
    return questions.groupBy(*(by or [])).agg(
        F.count("*").alias("total"), F.count_if("reviewed").alias("reviewed"), F.count_if(~F.coalesce("reviewed", F.lit(False))).alias("unreviewed"),
        F.count_if(has).alias("with_reference_answer"), F.count_if(~has).alias("without_reference_answer"), F.lit(0).cast("long").alias("evaluated"),
    )


def label_coverage(golden: DataFrame, chunks: str = "relevant_chunk_ids") -> DataFrame:
    """(chunk, paper_fallback): questions that have gold chunks, and those judged by paper."""
    has = F.coalesce(F.size(chunks) > 0, F.lit(False))
    return golden.agg(F.count_if(has).alias("chunk"), F.count_if(~has).alias("paper_fallback"))


def all_failed(per_query: DataFrame, hit: str = "hit_20", query: str = "query_id") -> DataFrame:
    """Queries for which no configuration found anything relevant."""
    return per_query.groupBy(query).agg(F.max(hit).alias("_best")).where("_best = 0").select(query)
