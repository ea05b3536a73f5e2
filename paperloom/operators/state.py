"""Registry, checkpoints and evaluation state, folded from event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: what an event sets the status to.
STATUSES = ("discovered", "downloading", "downloaded", "processing", "processed", "indexed", "failed")


def fold_registry(events: DataFrame, key: str = "canonical_id", seq: str = "seq") -> DataFrame:
    """The registry after all events: status, paths, failure and attempts of each identity.

    Input: key, seq, version (int), status, path, error. An event of a newer
    version than any before resets the record, but not its attempts; paths are
    kept unless an event brings one; failure fields are overwritten by each event
    of the current version. A null version resets nothing. One aggregation.
    """
    return registry_records(registry_states(events, key, seq), key)


def registry_states(events: DataFrame, key: str = "canonical_id", seq: str = "seq") -> DataFrame:
    """The fold's state of each identity: key, top, last, named, attempts, n_events. States of parts of the events add up in any order.

    A record is reset for the last time by the first event of its highest version
    (top: the version, and how early it came). The last event of all is never
    before that, and so gives status and error; the last path counts if it is not.
    """
    at = F.col(seq).cast("long")
    return events.groupBy(key).agg(
        F.max(F.struct("version", (-at).alias("early"))).alias("top"), F.max(F.struct(at.alias("seq"), "status", "error")).alias("last"),
        F.max(F.when(F.col("path").isNotNull(), F.struct(at.alias("seq"), "path"))).alias("named"), F.count_if(F.col("status") == "downloading").alias("attempts"), F.count("*").alias("n_events"),
    )


def merge_registry(states: DataFrame, key: str = "canonical_id") -> DataFrame:
    """One state of each identity from those of several parts of its events."""
    best = [F.max(c).alias(c) for c in ("top", "last", "named")]
    return states.groupBy(key).agg(*best, F.sum("attempts").alias("attempts"), F.sum("n_events").alias("n_events"))


def registry_records(states: DataFrame, key: str = "canonical_id") -> DataFrame:
    """The records that states stand for."""
    path = F.when(F.col("named.seq") >= -F.col("top.early"), F.col("named.path"))
    return states.select(key, "top.version", "last.status", path.alias("path"), "last.error", "attempts", "n_events")


def pending(candidates: DataFrame, registry: DataFrame, key: str = "canonical_id", done: tuple[str, ...] = ("processed", "indexed"), files: DataFrame | None = None) -> DataFrame:
    """Candidates that are not done; with ``files`` (path), a record counts as done only if its path is among them."""
    finished = registry.where(F.col("status").isin(*done))
    if files is not None:
        finished = finished.join(files.select("path"), "path", "left_semi")
    return candidates.join(finished.select(key), key, "left_anti")


def run_summary(outcomes: DataFrame, by: str, status: str = "status") -> DataFrame:
    """Counts by outcome."""
    return outcomes.groupBy(by).agg(*[F.count_if(F.col(status) == s).alias(s) for s in STATUSES], F.count("*").alias("total"))


def open_questions(questions: DataFrame, answers: DataFrame, metrics: DataFrame, key: str = "question_id") -> DataFrame:
    """(key, needs_answer, stale_metrics): what a resumed run has to do.

    Metrics older than the answer they judge don't count.
    """
    answered = answers.groupBy(key).agg(F.max("seq").alias("answered"))
    judged = metrics.groupBy(key).agg(F.max("seq").alias("judged"))
    rows = questions.select(key).distinct().join(answered, key, "left").join(judged, key, "left")
    stale = F.col("answered").isNotNull() & (F.col("judged").isNull() | (F.col("judged") < F.col("answered")))
    return rows.select(key, F.col("answered").isNull().alias("needs_answer"), stale.alias("stale_metrics"))


def conflicts(rows: DataFrame, key: str, payload: list[Column | str]) -> DataFrame:
    """Keys that occur with more than one payload."""
    return rows.groupBy(key).agg(F.count_distinct(F.struct(*payload)).alias("variants")).where("variants > 1")


def shares(rows: DataFrame, category: str, targets: dict[str, float], tolerance: float, strict: bool = False) -> DataFrame:
    """(category, n, share, target, within): shares against targets; categories without a target are within none, or with ``strict`` an error."""
    if strict:
        known = F.coalesce(F.col(category).isin(*targets), F.lit(False))
        rows = rows.where(F.when(known, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown category: "), F.coalesce(F.col(category).cast("string"), F.lit("null"))))))
    counted = rows.groupBy(category).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    target = F.lit(None).cast("double")
    for name, value in targets.items():
        target = F.when(F.col(category) == name, F.lit(value)).otherwise(target)
    out = counted.join(F.broadcast(total)).select(category, "n", (F.col("n") / F.col("total")).alias("_s")).withColumn("target", target)
    return out.select(category, "n", F.round("_s", 6).alias("share"), "target", F.coalesce(F.abs(F.col("_s") - F.col("target")) <= tolerance + 1e-12, F.lit(False)).alias("within"))


def calibration(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Agreement of scores with labels by thirds, mean absolute error, and whether agreement suffices (0.80)."""
    third = F.when(F.col(score) >= 2 / 3, 2).when(F.col(score) >= 1 / 3, 1).otherwise(0)
    got = rows.where(F.col(score).isNotNull()).agg(
        F.count("*").alias("n"), F.round(F.avg((third == F.col(label)).cast("double")), 6).alias("agreement"), F.round(F.avg(F.abs(F.col(score) - F.col(label) / 2)), 6).alias("mae")
    )
    return got.withColumn("acceptable", F.col("agreement") >= 0.80)


# When a correctness score is in dispute, and when two judges disagree.
LOW_CORRECTNESS, HIGH_RECALL, SCORE_GAP, JUDGE_GAP = 0.75, 0.80, 0.40, 0.20


def adjudication_reasons(correctness: Column, concept_recall: Column, relevancy: Column) -> Column:
    """Why a correctness score needs a second judge, in order; an empty list if it needs none, or there is no score."""
    low = correctness < LOW_CORRECTNESS
    reasons = F.array(
        F.when(low, F.lit("correctness_below_threshold")), F.when((concept_recall >= HIGH_RECALL) & low, F.lit("high_concept_recall_low_correctness")),
        F.when(F.abs(correctness - relevancy) >= SCORE_GAP, F.lit("correctness_relevancy_disagreement")),
    )
    return F.filter(reasons, lambda r: r.isNotNull())


def adjudicate(cases: DataFrame, generator: str, primary: str, secondary: str, second: Column | None = None) -> DataFrame:
    """cases with triggered, trigger_reasons, secondary_correctness and disagreement.

    Input: correctness, concept_recall, answer_relevancy. The second judge, a column
    (a batched UDF, say), is asked about disputed cases only; it must be another
    model than the generator and the first judge.
    """
    if secondary in (generator, primary):
        raise ValueError("the second judge must be another model than the generator and the first judge")
    rows = cases.withColumn("trigger_reasons", adjudication_reasons(F.col("correctness"), F.col("concept_recall"), F.col("answer_relevancy")))
    rows = rows.withColumn("triggered", F.size("trigger_reasons") > 0)
    asked = F.when(F.col("triggered"), (F.lit(None) if second is None else second).cast("double"))
    rows = rows.withColumn("secondary_correctness", asked)
    apart = F.abs(F.col("correctness") - F.col("secondary_correctness")) >= JUDGE_GAP
    return rows.withColumn("disagreement", F.coalesce(apart, F.lit(False)))
