"""Streaming forms: answer tokens, the registry, and windowed latencies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T
from ..operators import state
from ..sources import stores


def answers(tokens: DataFrame, patience: str = "10 minutes", ts: str | None = None) -> DataFrame:
    """(request_id, text, n_tokens, finish_reason, cited, truncated) for each request, once it has finished.

    Input stream: request_id, seq, text, finish_reason. Tokens may come out of
    order; a request's state is its tokens so far, dropped when it is done. If ``ts``
    names the column of event time, one that gets nothing for ``patience`` is told
    as it is, with the reason "timeout", and dropped too; else it waits for its end.
    """
    span = int(pd.Timedelta(patience).total_seconds() * 1000)

    def told(key: tuple, seqs: list, texts: list, reason: str) -> pd.DataFrame:
        whole = "".join(t for _, t in sorted(dict(zip(seqs, texts)).items()))
        return pd.DataFrame({"request_id": [key[0]], "text": [whole], "n_tokens": [len(set(seqs))], "finish_reason": [reason]})

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, texts, reason = map(list, state.get) if state.exists else ([], [], [])
        if state.hasTimedOut:
            state.remove()
            yield told(key, seqs, texts, "timeout")
            return
        latest = 0
        for pdf in pdfs:
            seqs += pdf["seq"].tolist()
            texts += pdf["text"].fillna("").tolist()
            reason += [r for r in pdf["finish_reason"] if isinstance(r, str) and r]
            if ts is not None and len(pdf):
                latest = max(latest, int(pdf[ts].max().timestamp() * 1000))
        # Done when the last token has come and none is missing before it.
        if reason and len(set(seqs)) == max(seqs) - min(0, min(seqs)) + 1:
            state.remove()
            yield told(key, seqs, texts, reason[-1])
            return
        state.update((seqs, texts, reason))
        if ts is not None:
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + span)

    if ts is not None:
        tokens = tokens.withWatermark(ts, patience)
    limit = GroupStateTimeout.NoTimeout if ts is None else GroupStateTimeout.EventTimeTimeout
    done = tokens.groupBy("request_id").applyInPandasWithState(
        run, "request_id string, text string, n_tokens long, finish_reason string", "seqs array<long>, texts array<string>, reason array<string>", "append", limit
    )
    return done.withColumn("cited", F.array_distinct(T.citation_numbers("text"))).withColumn("truncated", T.is_truncated("finish_reason"))


def answers_batch(tokens: DataFrame) -> DataFrame:
    """As answers, of a finished log."""
    rows = tokens.groupBy("request_id").agg(F.array_sort(F.collect_set(F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))).alias("s"), F.max_by("finish_reason", F.when(F.col("finish_reason").isNotNull(), F.col("seq"))).alias("finish_reason"))
    rows = rows.where("finish_reason IS NOT NULL")
    return rows.select("request_id", F.array_join(F.transform("s", lambda x: x["text"]), "").alias("text"), F.size("s").cast("long").alias("n_tokens"), "finish_reason")


def registry_sink(log_path: str, view_path: str):
    """A foreachBatch function: appends events to a log, and adds them to the view of the records that they touch.

    The view is a store of the fold's states (``state.registry_states``), its keys
    dealt to folders. A batch is folded by itself, and merged with what the view
    has for its keys, of which only the folders are read that hold any: no older
    event is read again, and batches may come in any order. A batch that is
    delivered again overwrites its own part of the log, and is left out of the
    view; a reader never sees half of one.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        number = batch_id + 1
        log = f"{log_path}/batch={number}"
        batch.write.mode("overwrite").parquet(log)
        if number in stores.batches(spark, view_path):
            return
        new = state.registry_states(spark.read.schema(batch.schema).parquet(log))
        touched = [r[0] for r in new.select(stores.bucket_of("canonical_id")).distinct().collect()]  # as many as there are folders, at most
        before = stores.latest(spark, view_path, "canonical_id", touched)
        if before is not None:
            kept = before.join(new.select("canonical_id"), "canonical_id", "left_semi")
            new = state.merge_registry(new.unionByName(kept))
        stores.upsert(new, view_path, "canonical_id", number, bucketed=True)

    return write


def registry_view(spark: SparkSession, view_path: str) -> DataFrame | None:
    """The registry as the sink has it now; None before its first batch."""
    states = stores.latest(spark, view_path, "canonical_id")
    return None if states is None else state.registry_records(states)


def latency_windows(events: DataFrame, size: str = "1 minute", late: str = "10 minutes", ts: str = "ts", value: str = "value", by: str = "event_type") -> DataFrame:
    """Count and mean of a value by tumbling window and type; later rows than the watermark allows are dropped."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    grouped = events.groupBy(F.window(ts, size).alias("w"), by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"))
    return grouped.select(F.col("w.start").alias("window_start"), by, "n", "mean")
