"""A cleaning pipeline over documents: five stages, each written out and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bpe, decontamination, jaccard, langid, suffixes
from paperloom.llm.common import read_table, settled


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the others go.

    Texts that are null or have no letter go, and those whose margin is narrow.
    Repeated rows share their fate. An empty table stays empty.
    """
    model = langid.fit(docs.where(~langid.is_held_out()))
    return langid.identify(docs, model).where(~F.col("rejected")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id.

    Null, empty and blank texts are near copies of nothing and stay, as do rows
    without a partner that share a doc_id or have none. Repeated rows of a text
    with words are copies: one stays. An empty table stays empty.
    """
    return jaccard.keep_one(docs, k=5, percent=80)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that occurred before.

    A character that a cut went through is dropped. A document of which nothing
    is left goes; one that was null or empty before stays as it was. Rows equal
    in doc_id and text are one document, and a null doc_id comes first.
    """
    found = suffixes.remove_repeats(docs, threshold=100, kept="text")
    cut = F.col("n_removed") > 0
    found = found.where(~cut | (F.length("kept") > 0)).withColumn("text", F.when(cut, F.col("kept")).otherwise(F.col("text")))
    return found.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of any benchmark item.

    Null and empty texts have no words and stay; repeated rows share their fate.
    An empty benchmark removes nothing.
    """
    return decontamination.clean_documents(docs, read_table(spark, sf_dir, "benchmark"), n=10)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids and decoded text, as digests: a row for each row.

    Null and empty texts have no ids, and the digest of nothing.
    """
    return bpe.round_trip(docs.select("doc_id", "text"), "word_bpe_49k.json").drop("text")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("decontaminate", decontaminate),
    ("tokens", tokens),
]

#: No SQL can express compression, suffix removal or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table documents; what a stage wrote on its way is removed when its result is written."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        docs = settled(lambda: stage(spark, before, sf_dir), spark, f"pipeline-{name}")  # noqa: B023  called at once
    return STAGES[-1][1](spark, docs, sf_dir)
