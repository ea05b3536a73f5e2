"""Contexts, citations, claims and structured answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T

# Fixed value: the lexical support that a claim needs.
MIN_SUPPORT = 0.2


def neighbours(chunks: DataFrame, paper: str = "paper_id", order: str = "ord", key: str = "chunk_id") -> DataFrame:
    """Each chunk with the keys before and after it in its paper; low-information sections are left out."""
    w = Window.partitionBy(paper).orderBy(order)
    kept = chunks.where(~T.slug("section").isin(*T.EXCLUDED_SECTIONS)) if "section" in chunks.columns else chunks
    return kept.withColumn("previous", F.lag(key).over(w)).withColumn("next", F.lead(key).over(w))


def same_section(chosen: DataFrame, chunks: DataFrame, paper: str = "paper_id", key: str = "chunk_id") -> DataFrame:
    """(query_id, key, other): other chunks of the section of each chosen chunk."""
    place = chunks.select(F.col(key), F.col(paper), "section")
    mine = chosen.join(place, key)
    others = place.select(F.col(key).alias("other"), paper, "section")
    return mine.join(others, [paper, "section"]).where(F.col(key) != F.col("other")).select("query_id", key, "other")


def pack(ranked: DataFrame, budget: int, group: str = "query_id", key: str = "chunk_id", size: str = "n_words") -> DataFrame:
    """Chunks that fit a budget in rank order; one that doesn't fit is skipped, and later ones may fit.

    A fold over each query's bounded list: what is left of the budget depends on
    what was taken. Numbers the chunks kept from 1.
    """
    listed = ranked.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(key).alias("k"), F.col(size).cast("long").alias("n")))).alias("a"))
    kind = ranked.schema[key].dataType.simpleString()
    fold = F.expr(
        f"aggregate(a, named_struct('used', 0L, 'kept', cast(array() as array<{kind}>)), "
        f"(c, x) -> if(c.used + x.n <= {int(budget)}, named_struct('used', c.used + x.n, 'kept', array_append(c.kept, x.k)), c), c -> c)"
    )
    packed = listed.select(group, fold.alias("c")).select(group, F.col("c.used").alias("used"), F.posexplode("c.kept").alias("pos", key))
    return packed.select(group, key, (F.col("pos") + 1).alias("citation_number"), "used")


def check_citations(answers: DataFrame, text: str = "text", known: str = "known") -> DataFrame:
    """answers with cited (distinct, in order), unknown (cited, not in the map) and unused (in the map, not cited)."""
    cited = F.array_distinct(T.citation_numbers(text))
    rows = answers.withColumn("cited", cited)
    return rows.withColumn("unknown", F.array_except("cited", known)).withColumn("unused", F.array_except(known, "cited")).withColumn(
        "valid", (F.size("unknown") == 0) & (F.size("cited") > 0) & (F.size(T.native_citations(text)) == 0)
    )


def split_claims(answers: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key..., claim_id, claim, citations): a claim's number counts all fragments, blank ones too."""
    rows = answers.select(*key, F.posexplode(T.claims(text)).alias("pos", "raw"))
    clean = F.regexp_replace(F.regexp_replace("raw", r"\[([^\[\]]+)\]", ""), r"\s+([.,;:!?])", "$1")
    rows = rows.select(*key, F.concat(F.lit("claim-"), F.col("pos") + 1).alias("claim_id"), F.btrim(clean, F.lit(" |.\t\n\r")).alias("claim"), T.citation_numbers("raw").alias("citations"))
    return rows.where("claim <> ''")


def support(claims: DataFrame, evidence: DataFrame, key: list[str], least: float = MIN_SUPPORT) -> DataFrame:
    """claims with the share of their content tokens found in the evidence they cite, and whether that suffices.

    evidence: key..., n (citation number), tokens. Tokens of several sources count together.
    """
    cited = claims.select(*key, "claim_id", "claim", F.explode_outer("citations").alias("n"))
    joined = cited.join(evidence, [*key, "n"], "left").groupBy(*key, "claim_id", "claim").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("seen"))
    share = F.round(T.overlap(T.content_tokens("claim"), F.col("seen")), 6)
    return joined.select(*key, "claim_id", share.alias("score"), (share >= least).alias("supported"))


def support_flags(claims: DataFrame, evidence: DataFrame, key: list[str], least: float = MIN_SUPPORT) -> DataFrame:
    """key..., claim_id, status and score of each claim: unknown_citation, missing_citation, supported or unsupported.

    claims: key..., claim_id, claim, citations; evidence: key..., n, tokens. The
    score, a share of the claim's tokens, is null where nothing was compared.
    """
    cited = claims.select(*key, "claim_id", "claim", F.explode_outer("citations").alias("n"))
    joined = cited.join(evidence.withColumn("_known", F.lit(1)), [*key, "n"], "left").groupBy(*key, "claim_id", "claim").agg(
        F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("seen"), F.count("n").alias("cited"), F.count("_known").alias("known")
    )
    share = T.overlap(T.content_tokens("claim"), F.col("seen"))
    status = (
        F.when(F.col("known") < F.col("cited"), "unknown_citation").when(F.col("cited") == 0, "missing_citation").when((share > 0) & (share >= least), "supported").otherwise("unsupported")
    )
    return joined.select(*key, "claim_id", status.alias("status"), F.when(status.isin("supported", "unsupported"), F.round(share, 4)).alias("score"))


def repair_mojibake(text: str) -> str:
    """UTF-8 that was read as Windows-1252, read right; other texts as they are."""
    try:
        return text.encode("cp1252").decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return text


@F.pandas_udf(StringType())
def _repaired(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: repair_mojibake(t) if isinstance(t, str) else None)


def repaired(c: Column | str) -> Column:
    """As repair_mojibake, for a column; only texts with the marks of such a mistake leave the JVM."""
    text = T._col(c)
    odd = text.rlike("[\u00c2-\u00f4][\u0080-\u00bf\u0152-\u0192\u02c6\u02dc\u2013-\u2122]")
    return F.when(odd, _repaired(F.when(odd, text))).otherwise(text)


def concept_details(answers: DataFrame, required: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, concept, matched, matched_by, matched_phrase) of each distinct required concept of an answer.

    required: key, pos, concept, aliases. A phrase matches anywhere in the answer's
    normal form; the concept's own before its aliases, in their order. Concepts of
    one normal form count once, the first; blank ones don't.
    """
    said = answers.select(key, T.phrase(text).alias("said"))
    rows = required.withColumn("_primary", T.phrase("concept")).where("_primary <> ''")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key, "_primary").orderBy("pos"))).where("_n = 1").join(said, key)
    aliases = F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda x: F.col("said").contains(T.phrase(x)))
    primary, alias = F.col("said").contains(F.col("_primary")), F.try_element_at(aliases, F.lit(1))
    return rows.select(
        key, "pos", "concept", (primary | alias.isNotNull()).alias("matched"), F.when(primary, "primary").when(alias.isNotNull(), "alias").alias("matched_by"),
        F.when(primary, F.col("concept")).otherwise(alias).alias("matched_phrase"),
    )


def concept_recall(answers: DataFrame, required: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, found, required, recall): required concepts named in the answer. No requirement is null, not 0."""
    got = concept_details(answers, required, key, text).groupBy(key).agg(F.count_if("matched").alias("found"), F.count("*").alias("required"))
    rows = answers.select(key).join(got, key, "left").select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("found", "required")])
    return rows.withColumn("recall", F.when(F.col("required") > 0, F.round(F.col("found") / F.greatest(F.col("required"), F.lit(1)), 6)))
