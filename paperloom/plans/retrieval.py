"""Retrieval plans for whole sets of questions: each is one plan over the tables, whatever the number of questions."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..hooks import embed_column
from ..operators import dense, entities, index, lexical, metrics, ranking
from ..sources import stores

# List lengths at each stage, for searches and for each named paper.
BACKEND_K, HYBRID_K, RERANK_K = 50, 20, 8
ANSWER_K, ENTITY_K, ENTITY_CANDIDATES, ENTITY_SECTION = 5, 4, 30, 2
CONFIGS = ("dense", "sparse", "hybrid_rrf", "hybrid_rerank", "hybrid_rerank_mmr")

Reranker = Callable[[DataFrame, DataFrame, DataFrame, int], DataFrame]


@dataclass(frozen=True)
class Corpus:
    """Chunks (chunk_id, paper_id, title, section, text) and, if dense search is wanted, their vectors (chunk_id, embedding).

    embed makes a column of vectors from a column of questions; it must be the
    model that made the chunks' vectors.
    """

    chunks: DataFrame
    vectors: DataFrame | None = None
    embed: Callable[[Column | str], Column] | None = None

    def with_vectors(self) -> Corpus:
        """The corpus with vectors of its chunks, made by its model or the offline stand-in."""
        embed = self.embed or embed_column()
        return Corpus(self.chunks, self.chunks.where(lexical.has_text("text")).select("chunk_id", embed("text").alias("embedding")), embed)


def bm25(queries: DataFrame, docs: DataFrame, k: int = BACKEND_K, **names) -> DataFrame:
    """(query_id, doc_id, score, rank)."""
    return lexical.search(queries, docs, k, **names)


def sparse_search(queries: DataFrame, corpus: Corpus, k: int = BACKEND_K, threshold: float | None = None) -> DataFrame:
    return lexical.search(queries, corpus.chunks, k, key="chunk_id", threshold=threshold)


def dense_search(queries: DataFrame, corpus: Corpus, k: int = BACKEND_K, threshold: float | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank); the corpus must have vectors."""
    if corpus.vectors is None or corpus.embed is None:
        raise ValueError("dense search needs a corpus with vectors and their model")
    asked = queries.select("query_id", corpus.embed("text").alias("embedding"))
    return dense.search(corpus.vectors, asked, k, key="chunk_id", threshold=threshold)


def hybrid(lists: dict[str, DataFrame], limit: int | None = HYBRID_K, key: str = "doc_id") -> DataFrame:
    """Named rankings (query_id, key, rank) fused by reciprocal rank."""
    tagged = [r.select("query_id", key, F.col("rank").cast("int").alias("rank"), F.lit(n).alias("source")) for n, r in lists.items()]
    return ranking.reciprocal_rank_fusion(reduce(DataFrame.unionByName, tagged), limit=limit, key=key)


def hybrid_search(queries: DataFrame, corpus: Corpus, k: int = HYBRID_K, backend_k: int = BACKEND_K) -> DataFrame:
    """(query_id, chunk_id, score, best_rank, rank): dense and sparse rankings fused by reciprocal rank; sparse alone without vectors."""
    lists = {"sparse": sparse_search(queries, corpus, max(k, backend_k))}
    if corpus.vectors is not None:
        lists["dense"] = dense_search(queries, corpus, max(k, backend_k))
    return hybrid(lists, k, "chunk_id")


def rerank(ranked: DataFrame, queries: DataFrame, docs: DataFrame, k: int = RERANK_K, key: str = "doc_id") -> DataFrame:
    """A ranking re-ordered by the lexical proxy of a cross-encoder; ties keep their order."""
    q = queries.select("query_id", T.content_tokens("text").alias("q_tokens"))
    d = docs.join(ranked.select(key).distinct(), key, "left_semi").select(key, T.content_tokens("text").alias("d_tokens"))
    scored = ranked.select("query_id", key, F.col("rank").alias("in_rank")).join(q, "query_id").join(d, key)
    scored = scored.withColumn("score", F.round(ranking.proxy_score(F.col("q_tokens"), F.col("d_tokens")), 6))
    out = ranking.rerank_rows(scored, "query_id", [F.desc("score"), F.asc("in_rank")])
    return out.where(F.col("rank") <= k).select("query_id", key, "score", "in_rank", "rank")


def rerank_chunks(ranked: DataFrame, queries: DataFrame, chunks: DataFrame, k: int = RERANK_K) -> DataFrame:
    return rerank(ranked, queries, chunks, k, key="chunk_id")


# ---- several queries a question ----------------------------------------------


def fuse_queries(lists: DataFrame, k: int = ranking.RRF_K, key: str = "chunk_id", limit: int | None = None) -> DataFrame:
    """(query_id, key, score, rank) from the rankings of a question's queries: query_id, list, key, rank.

    Every occurrence counts. Ties go to what is seen first, list after list.
    """
    seen = F.min(F.struct("list", "rank")).alias("_seen")
    fused = lists.groupBy("query_id", key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), seen)
    out = ranking.rerank_rows(fused, "query_id", [F.desc("score"), F.col("_seen"), F.asc(key)]).drop("_seen")
    return out if limit is None else out.where(F.col("rank") <= limit)


def facet_search(queries: DataFrame, corpus: Corpus, k: int = HYBRID_K, search: Callable[..., DataFrame] = hybrid_search) -> DataFrame:
    """Each question searched as its evidence queries, their rankings fused. Questions' keys may be of any type."""
    facets = queries.select(F.col("query_id").alias("question_id"), F.posexplode(T.evidence_queries("text")).alias("list", "text"))
    facets = facets.withColumn("query_id", F.to_json(F.struct("question_id", "list")))
    found = search(facets.select("query_id", "text"), corpus, k)
    lists = found.join(facets.select("query_id", "question_id", "list"), "query_id")
    return fuse_queries(lists.select(F.col("question_id").alias("query_id"), "list", "chunk_id", "rank"))


def wants_explicit_rag(question: Column | str) -> Column:
    """Whether a question asks only for what a passage says of retrieval-augmented generation explicitly."""
    low = T.fold(question)
    return (low.contains("explicit") | low.contains("only classify")) & (low.contains("retrieval-augmented generation") | low.rlike(r"\brag\b"))


def application(
    queries: DataFrame, corpus: Corpus, top_k: int = ANSWER_K, candidate_k: int | None = None, per_paper: int = 2, per_section: int = 1, expand: bool = False,
    reranker: Reranker | None = None, where: Column | None = None, search: Callable[..., DataFrame] = hybrid_search,
) -> DataFrame:
    """(query_id, chunk_id, in_rank, rank): candidates of each question, then a diverse choice of them.

    Questions are searched as they are, or with ``expand`` as their evidence
    queries; passages that speak of retrieval-augmented generation come first if the
    question wants only these; ``where``, a condition on columns of queries
    (but for text, as question) and chunks, leaves some; the first candidate_k are reranked,
    and chosen among by paper and section. A question without any result has no row.
    """
    limit = max(top_k, candidate_k or top_k)
    found = facet_search(queries, corpus, limit, search) if expand else search(queries, corpus, limit)
    asked = queries.withColumnRenamed("text", "question")
    rows = found.select("query_id", "chunk_id", "rank").join(asked, "query_id").join(corpus.chunks, "chunk_id")
    rows = ranking.prioritise(rows, wants_explicit_rag("question") & F.col("text").rlike(T.EXPLICIT_RAG))
    if where is not None:
        rows = ranking.rerank_rows(rows.where(where).withColumnRenamed("rank", "_before"), "query_id", ["_before"]).drop("_before")
    rows = rows.where(F.col("rank") <= limit)
    if reranker is not None:
        better = reranker(rows.select("query_id", "chunk_id", "rank"), queries, corpus.chunks, limit).select("query_id", "chunk_id", "rank")
        rows = rows.drop("rank").join(better, ["query_id", "chunk_id"])
    placed = rows.select("query_id", "chunk_id", "rank", F.coalesce("section", F.lit("unknown")).alias("section"), T.diversity_key("paper_id", "title", "chunk_id").alias("paper"))
    chosen = ranking.diversify(placed, top_k, per_paper, per_section)
    return chosen.select("query_id", "chunk_id", "in_rank", "rank")


def per_entity(questions: DataFrame, corpus: Corpus, titles: DataFrame, top_k: int = ENTITY_K, candidate_k: int = ENTITY_CANDIDATES, general: bool = True, reranker: Reranker | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """For questions that name several papers: (query_id, chunk_id, position), and a report (query_id, entity, title, text, chunk_ids).

    Every named paper has a search of its own, of whose first candidate_k chunks its
    own are taken, so that no paper takes another's place; their rankings are dealt in turn, and a general
    search of the question fills up. titles: norm, title, as known_titles makes them; any number of them.
    """
    named = entities.named_papers(questions, titles)
    asked = entities.entity_queries(questions, named).withColumn("question_id", F.col("query_id"))
    asked = asked.withColumn("query_id", F.to_json(F.struct("question_id", "entity")))
    own = entities.title_matches(F.col("expected"), F.col("title"))
    found = application(
        asked.select("query_id", "text", F.col("title").alias("expected")), corpus, top_k, max(candidate_k, top_k), per_paper=top_k, per_section=ENTITY_SECTION, reranker=reranker, where=own, **options
    )
    lists = found.join(asked.select("query_id", "question_id", "entity"), "query_id").select(F.col("question_id").alias("query_id"), "entity", "chunk_id", "rank")
    several = questions.join(asked.select(F.col("question_id").alias("query_id")).distinct(), "query_id", "left_semi")
    rest = application(several, corpus, top_k, max(candidate_k, top_k), reranker=reranker, **options) if general else lists.where("false")
    listed = lists.groupBy("query_id", "entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))
    report = asked.select(F.col("question_id").alias("query_id"), "entity", "title", "text").join(listed, ["query_id", "entity"], "left")
    report = report.withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast(listed.schema["chunk_ids"].dataType)))
    if not general:
        return entities.round_robin_entities(lists, several.select("query_id").limit(0).withColumn("chunk_id", F.lit(None).cast(lists.schema["chunk_id"].dataType)).withColumn("rank", F.lit(0))), report
    return entities.round_robin_entities(lists, rest), report


def route(questions: DataFrame, corpus: Corpus, titles: DataFrame, **options) -> DataFrame:
    """(query_id, chunk_id, position): by named papers for questions that name several, by one search for the others."""
    several, report = per_entity(questions, corpus, titles, **options)
    one = application(questions.join(report.select("query_id").distinct(), "query_id", "left_anti"), corpus, reranker=options.get("reranker"))
    return several.unionByName(one.select("query_id", "chunk_id", F.col("rank").alias("position")))


# ---- contexts ---------------------------------------------------------------


def expand(ranked: DataFrame, chunks: DataFrame, mode: str = "gold", concepts: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, rank): a ranking with, behind each chunk, its neighbours or its section, each chunk at its first place.

    mode: gold adds nothing, adjacent the chunk before and after in the paper
    (unless their section says little), section all of the chunk's. Only
    questions with two required concepts or more, in concepts (query_id, n), are
    expanded; all, if that is not given. chunks: chunk_id, paper_id, section, ord.
    """
    if mode not in ("gold", "adjacent", "section"):
        raise ValueError("mode must be gold, adjacent or section")
    gold = ranked.select("query_id", "chunk_id", "rank", F.lit(0).cast("long").alias("_at"))
    if mode == "gold":
        return gold.drop("_at")
    wide = ranked if concepts is None else ranked.join(concepts.where("n > 1").select("query_id"), "query_id", "left_semi")
    place = chunks.select("chunk_id", "paper_id", "section", "ord")
    mine = wide.select("query_id", "chunk_id", "rank").join(place, "chunk_id")
    other = place.select(F.col("chunk_id").alias("other"), "paper_id", F.col("section").alias("other_section"), F.col("ord").alias("other_ord"))
    if mode == "adjacent":
        w = Window.partitionBy("paper_id").orderBy("ord", "chunk_id")
        beside = place.withColumns({f"_{name}{at}": of(name).over(w) for at, of in ((1, F.lag), (2, F.lead)) for name in ("chunk_id", "section")})
        sides = F.array(*[F.struct(F.col(f"_chunk_id{at}").alias("id"), F.col(f"_section{at}").alias("section"), F.lit(at).alias("at")) for at in (1, 2)])
        near = beside.select("chunk_id", F.explode(sides).alias("other"))
        near = near.where(F.col("other.id").isNotNull() & ~T.slug(F.coalesce("other.section", F.lit(""))).isin(*T.EXCLUDED_SECTIONS))
        more = wide.select("query_id", "chunk_id", "rank").join(near.select("chunk_id", "other"), "chunk_id").select("query_id", F.col("other.id").alias("chunk_id"), "rank", F.col("other.at").cast("long").alias("_at"))
    else:
        same = mine.join(other.withColumnRenamed("paper_id", "other_paper"), (F.col("paper_id") == F.col("other_paper")) & F.col("section").eqNullSafe(F.col("other_section"))).where(F.col("other") != F.col("chunk_id"))
        more = same.select("query_id", F.col("other").alias("chunk_id"), "rank", (F.col("other_ord") + 1).cast("long").alias("_at"))
    rows = ranking.first_occurrence(gold.unionByName(more), ["query_id", "chunk_id"], ["rank", "_at"])
    return ranking.rerank_rows(rows.withColumnRenamed("rank", "_rank"), "query_id", ["_rank", "_at", "chunk_id"]).select("query_id", "chunk_id", "rank")


def blocks(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """ranked with what a context says of each chunk: title, authors, year, section, url, text, and the words that its block has."""
    given = lambda name, kind: F.col(name) if name in chunks.columns else F.lit(None).cast(kind)
    named = chunks.select(
        "chunk_id", F.coalesce(given("paper_id", "string"), F.lit("")).alias("paper_id"), F.coalesce(F.nullif(given("title", "string"), F.lit("")), F.lit("Untitled")).alias("title"),
        F.coalesce(F.nullif(F.array_join(F.coalesce(given("authors", "array<string>"), F.array().cast("array<string>")), ", "), F.lit("")), F.lit("Unknown")).alias("authors"),
        F.coalesce(given("year", "int").cast("string"), F.lit("Unknown")).alias("year"), F.coalesce(F.nullif(given("section", "string"), F.lit("")), F.lit("unknown")).alias("section"), given("url", "string").alias("url"), "text",
    )
    rest = F.concat(F.lit("Title: "), F.col("title"), F.lit(" | Authors: "), F.col("authors"), F.lit(" | Year: "), F.col("year"), F.lit("\nSection: "), F.col("section"), F.lit('\n"'), F.coalesce("text", F.lit("")), F.lit('"'))
    return ranked.join(named, "chunk_id").withColumn("_rest", rest).withColumn("n_words", F.size(F.split(T.squeezed("_rest"), " ")) + 1)


def assemble(ranked: DataFrame, chunks: DataFrame, budget: int = 4000, mode: str = "gold", concepts: DataFrame | None = None, one_per_section: bool = False) -> DataFrame:
    """(query_id, citation_number, chunk_id, paper_id, title, section, n_words, block): what fits each question's context, in order.

    A block that does not fit is skipped, and shorter ones behind it may still
    fit. With one_per_section a section of a paper is taken once. What is left
    depends on what was taken: a fold over each question's bounded list.
    """
    rows = blocks(expand(ranked, chunks, mode, concepts), chunks)
    section = F.concat_ws("\0", "paper_id", T.fold("section"))
    listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", F.col("n_words").cast("long").alias("n"), section.alias("s")))).alias("a"))
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    again = "array_contains(c.seen, x.s)" if one_per_section else "false"
    fold = F.expr(
        f"aggregate(a, named_struct('used', 0L, 'kept', cast(array() as array<{kind}>), 'seen', cast(array() as array<string>)), "
        f"(c, x) -> if(c.used + x.n <= {int(budget)} and not {again}, named_struct('used', c.used + x.n, 'kept', array_append(c.kept, x.chunk_id), 'seen', array_append(c.seen, x.s)), c), c -> c.kept)"
    )
    kept = listed.select("query_id", F.posexplode(fold).alias("pos", "chunk_id"))
    out = kept.join(rows, ["query_id", "chunk_id"]).withColumn("citation_number", F.col("pos") + 1)
    block = F.concat(F.lit("["), F.col("citation_number"), F.lit("] "), F.col("_rest"))
    return out.select("query_id", "citation_number", "chunk_id", "paper_id", "title", "section", "n_words", block.alias("block"))


def contexts(assembled: DataFrame) -> DataFrame:
    """(query_id, context): blocks joined in the order of their numbers."""
    rows = assembled.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("citation_number", "block"))).alias("s"))
    return rows.select("query_id", F.array_join(F.transform("s", lambda x: x["block"]), "\n\n").alias("context"))


def with_evidence(sources: DataFrame, ranked: DataFrame, chunks: DataFrame, source: str = "hybrid") -> DataFrame:
    """sources (query_id, chunk_id, ...) with retrieval_rank, retrieval_score, retrieval_source and retrieved_text; null where nothing was retrieved."""
    found = ranked.select("query_id", "chunk_id", F.col("rank").alias("retrieval_rank"), F.col("score").alias("retrieval_score"), F.lit(source).alias("retrieval_source"))
    return sources.join(found.join(chunks.select("chunk_id", F.col("text").alias("retrieved_text")), "chunk_id"), ["query_id", "chunk_id"], "left")


def papers_without_evidence(report: DataFrame) -> DataFrame:
    """(query_id, title): papers that a question names and for which nothing was found."""
    return report.where(F.size("chunk_ids") == 0).select("query_id", "title")


# ---- factory, sufficiency, enrichment -----------------------------------------


PLANS: dict[str, Callable[..., DataFrame]] = {
    "dense": dense_search, "sparse": sparse_search, "hybrid": hybrid_search, "facets": facet_search, "application": application,
}


def build(config: str | Mapping[str, Any], **options) -> Callable[[DataFrame, Corpus], DataFrame]:
    """A plan (queries, corpus) -> ranking by name, or from a configuration with the key ``kind`` and options.

    kind ``fallback`` takes ``primary``, another configuration, and the options of
    ``with_enrichment``. Unknown kinds and options are errors.
    """
    given = {"kind": config} if isinstance(config, str) else dict(config)
    given |= options
    kind = str(given.pop("kind", "")).strip().lower()
    if kind == "fallback":
        primary = build(given.pop("primary", "hybrid"))
        _known(kind, given, with_enrichment)
        return lambda queries, corpus: with_enrichment(queries, corpus, search=primary, **given)
    if kind not in PLANS:
        raise ValueError(f"unknown retriever {kind!r}; known: {sorted([*PLANS, 'fallback'])}")
    _known(kind, given, PLANS[kind])
    return lambda queries, corpus: PLANS[kind](queries, corpus, **given)


def _known(kind: str, given: Mapping[str, Any], plan: Callable) -> None:
    unknown = set(given) - set(inspect.signature(plan).parameters) | {"queries", "corpus"} & set(given)
    if unknown:
        raise ValueError(f"unknown options for {kind}: {sorted(unknown)}")


def sufficient(ranked: DataFrame, queries: DataFrame, min_results: int = 1, min_score: float | None = None) -> DataFrame:
    """(query_id, n, best, sufficient): queries without results are insufficient."""
    got = ranked.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    rows = queries.select("query_id").distinct().join(got, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    enough = F.col("n") >= min_results
    if min_score is not None:
        enough = enough & F.coalesce(F.col("best") >= min_score, F.lit(False))
    return rows.select("query_id", "n", "best", enough.alias("sufficient"))


def with_enrichment(
    queries: DataFrame, corpus: Corpus, enrich: Callable[[DataFrame], DataFrame | None] | None = None, min_results: int = 1, min_score: float | None = None, search: Callable[..., DataFrame] = hybrid_search,
) -> DataFrame:
    """A ranking; questions whose results do not suffice are asked again, once, of a corpus that ``enrich`` adds chunks to.

    enrich gets the insufficient questions and returns new chunks (or none). Term
    statistics are those of the whole new corpus, so nothing is patched up.
    """
    first = search(queries, corpus)
    if enrich is None:
        return first
    gate = sufficient(first, queries, min_results, min_score)
    poor = queries.join(gate.where("NOT sufficient").select("query_id"), "query_id", "left_semi")
    more = None if poor.isEmpty() else enrich(poor)
    if more is None:
        return first
    known = more.join(corpus.chunks.select("chunk_id"), "chunk_id", "left_anti").dropDuplicates(["chunk_id"])
    wider = Corpus(corpus.chunks.unionByName(known, allowMissingColumns=True), None, corpus.embed)
    wider = wider if corpus.vectors is None else wider.with_vectors()
    again = search(poor, wider)
    return first.join(poor.select("query_id"), "query_id", "left_anti").unionByName(again.select(*first.columns))


def indexed_with_enrichment(queries: DataFrame, path: str, enrich: Callable[[DataFrame], DataFrame | None] | None = None, k: int = ANSWER_K, min_results: int = 1, min_score: float | None = None) -> DataFrame:
    """As with_enrichment, of the stored index at path: what enrich brings in is appended as a segment, and only the insufficient questions are asked again."""
    first = stores.kept(index.search(queries, path, k), "first-ranking")
    gate = sufficient(first, queries, min_results, min_score)
    poor = queries.join(gate.where("NOT sufficient").select("query_id"), "query_id", "left_semi")
    more = None if enrich is None or poor.isEmpty() else enrich(poor)
    if more is None:
        return first
    index.append(more, path)
    return first.join(poor.select("query_id"), "query_id", "left_anti").unionByName(index.search(poor, path, k))


# ---- ablations ----------------------------------------------------------------


def candidates(ranked: DataFrame, corpus: Corpus, k: int = 20) -> DataFrame:
    """The first k of each ranking with what a labeller sees: query_id, rank, chunk_id, score, paper_id, title, section, text."""
    return ranked.where(F.col("rank") <= k).join(corpus.chunks, "chunk_id").select("query_id", "rank", "chunk_id", "score", "paper_id", "title", "section", "text")


def mmr_or_first(ranked: DataFrame, queries: DataFrame, corpus: Corpus, k: int, bypass_below: int = HYBRID_K) -> DataFrame:
    """(query_id, chunk_id, rank): a ranking's first k picked for diversity; as they are, if k is below ``bypass_below``."""
    if k < bypass_below:
        return ranked.where(F.col("rank") <= k).select("query_id", "chunk_id", F.col("rank").cast("int").alias("rank"))
    rows = ranked.join(corpus.vectors.select("chunk_id", F.col("embedding").alias("vector")), "chunk_id")
    rows = rows.join(queries.select("query_id", corpus.embed("text").alias("query_vector")), "query_id")
    return dense.mmr(rows, k, key="chunk_id").select("query_id", "chunk_id", "rank")


def ablation(queries: DataFrame, corpus: Corpus, k: int = HYBRID_K) -> DataFrame:
    """(config, query_id, chunk_id, rank) of five configurations, each stage fed by the one before."""
    d, s = dense_search(queries, corpus, k), sparse_search(queries, corpus, k)
    fused = hybrid({"dense": d, "sparse": s}, k, "chunk_id")
    better = rerank_chunks(fused, queries, corpus.chunks, k)
    diverse = mmr_or_first(better, queries, corpus, k)
    named = zip(CONFIGS, (d, s, fused, better, diverse))
    return reduce(DataFrame.unionByName, [r.select(F.lit(n).alias("config"), "query_id", "chunk_id", F.col("rank").cast("int").alias("rank")) for n, r in named])


def stage_trace(queries: DataFrame, corpus: Corpus, gold: DataFrame, cut: Sequence[int] = (4, 8), depth: int = HYBRID_K) -> tuple[DataFrame, DataFrame]:
    """Metrics of the sparse, fused and reranked lists at each cut, and for each missed question the stage that lost it."""
    s = sparse_search(queries, corpus, depth)
    fused = hybrid_search(queries, corpus, depth)
    better = rerank_chunks(fused, queries, corpus.chunks, depth)
    runs = reduce(DataFrame.unionByName, [r.select(F.lit(n).alias("config"), "query_id", "chunk_id", F.col("rank").cast("int").alias("rank")) for n, r in (("bm25", s), ("hybrid", fused), ("rerank", better))])
    per_query = metrics.per_query(runs, gold, tuple(cut), key="chunk_id")
    return per_query, metrics.miss_stage(per_query.select("config", "query_id", "best"), "hybrid", "rerank", depth, min(cut))
