"""Queries over composed retrieval plans: chunks with string keys, searched, fused, chosen and packed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .operators import entities, generation, index, metrics, ranking
from .plans import retrieval
from .queries import BM25_SQL, MEANS, MEANS_SQL, METRICS_SQL, _metrics, content_sql, fold_sql, phrase_sql, query, squeeze_sql, table
from .sources import stores

LETTERS = "etaoinsr"
SECTIONS = ("Method", "References", "results", None)


def letters(c) -> F.Column:
    """A text's counts of some letters: a model of texts that SQL has too."""
    text = F.coalesce(T._col(c), F.lit(""))
    return F.array(*[(F.length(text) - F.length(F.replace(text, F.lit(x), F.lit("")))).cast("double") for x in LETTERS])


def corpus(spark, sf) -> retrieval.Corpus:
    """Documents as chunks: four sections in turn, a paper a source."""
    section = F.element_at(F.array(*map(F.lit, SECTIONS)), (F.col("doc_id") % 4 + 1).cast("int"))
    chunks = table(spark, sf, "documents").select(
        F.concat(F.lit("c"), "doc_id").alias("chunk_id"), F.col("source").alias("paper_id"), F.concat(F.lit("Paper of "), "source").alias("title"), section.alias("section"), F.col("doc_id").alias("ord"), "text"
    )
    return retrieval.Corpus(chunks, None, letters)


def asked(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.concat(F.lit("q"), "item_id").alias("query_id"), "text")


CHUNKS_SQL = "ch AS (SELECT 'c' || doc_id AS chunk_id, source AS paper_id, 'Paper of ' || source AS title, ['Method', 'References', 'results', NULL][doc_id % 4 + 1] AS section, doc_id AS ord, text FROM documents)"
ASKED_SQL = "ask AS (SELECT 'q' || item_id AS query_id, text FROM benchmark)"


def bm25_sql(queries: str = "ask") -> str:
    return BM25_SQL.replace("doc_id", "chunk_id").replace("FROM documents", "FROM ch").replace("FROM queries", f"FROM {queries}")


def letters_sql(x: str) -> str:
    return "[" + ", ".join(f"(length(coalesce({x}, '')) - length(replace(coalesce({x}, ''), '{c}', '')))::DOUBLE" for c in LETTERS) + "]"


DENSE_SQL = f"""cv AS (SELECT chunk_id, {letters_sql('text')} AS e FROM ch WHERE length(trim(coalesce(text, ''))) > 0), av AS (SELECT query_id, {letters_sql('text')} AS e FROM ask),
dsc AS (SELECT query_id, chunk_id, CASE WHEN list_sum(av.e) > 0 AND list_sum(cv.e) > 0 THEN round(list_cosine_similarity(av.e, cv.e), 6) ELSE 0 END AS score FROM av, cv), dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dsc)"""


def fused_sql(backend: int, k: int) -> str:
    return (
        f"lists AS (SELECT query_id, chunk_id, rank FROM dense WHERE rank <= {backend} UNION ALL SELECT query_id, chunk_id, rank FROM bm25 WHERE rank <= {backend}), "
        "fu AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(rank) AS best_rank FROM lists GROUP BY ALL), "
        f"hybrid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, chunk_id) AS rank FROM fu) WHERE rank <= {k})"
    )


HYBRID_SQL = f"{CHUNKS_SQL}, {ASKED_SQL}, {bm25_sql()}, {DENSE_SQL}, {fused_sql(50, 20)}"
RERANK_SQL = f"""qt_ AS (SELECT query_id, {content_sql('text')} AS q FROM ask), ct AS (SELECT chunk_id, {content_sql('text')} AS c FROM ch),
ps AS (SELECT query_id, chunk_id, rank AS in_rank, round(CASE WHEN len(q) * len(c) > 0 THEN len(list_intersect(q, c)) / sqrt(len(q) * len(c)) ELSE 0.0::DOUBLE END, 6) AS score FROM hybrid JOIN qt_ USING (query_id) JOIN ct USING (chunk_id)),
reranked AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, in_rank) AS rank FROM ps)"""


def diverse_sql(source: str, k: int, per_paper: int = 2, per_section: int = 1) -> str:
    return f"""pl AS (SELECT query_id, chunk_id, rank, paper_id, coalesce(nullif(lower(section), ''), 'unknown') AS sec FROM {source} JOIN ch USING (chunk_id)), kept AS (SELECT * FROM pl WHERE sec NOT IN ('references', 'bibliography', 'front_matter', 'acknowledgements', 'acknowledgments')),
insec AS (SELECT *, row_number() OVER (PARTITION BY query_id, paper_id, sec ORDER BY rank) AS a FROM kept), inpap AS (SELECT *, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY rank) AS b FROM insec WHERE a <= {per_section}),
diverse AS (SELECT * FROM (SELECT query_id, chunk_id, rank AS in_rank, row_number() OVER (PARTITION BY query_id ORDER BY b > 1, rank) AS rank FROM inpap WHERE b <= {per_paper}) WHERE rank <= {k})"""


@query("x05_hybrid_search", f"WITH {HYBRID_SQL} SELECT query_id, chunk_id, score, best_rank::INT AS best_rank, rank::INT AS rank FROM hybrid")
def _(spark, sf):
    return retrieval.hybrid_search(asked(spark, sf), corpus(spark, sf).with_vectors()).select("query_id", "chunk_id", "score", "best_rank", "rank")


@query("x06_application", f"WITH {HYBRID_SQL}, {RERANK_SQL}, {diverse_sql('reranked', 5)} SELECT query_id, chunk_id, in_rank::INT AS in_rank, rank::INT AS rank FROM diverse")
def _(spark, sf):
    found = retrieval.application(asked(spark, sf), corpus(spark, sf).with_vectors(), candidate_k=20, reranker=retrieval.rerank_chunks)
    return found.select("query_id", "chunk_id", "in_rank", "rank")


FACETS_SQL = f"""base AS (SELECT query_id, {squeeze_sql('text')} AS t FROM ask), stem AS (SELECT query_id, t, CASE WHEN len(string_split(t, ' ')) >= 16 THEN regexp_extract(t, '^(.*?[.!?])(?:\\s|$)', 1) ELSE t END AS b FROM base),
fac AS (SELECT query_id AS question_id, query_id || '/' || list AS query_id, list, CASE WHEN list = 0 THEN t ELSE (CASE WHEN b = '' THEN t ELSE b END) || ' ' || s END AS text FROM stem, (SELECT unnest(range(0, 4)) AS list, unnest(['', {", ".join(f"'{s}'" for s in T.EVIDENCE_SUFFIXES)}]) AS s))"""


@query("a05_facet_fusion", f"""
WITH {CHUNKS_SQL}, {ASKED_SQL}, {FACETS_SQL}, {bm25_sql('fac')}, l AS (SELECT question_id, list, chunk_id, rank FROM bm25 JOIN (SELECT query_id, question_id, list FROM fac) USING (query_id) WHERE rank <= 20),
f AS (SELECT question_id AS query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list * 1000 + rank) AS seen FROM l GROUP BY ALL)
SELECT query_id, chunk_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, chunk_id))::INT AS rank FROM f""")
def _(spark, sf):
    return retrieval.facet_search(asked(spark, sf), corpus(spark, sf), 20, retrieval.sparse_search).select("query_id", "chunk_id", "score", "rank")


@query("p11_explicit_rag", f"""
WITH {CHUNKS_SQL}, {ASKED_SQL}, {bm25_sql()}, g AS (SELECT 'q' || item_id AS query_id, item_id % 3 = 0 AS wants FROM benchmark), r AS (SELECT query_id, chunk_id, rank, ord % 7 = 0 OR ord % 11 = 0 AS hit FROM bm25 JOIN ch USING (chunk_id) WHERE rank <= 20)
SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN wants AND hit THEN 0 ELSE 1 END, rank))::INT AS rank FROM r JOIN g USING (query_id)""")
def _(spark, sf):
    c = corpus(spark, sf)
    said = F.when(F.col("ord") % 7 == 0, F.lit(" uses RAG here")).when(F.col("ord") % 11 == 0, F.lit(" Retrieval  augmented generation")).when(F.col("ord") % 5 == 0, F.lit(" drag racing")).otherwise(F.lit(""))
    found = retrieval.sparse_search(asked(spark, sf), c, 20).select("query_id", "chunk_id", "rank").join(c.chunks.select("chunk_id", F.concat(F.coalesce("text", F.lit("")), said).alias("passage")), "chunk_id")
    kinds = F.array(*map(F.lit, ("Name only EXPLICIT uses of RAG", "What explicit claims of dragging are made", "Is it retrieval-augmented generation?")))
    number = F.regexp_extract("query_id", r"\d+", 0).cast("int")
    rows = found.withColumn("question", F.element_at(kinds, number % 3 + 1))
    return ranking.prioritise(rows, retrieval.wants_explicit_rag("question") & F.col("passage").rlike(T.EXPLICIT_RAG)).select("query_id", "chunk_id", "rank")


# ---- named papers -------------------------------------------------------------


def entity_questions(spark, sf) -> DataFrame:
    """Questions that name no, one or several papers, quoted or not, in another case, twice, or inside other words."""
    i = F.col("item_id")
    name = lambda k: F.concat(F.lit("src"), (i * k % 9).cast("string"))
    kinds = F.array(
        F.concat(F.lit("How does PAPER of "), name(1), F.lit(" compare to paper  of "), name(2), F.lit(", and why?")), F.concat(F.lit("What does 'Paper of "), name(1), F.lit("' say beside \"Unknown Work\" here")),
        F.concat(F.lit("Tell of xpaper of "), name(1), F.lit(" and 'Unknown Work.'")), F.concat(F.lit("Paper of "), name(1), F.lit(", paper of "), name(1), F.lit(" again; paper of "), name(4)),
    )
    return table(spark, sf, "benchmark").select(F.concat(F.lit("q"), i).alias("query_id"), F.element_at(kinds, (i % 4 + 1).cast("int")).alias("text"))


TITLES_SQL = "ti AS (SELECT DISTINCT source, 'Paper of ' || source AS title FROM documents), n AS (SELECT item_id, 'q' || item_id AS query_id, item_id % 4 AS k, 'src' || (item_id * 1 % 9) AS n1, 'src' || (item_id * 2 % 9) AS n2, 'src' || (item_id * 4 % 9) AS n4 FROM benchmark)"
NAMED_SQL = f"""{TITLES_SQL}, cand AS (SELECT query_id, k, list_filter(CASE k WHEN 0 THEN [n1, n2] WHEN 1 THEN [n1] WHEN 2 THEN []::VARCHAR[] ELSE [n1, n4] END, lambda x, i: list_position(CASE k WHEN 0 THEN [n1, n2] WHEN 1 THEN [n1] WHEN 2 THEN []::VARCHAR[] ELSE [n1, n4] END, x) = i) AS names FROM n),
nm AS (SELECT query_id, list_concat(list_transform(list_filter(names, lambda x: k = 1 OR list_contains(known, x)), lambda x: 'Paper of ' || x), CASE WHEN k IN (1, 2) THEN ['Unknown Work'] ELSE [] END) AS titles FROM cand, (SELECT list(source) AS known FROM ti))"""


def _titles(spark, sf) -> DataFrame:
    return entities.known_titles(corpus(spark, sf).chunks, "title")


@query("f18_named_papers", f"WITH {NAMED_SQL} SELECT query_id, titles FROM nm WHERE len(titles) > 0")
def _(spark, sf):
    return entities.named_papers(entity_questions(spark, sf), _titles(spark, sf))


@query("f19_entity_queries", f"""
WITH {NAMED_SQL}, q AS (SELECT query_id, titles, unnest(range(0, len(titles))) AS entity FROM nm WHERE len(titles) > 1), x AS (SELECT q.*, titles[entity + 1] AS title, n.* EXCLUDE (query_id) FROM q JOIN n USING (query_id))
SELECT query_id, entity::INT AS entity, title, '"' || title || '" ' || CASE k
  WHEN 0 THEN CASE WHEN entity = 0 THEN 'How does PAPER of ' || n1 || ' compare to paper of ' || n2 || ', and why?' ELSE 'How does compare to paper of ' || n2 || ', and why?' END
  WHEN 1 THEN CASE WHEN entity = 0 THEN 'What does ''Paper of ' || n1 || ''' say beside " " here' ELSE 'What does '' '' say beside "Unknown Work" here' END
  ELSE CASE WHEN entity = 0 THEN 'Paper of ' || n1 || ', paper of ' || n1 || ' again' ELSE 'again; paper of ' || n4 END END AS text FROM x""")
def _(spark, sf):
    questions = entity_questions(spark, sf)
    return entities.entity_queries(questions, entities.named_papers(questions, _titles(spark, sf))).select("query_id", "entity", "title", "text")


ENTITY_SQL = f"""{CHUNKS_SQL}, {NAMED_SQL}, many AS (SELECT query_id, titles FROM nm WHERE len(titles) > 1), en AS (SELECT query_id, titles, unnest(range(0, len(titles))) AS entity FROM many),
eq AS (SELECT en.query_id AS question_id, entity, titles[entity + 1] AS expected, '"' || titles[entity + 1] || '" ' || CASE k
  WHEN 0 THEN CASE WHEN entity = 0 THEN 'How does PAPER of ' || n1 || ' compare to paper of ' || n2 || ', and why?' ELSE 'How does compare to paper of ' || n2 || ', and why?' END
  WHEN 1 THEN CASE WHEN entity = 0 THEN 'What does \'\'Paper of ' || n1 || '\'\' say beside " " here' ELSE 'What does \'\' \'\' say beside "Unknown Work" here' END
  ELSE CASE WHEN entity = 0 THEN 'Paper of ' || n1 || ', paper of ' || n1 || ' again' ELSE 'again; paper of ' || n4 END END AS text FROM en JOIN n USING (query_id)),
gq AS (SELECT query_id, CASE k WHEN 0 THEN 'How does PAPER of ' || n1 || ' compare to paper  of ' || n2 || ', and why?' WHEN 1 THEN 'What does \'\'Paper of ' || n1 || '\'\' say beside "Unknown Work" here' ELSE 'Paper of ' || n1 || ', paper of ' || n1 || ' again; paper of ' || n4 END AS text FROM many JOIN n USING (query_id)),
ask AS (SELECT question_id || '/' || entity AS query_id, text FROM eq UNION ALL SELECT query_id, text FROM gq), {bm25_sql()},
own AS (SELECT b.query_id, b.chunk_id, row_number() OVER (PARTITION BY b.query_id ORDER BY rank) AS rank FROM bm25 b JOIN eq ON b.query_id = question_id || '/' || entity JOIN ch USING (chunk_id) WHERE rank <= 400 AND (contains(lower(ch.title), lower(expected)) OR contains(lower(expected), lower(ch.title)))),
{diverse_sql('own', 4, 4, 2)}, gen AS (SELECT b.* FROM bm25 b JOIN gq USING (query_id) WHERE rank <= 400), {diverse_sql('gen', 4).replace('pl AS', 'pl2 AS').replace('FROM pl ', 'FROM pl2 ').replace('kept', 'kept2').replace('insec', 'insec2').replace('inpap', 'inpap2').replace('diverse AS', 'diverse2 AS')},
found AS (SELECT question_id AS query_id, entity, chunk_id, rank FROM diverse JOIN eq ON query_id = question_id || '/' || entity)""".replace("\\'\\'", "''")


@query("x07_per_entity", f"""
WITH {ENTITY_SQL}, d AS (SELECT query_id, chunk_id, rank * 1000 + entity AS o FROM found UNION ALL SELECT query_id, chunk_id, 1000000 + rank FROM diverse2 WHERE query_id IN (SELECT query_id FROM found)), e AS (SELECT query_id, chunk_id, min(o) AS o FROM d GROUP BY ALL)
SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY o))::INT AS position FROM e""")
def _(spark, sf):
    found, _ = retrieval.per_entity(entity_questions(spark, sf), corpus(spark, sf), _titles(spark, sf), candidate_k=400, search=retrieval.sparse_search)
    return found.select("query_id", "chunk_id", "position")


@query("j13_papers_without_evidence", f"WITH {ENTITY_SQL} SELECT question_id AS query_id, expected AS title FROM eq WHERE (question_id, entity) NOT IN (SELECT (query_id, entity) FROM found)")
def _(spark, sf):
    _, report = retrieval.per_entity(entity_questions(spark, sf), corpus(spark, sf), _titles(spark, sf), candidate_k=400, search=retrieval.sparse_search)
    return retrieval.papers_without_evidence(report)


# ---- contexts -----------------------------------------------------------------


EXPAND_SQL = f"""{CHUNKS_SQL}, {ASKED_SQL}, {bm25_sql()}, g AS (SELECT query_id, chunk_id, rank FROM bm25 WHERE rank <= 4), wide AS (SELECT 'q' || item_id AS query_id FROM benchmark WHERE item_id % 3 > 0),
nb AS (SELECT chunk_id, paper_id, ord, section, lag(chunk_id) OVER w AS p, lag(section) OVER w AS ps, lead(chunk_id) OVER w AS n, lead(section) OVER w AS ns FROM ch WINDOW w AS (PARTITION BY paper_id ORDER BY ord, chunk_id)),
adj AS (SELECT query_id, chunk_id, rank, 0 AS pos_ FROM g UNION ALL SELECT query_id, p, rank, 1 FROM g JOIN wide USING (query_id) JOIN nb USING (chunk_id) WHERE p IS NOT NULL AND coalesce(ps, '') <> 'References' UNION ALL SELECT query_id, n, rank, 2 FROM g JOIN wide USING (query_id) JOIN nb USING (chunk_id) WHERE n IS NOT NULL AND coalesce(ns, '') <> 'References'),
sec AS (SELECT query_id, chunk_id, rank, 0 AS pos_ FROM g UNION ALL SELECT query_id, b.chunk_id, rank, b.ord + 1 FROM g JOIN wide USING (query_id) JOIN ch a USING (chunk_id) JOIN ch b ON a.paper_id = b.paper_id AND a.section IS NOT DISTINCT FROM b.section AND a.chunk_id <> b.chunk_id)"""


def _ranked_sql(name: str) -> str:
    return f"f_{name} AS (SELECT query_id, chunk_id, min_by(rank, rank * 100000 + pos_) AS rank, min(rank * 100000 + pos_) AS o FROM {name} GROUP BY ALL), e_{name} AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY o, chunk_id) AS rank FROM f_{name})"


def _concepts(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.concat(F.lit("q"), "item_id").alias("query_id"), (F.col("item_id") % 3 + F.when(F.col("item_id") % 3 > 0, 1).otherwise(0)).alias("n"))


@query("x08_expansion", f"""
WITH {EXPAND_SQL}, {_ranked_sql('adj')}, {_ranked_sql('sec')}
SELECT 'adjacent' AS mode, query_id, chunk_id, rank::INT AS rank FROM e_adj UNION ALL SELECT 'section', query_id, chunk_id, rank::INT FROM e_sec UNION ALL SELECT 'gold', query_id, chunk_id, rank::INT FROM g""")
def _(spark, sf):
    c, concepts = corpus(spark, sf), _concepts(spark, sf)
    ranked = retrieval.sparse_search(asked(spark, sf), c, 4)
    made = [retrieval.expand(ranked, c.chunks, mode, concepts).select(F.lit(mode).alias("mode"), "query_id", "chunk_id", F.col("rank").cast("int").alias("rank")) for mode in ("adjacent", "section", "gold")]
    return reduce(DataFrame.unionByName, made)


@query("x08_context", f"""
WITH RECURSIVE {EXPAND_SQL}, {_ranked_sql('adj')}, bl AS (SELECT query_id, chunk_id, rank, paper_id || '/' || coalesce(lower(section), 'unknown') AS s, 'Title: ' || title || ' | Authors: Unknown | Year: Unknown' || chr(10) || 'Section: ' || coalesce(section, 'unknown') || chr(10) || '"' || coalesce(text, '') || '"' AS b FROM e_adj JOIN ch USING (chunk_id)),
w AS (SELECT *, 1 + len(string_split({squeeze_sql('b')}, ' ')) AS n FROM bl),
fold AS (SELECT query_id, 0::BIGINT AS i, 0::BIGINT AS used, 0::BIGINT AS kept, []::VARCHAR[] AS seen, NULL::VARCHAR AS b FROM (SELECT DISTINCT query_id FROM w)
  UNION ALL SELECT fold.query_id, i + 1, CASE WHEN used + n <= 900 AND NOT list_contains(seen, s) THEN used + n ELSE used END, CASE WHEN used + n <= 900 AND NOT list_contains(seen, s) THEN kept + 1 ELSE kept END, CASE WHEN used + n <= 900 AND NOT list_contains(seen, s) THEN list_append(seen, s) ELSE seen END,
    CASE WHEN used + n <= 900 AND NOT list_contains(seen, s) THEN '[' || (kept + 1) || '] ' || w.b END FROM fold JOIN w ON fold.query_id = w.query_id AND w.rank = fold.i + 1)
SELECT query_id, sha256(string_agg(b, chr(10) || chr(10) ORDER BY i)) AS digest, count(*) AS blocks FROM fold WHERE b IS NOT NULL GROUP BY query_id""")
def _(spark, sf):
    c = corpus(spark, sf)
    ranked = retrieval.sparse_search(asked(spark, sf), c, 4)
    packed = retrieval.assemble(ranked, c.chunks, 900, "adjacent", _concepts(spark, sf), one_per_section=True)
    counted = packed.groupBy("query_id").agg(F.count("*").alias("blocks"))
    return retrieval.contexts(packed).join(counted, "query_id").select("query_id", F.sha2(F.col("context").cast("binary"), 256).alias("digest"), "blocks")


@query("j05_sources_with_evidence", f"""
WITH {CHUNKS_SQL}, {ASKED_SQL}, {bm25_sql()}, s AS (SELECT 'q' || item_id AS query_id, 'c' || (item_id * 7 + k) AS chunk_id FROM benchmark, (SELECT unnest(range(0, 25)) AS k))
SELECT s.query_id, s.chunk_id, rank::INT AS retrieval_rank, score AS retrieval_score, CASE WHEN rank IS NOT NULL THEN 'sparse' END AS retrieval_source, CASE WHEN rank IS NOT NULL THEN sha256(text) END AS digest
FROM s LEFT JOIN (SELECT * FROM bm25 WHERE rank <= 300) b USING (query_id, chunk_id) LEFT JOIN ch USING (chunk_id)""")
def _(spark, sf):
    c = corpus(spark, sf)
    sources = table(spark, sf, "benchmark").select(F.concat(F.lit("q"), "item_id").alias("query_id"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(24)), lambda k: F.concat(F.lit("c"), F.col("item_id") * 7 + k))).alias("chunk_id"))
    got = retrieval.with_evidence(sources, retrieval.sparse_search(asked(spark, sf), c, 300), c.chunks, "sparse")
    return got.select("query_id", "chunk_id", "retrieval_rank", "retrieval_score", "retrieval_source", F.sha2(F.col("retrieved_text").cast("binary"), 256).alias("digest"))


# ---- ablations ------------------------------------------------------------------


GOLD_SQL = "gold AS (SELECT 'q' || item_id AS query_id, 'c' || (item_id * 17 + k * 31) % (SELECT count(*) FROM documents) AS chunk_id FROM benchmark, (SELECT unnest(range(0, 40)) AS k))"


def _gold(spark, sf) -> DataFrame:
    n = table(spark, sf, "documents").count()
    ids = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda k: F.concat(F.lit("c"), (F.col("item_id") * 17 + k * 31) % n))
    return table(spark, sf, "benchmark").select(F.concat(F.lit("q"), "item_id").alias("query_id"), F.explode(F.array_distinct(ids)).alias("chunk_id"))


def _per_query_sql(runs: str, ks: tuple[int, ...]) -> str:
    return (
        f"gd AS (SELECT DISTINCT * FROM gold), nr AS (SELECT query_id, count(*) AS n FROM gd GROUP BY query_id), hi AS (SELECT r.*, gd.chunk_id IS NOT NULL AS hit FROM {runs} r LEFT JOIN gd USING (query_id, chunk_id)), "
        f"pq AS (SELECT config, query_id, any_value(n) AS n, min(rank) FILTER (hit) AS best, {', '.join(f'count(*) FILTER (hit AND rank <= {k}) AS h{k}' for k in ks)} FROM hi JOIN nr USING (query_id) GROUP BY ALL)"
    )


RUNS_SQL = (
    "rn AS (SELECT 'dense' AS config, query_id, chunk_id, rank FROM dense WHERE rank <= 20 UNION ALL SELECT 'sparse', query_id, chunk_id, rank FROM bm25 WHERE rank <= 20 UNION ALL SELECT 'hybrid_rrf', query_id, chunk_id, rank FROM hybrid "
    "UNION ALL SELECT 'hybrid_rerank', query_id, chunk_id, rank FROM reranked)"
)
ABLATION_SQL = f"{CHUNKS_SQL}, {ASKED_SQL}, {bm25_sql()}, {DENSE_SQL}, {fused_sql(20, 20)}, {RERANK_SQL}, {RUNS_SQL}, {GOLD_SQL}"


@query("x11_ablation", f"""
WITH {ABLATION_SQL}, {_per_query_sql('rn', (8, 20))} SELECT config, count(*) AS n, round(avg(h8::DOUBLE / n), 6) AS recall_8, round(avg(h20::DOUBLE / n), 6) AS recall_20, round(avg(coalesce(1.0::DOUBLE / best, 0)), 6) AS mrr FROM pq GROUP BY config""")
def _(spark, sf):
    runs = retrieval.ablation(asked(spark, sf), corpus(spark, sf).with_vectors())
    rows = metrics.per_query(runs.where("config <> 'hybrid_rerank_mmr'"), _gold(spark, sf), (8, 20), key="chunk_id", digits=None)
    return metrics.summary(rows, ["config"], ["recall_8", "recall_20", "mrr"])


@query("x11_mmr")
def _(spark, sf):
    return retrieval.ablation(asked(spark, sf), corpus(spark, sf).with_vectors()).where("config = 'hybrid_rerank_mmr'")


@query("t11_mmr_bypass", f"WITH {HYBRID_SQL} SELECT query_id, chunk_id, rank::INT AS rank FROM hybrid WHERE rank <= 8")
def _(spark, sf):
    c, q = corpus(spark, sf).with_vectors(), asked(spark, sf)
    return retrieval.mmr_or_first(retrieval.hybrid_search(q, c), q, c, 8)


@query("x12_stage_trace", f"""
WITH {CHUNKS_SQL}, {ASKED_SQL}, {bm25_sql()}, {DENSE_SQL}, {fused_sql(50, 20)}, {RERANK_SQL}, {GOLD_SQL}, tr AS (SELECT 'bm25' AS config, query_id, chunk_id, rank FROM bm25 WHERE rank <= 20 UNION ALL SELECT 'hybrid', query_id, chunk_id, rank FROM hybrid UNION ALL SELECT 'rerank', query_id, chunk_id, rank FROM reranked), {_per_query_sql('tr', (4, 8))},
b AS (SELECT query_id, min(best) FILTER (config = 'hybrid') AS f, min(best) FILTER (config = 'rerank') AS d FROM pq GROUP BY query_id)
SELECT query_id, CASE WHEN f IS NULL OR f > 20 THEN 'candidate_generation' ELSE 'reranker_demotion' END AS stage FROM b WHERE d IS NULL OR d > 4""")
def _(spark, sf):
    return retrieval.stage_trace(asked(spark, sf), corpus(spark, sf).with_vectors(), _gold(spark, sf))[1]


@query("t10_candidates", f"WITH {CHUNKS_SQL}, {ASKED_SQL}, {bm25_sql()} SELECT query_id, rank::INT AS rank, chunk_id, score, paper_id, title, section, sha256(text) AS digest FROM bm25 JOIN ch USING (chunk_id) WHERE rank <= 20")
def _(spark, sf):
    c = corpus(spark, sf)
    rows = retrieval.candidates(retrieval.sparse_search(asked(spark, sf), c, 50), c)
    return rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)).drop("text")


@query("a10_all_failed", f"WITH {ABLATION_SQL}, {_per_query_sql('rn', (20,))} SELECT query_id FROM pq GROUP BY query_id HAVING max(h20) = 0")
def _(spark, sf):
    runs = retrieval.ablation(asked(spark, sf), corpus(spark, sf).with_vectors()).where("config <> 'hybrid_rerank_mmr'")
    return generation.all_failed(metrics.per_query(runs, _gold(spark, sf), (20,), key="chunk_id"))


@query("a10_label_coverage", "SELECT count(*) FILTER (doc_id % 4 > 0) AS chunk, count(*) FILTER (doc_id % 4 = 0) AS paper_fallback FROM documents")
def _(spark, sf):
    labels = F.when(F.col("doc_id") % 8 == 4, F.array().cast("array<string>")).when(F.col("doc_id") % 4 > 0, F.array(F.col("doc_id").cast("string")))
    return generation.label_coverage(table(spark, sf, "documents").select(labels.alias("relevant_chunk_ids")))


@query("a13_config_tier_means", f"WITH {METRICS_SQL}, t AS (SELECT *, 'tier' || (query_id // 50) % 3 AS tier FROM metrics) SELECT config, tier, count(*) AS n, {MEANS_SQL} FROM t GROUP BY ALL")
def _(spark, sf):
    tier = F.concat(F.lit("tier"), (F.floor(F.col("query_id") / 50) % 3).cast("string"))
    return metrics.summary(_metrics(spark, sf).withColumn("tier", tier), ["config", "tier"], MEANS)


@query("st04_enrichment", f"""
WITH {CHUNKS_SQL}, {ASKED_SQL}, x AS (SELECT query_id, ({phrase_sql('text')}) AS p FROM ask) SELECT query_id, CASE WHEN substr(query_id, 2)::INT % 2 = 0 THEN 'new-' || query_id END AS first_new FROM x WHERE {fold_sql('p')} <> ''""")
def _(spark, sf):
    """Half of the questions find nothing at first; what is brought in for them is what they then find."""
    c, q = corpus(spark, sf), asked(spark, sf)
    even = F.regexp_extract("query_id", r"\d+", 0).cast("int") % 2 == 0
    unknown = q.select("query_id", F.when(even, F.concat(F.lit("zzunheard"), "query_id")).otherwise(F.col("text")).alias("text"))

    def enrich(poor: DataFrame) -> DataFrame:
        return poor.select(F.concat(F.lit("new-"), "query_id").alias("chunk_id"), F.lit("new").alias("paper_id"), F.lit("New").alias("title"), F.concat(F.lit("about "), "text").alias("text"))

    found = retrieval.with_enrichment(unknown, c, enrich, search=retrieval.build("sparse", k=5))
    first = found.where("rank = 1").select("query_id", F.when(F.col("chunk_id").startswith("new-"), F.col("chunk_id")).alias("first_new"))
    return first


# ---- the stored index -----------------------------------------------------------


@query("a03_indexed_search", f"""WITH {CHUNKS_SQL}, {ASKED_SQL}, {bm25_sql()} SELECT query_id, chunk_id, score, rank::INT AS rank FROM bm25 WHERE rank <= 10""")
def _(spark, sf):
    """The index is written in two segments; statistics are those of both."""
    path, chunks = stores.new_path(spark, "index"), corpus(spark, sf).chunks
    index.append(chunks.where("ord % 3 > 0"), path)
    index.append(chunks.where("ord % 3 = 0 OR ord % 7 = 0"), path)
    return index.search(asked(spark, sf), path, 10)


@query("st04_indexed_enrichment", f"""
WITH {CHUNKS_SQL}, {ASKED_SQL}, x AS (SELECT query_id, ({phrase_sql('text')}) AS p FROM ask) SELECT query_id, CASE WHEN substr(query_id, 2)::INT % 2 = 0 THEN 'new-' || query_id END AS first_new FROM x WHERE {fold_sql('p')} <> ''""")
def _(spark, sf):
    """As st04_enrichment, of a stored index: what is brought in becomes a segment, and nothing else is read but the index."""
    path = stores.new_path(spark, "index")
    index.append(corpus(spark, sf).chunks, path)
    even = F.regexp_extract("query_id", r"\d+", 0).cast("int") % 2 == 0
    unknown = asked(spark, sf).select("query_id", F.when(even, F.concat(F.lit("zzunheard"), "query_id")).otherwise(F.col("text")).alias("text"))

    def enrich(poor: DataFrame) -> DataFrame:
        return poor.select(F.concat(F.lit("new-"), "query_id").alias("chunk_id"), F.concat(F.lit("about "), "text").alias("text"))

    found = retrieval.indexed_with_enrichment(unknown, path, enrich, k=5)
    return found.where("rank = 1").select("query_id", F.when(F.col("chunk_id").startswith("new-"), F.col("chunk_id")).alias("first_new"))
