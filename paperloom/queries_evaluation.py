"""Registered queries over corpus and report operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .operators import corpus, documents, metrics, ranking, reports
from .queries import LOG_SQL, QUESTION_SQL, _latest, content_sql, fold_sql, overlap_sql, phrase_sql, query, questions, squeeze_sql, table

SECTIONS = ("abstract", "methodology", "results", "references", "conclusion", "other")
CHUNK_SQL = "chunks AS (SELECT doc_id AS chunk_id, source AS paper_id, ['abstract', 'methodology', 'results', 'references', 'conclusion', 'other'][doc_id % 6 + 1] AS section, text, (doc_id * 37 % 1000)::INT AS start_char, lang FROM documents)"


def _chunks(spark, sf):
    name = F.element_at(F.array(*map(F.lit, SECTIONS)), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("paper_id"), name.alias("section"), "text", (F.col("doc_id") * 37 % 1000).cast("int").alias("start_char"), "lang")


@query("p10_title_matches", f"""
WITH t AS (SELECT DISTINCT source, lang FROM documents), k AS (SELECT source, lang, replace({phrase_sql("'The ' || source || ' Study'")}, ' ', '') AS a, replace({phrase_sql("'study'")}, ' ', '') AS b, replace({phrase_sql('source')}, ' ', '') AS c FROM t)
SELECT source, lang, contains(a, b) OR contains(b, a) AS by_word, contains(a, c) OR contains(c, a) AS by_name FROM k""")
def _(spark, sf):
    t = table(spark, sf, "documents").select("source", "lang").distinct()
    title = F.concat(F.lit("The "), "source", F.lit(" Study"))
    return t.select("source", "lang", corpus.title_matches(title, F.lit("study")).alias("by_word"), corpus.title_matches(title, F.col("source")).alias("by_name"))


@query("p17_tagging", f"""
WITH {CHUNK_SQL} SELECT chunk_id, section, CASE section WHEN 'abstract' THEN 'front' WHEN 'methodology' THEN 'method' WHEN 'results' THEN 'evidence' WHEN 'references' THEN 'back' WHEN 'conclusion' THEN 'closing' ELSE 'other' END AS section_family,
       CASE WHEN chunk_id % 2 = 0 THEN 2020 ELSE 2015 END::INT AS year, lang AS language FROM chunks""")
def _(spark, sf):
    c = _chunks(spark, sf)
    mine = F.when(F.col("chunk_id") % 2 == 0, F.create_map(F.lit("year"), F.lit("2020"), F.lit("lang"), F.col("lang"))).otherwise(F.create_map(F.lit("lang"), F.col("lang")))
    papers = c.select("paper_id").distinct().withColumn("metadata", F.create_map(F.lit("published"), F.lit("2015-01-01"), F.lit("lang"), F.lit("xx")))
    out = corpus.tag(c.withColumn("metadata", mine).withColumn("section", F.initcap("section")), papers)
    return out.select("chunk_id", "section", "section_family", "year", F.try_element_at("metadata", F.lit("lang")).alias("language"))


@query("w09_showcase", f"""
WITH {CHUNK_SQL}, k AS (SELECT *, list_position(['abstract', 'methodology', 'experiments', 'results', 'limitations', 'conclusion', 'discussion', 'introduction', 'analysis'], section) AS p FROM chunks WHERE section <> 'references'),
n AS (SELECT *, row_number() OVER (PARTITION BY paper_id, section ORDER BY CASE WHEN section = 'abstract' THEN start_char ELSE -length(text) END, chunk_id) AS n FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY NOT (p IS NOT NULL AND n = 1), CASE WHEN p IS NOT NULL AND n = 1 THEN p END, start_char, chunk_id) AS rank FROM n)
SELECT paper_id, chunk_id, section, rank::INT AS rank FROM r WHERE rank <= 6""")
def _(spark, sf):
    return corpus.showcase(_chunks(spark, sf), 6)


@query("w10_fill_pool", f"""
WITH {CHUNK_SQL}, f AS (SELECT paper_id AS question_id, chunk_id, row_number() OVER (PARTITION BY paper_id ORDER BY chunk_id) AS pos FROM chunks), g AS (SELECT question_id, chunk_id, 0 AS tier, pos FROM f WHERE pos <= 3),
o AS (SELECT paper_id AS question_id, chunk_id, 1 AS tier, row_number() OVER (PARTITION BY paper_id ORDER BY start_char, chunk_id) AS pos FROM chunks), u AS (SELECT * FROM g UNION ALL SELECT * FROM o),
d AS (SELECT *, row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY tier, pos) AS n FROM u)
SELECT question_id, chunk_id, position::INT AS position FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY tier, pos) AS position FROM d WHERE n = 1) WHERE position <= 8""")
def _(spark, sf):
    c = _chunks(spark, sf).withColumnRenamed("paper_id", "question_id")
    fixed = ranking.rerank_rows(c, "question_id", ["chunk_id"], "pos").where("pos <= 3")
    return corpus.fill_pool(fixed, c, 8, order=["start_char", "chunk_id"])


@query("j03_ordered_lookup", f"WITH {CHUNK_SQL}, l AS (SELECT paper_id, list(chunk_id ORDER BY chunk_id DESC) AS ids FROM chunks GROUP BY paper_id), e AS (SELECT paper_id, generate_subscripts(ids, 1) - 1 AS pos, unnest(ids) AS chunk_id FROM l) SELECT e.paper_id, pos::INT AS pos, chunk_id, section FROM e JOIN chunks USING (chunk_id)")
def _(spark, sf):
    c = _chunks(spark, sf)
    lists = c.groupBy("paper_id").agg(F.sort_array(F.collect_list("chunk_id"), asc=False).alias("ids"))
    return corpus.ordered_lookup(lists, c.select("chunk_id", "section")).select("paper_id", "pos", "chunk_id", "section")


@query("j14_missing_references", "SELECT DISTINCT user_id AS question_id, event_id AS doc_id FROM events WHERE event_id NOT IN (SELECT doc_id FROM documents)")
def _(spark, sf):
    refs = table(spark, sf, "events").select(F.col("user_id").alias("question_id"), F.col("event_id").alias("doc_id"))
    return corpus.missing(refs, table(spark, sf, "documents"), "question_id", "doc_id")


@query("j11_fallback_lookup", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'id' || doc_id ELSE 'title ' || (doc_id % 10) END AS found FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents")
    rows = d.select("doc_id", F.concat(F.lit("id"), F.col("doc_id")).alias("canonical_id"), F.concat(F.lit("t"), F.col("doc_id") % 10).alias("title"))
    by_id = d.where("doc_id % 2 = 0").select(F.concat(F.lit("id"), F.col("doc_id")).alias("canonical_id"), F.lit(None).cast("string").alias("title"), F.concat(F.lit("id"), F.col("doc_id")).alias("found"))
    by_title = d.select(F.lit(None).cast("string").alias("canonical_id"), F.concat(F.lit("t"), F.col("doc_id") % 10).alias("title"), F.concat(F.lit("title "), F.col("doc_id") % 10).alias("found"))
    return corpus.lookup_with_fallback(rows, by_id.unionByName(by_title), "canonical_id", "title", "found").select("doc_id", "found")


@query("j08_same_section", f"WITH {CHUNK_SQL}, c AS (SELECT paper_id AS query_id, min(chunk_id) AS chunk_id FROM chunks GROUP BY paper_id) SELECT query_id, c.chunk_id, o.chunk_id AS other FROM c JOIN chunks m USING (chunk_id) JOIN chunks o ON o.paper_id = m.paper_id AND o.section = m.section AND o.chunk_id <> m.chunk_id")
def _(spark, sf):
    from .operators import answers

    c = _chunks(spark, sf)
    chosen = c.groupBy(F.col("paper_id").alias("query_id")).agg(F.min("chunk_id").alias("chunk_id"))
    return answers.same_section(chosen, c)


@query("j19_right_paper_wrong_chunk", f"""
WITH {CHUNK_SQL}, r AS (SELECT paper_id AS query_id, chunk_id, row_number() OVER (PARTITION BY paper_id ORDER BY start_char, chunk_id) AS rank FROM chunks), g AS (SELECT paper_id AS query_id, max(chunk_id) AS chunk_id FROM chunks GROUP BY paper_id)
SELECT query_id, count(*) AS n FROM r WHERE rank <= 4 AND query_id NOT IN (SELECT query_id FROM r JOIN g USING (query_id, chunk_id) WHERE rank <= 4) GROUP BY query_id""")
def _(spark, sf):
    c = _chunks(spark, sf)
    ranked = ranking.rerank_rows(c.withColumnRenamed("paper_id", "query_id"), "query_id", ["start_char", "chunk_id"])
    gold = c.groupBy(F.col("paper_id").alias("query_id")).agg(F.max("chunk_id").alias("chunk_id"))
    return corpus.right_paper_wrong_chunk(ranked, gold, c)


@query("t13_seeded_sample", "SELECT item_id FROM benchmark ORDER BY sha256('1701:' || item_id) LIMIT 15")
def _(spark, sf):
    return table(spark, sf, "benchmark").select("item_id").orderBy(corpus.seeded_order(F.col("item_id"), 1701)).limit(15)


@query("f05_discovery_overlap", f"""
WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower({QUESTION_SQL}), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS b FROM benchmark)
SELECT item_id, round({overlap_sql('a', 'b')}, 6) AS overlap FROM q""")
def _(spark, sf):
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    b = table(spark, sf, "benchmark")
    q = questions(spark, sf).withColumnRenamed("text", "q").join(b, "item_id")
    return q.select("item_id", F.round(T.overlap(words(F.col("q")), words(F.col("text"))), 6).alias("overlap"))


@query("f46_joined_lines", r"""
WITH t AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) || '  two' || chr(9) || ' words' || chr(10) || 'go' || chr(10) || ' on:' || chr(10) || 'end.' || chr(10) || chr(10) || chr(10) || 'x' AS t FROM documents),
l AS (SELECT doc_id, string_split(t, chr(10)) AS p FROM t), j AS (SELECT doc_id, array_to_string(list_transform(p, lambda x, i: CASE WHEN i = 1 THEN x WHEN right(p[i - 1], 1) IN ('.', '!', '?', ':', ';') OR trim(x) = '' AND i < len(p) THEN chr(10) || x ELSE ' ' || x END), '') AS t FROM l)
SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ' || chr(10) || chr(9) || chr(13))) AS digest FROM j""")
def _(spark, sf):
    t = F.concat(F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("  two\t words\ngo\n on:\nend.\n\n\nx"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(documents.joined_lines(t).cast("binary"), 256).alias("digest"))


@query("p01_blank_filter", "SELECT conv_id, turn FROM conversations WHERE length(trim(CASE WHEN turn % 4 = 3 THEN '   ' ELSE text END)) > 0")
def _(spark, sf):
    from .operators import lexical

    return table(spark, sf, "conversations").where(lexical.has_text(F.when(F.col("turn") % 4 == 3, "   ").otherwise(F.col("text")))).select("conv_id", "turn")


@query("a15_generation_summary", """
SELECT role, count(*) AS n, round(avg((length(text) > 200)::INT), 6) AS long_rate, round(avg(CASE WHEN turn % 2 = 0 AND role <> 'system' THEN turn END), 6) AS score, round(coalesce(avg(CASE WHEN turn % 2 = 0 AND role <> 'system' THEN turn END), 0), 6) AS score_mean FROM conversations GROUP BY role""")
def _(spark, sf):
    c = table(spark, sf, "conversations").withColumn("score", F.when((F.col("turn") % 2 == 0) & (F.col("role") != "system"), F.col("turn").cast("double")))
    return reports.generation_summary(c, {"long_rate": F.length("text") > 200}, ["score"], ["role"])


@query("a17_layers", """
WITH r AS (SELECT event_id, value, [event_id % 3, 7] AS retrieved, CASE WHEN event_id % 4 = 0 THEN [] WHEN event_id % 4 = 1 THEN [7, event_id % 3] ELSE [9::BIGINT] END AS reference FROM events),
l AS (SELECT 'end_to_end' AS layer, value FROM r UNION ALL SELECT 'retrieval', value FROM r WHERE len(reference) > 0 UNION ALL SELECT 'controlled', value FROM r WHERE len(reference) > 0 AND list_sort(list_distinct(retrieved)) = list_sort(list_distinct(reference)))
SELECT layer, count(*) AS n, round(avg(value), 6) AS value FROM l GROUP BY layer""")
def _(spark, sf):
    i = F.col("event_id")
    ref = F.when(i % 4 == 0, F.array().cast("array<bigint>")).when(i % 4 == 1, F.array(F.lit(7).cast("long"), i % 3)).otherwise(F.array(F.lit(9).cast("long")))
    return reports.layers(table(spark, sf, "events").select("value", F.array(i % 3, F.lit(7).cast("long")).alias("retrieved"), ref.alias("reference")), "retrieved", "reference", ["value"])


@query("a22_agreement", "SELECT count(*) AS pairs, round(avg((a = b)::INT), 6) AS agreement FROM (SELECT CASE WHEN event_id % 5 <> 0 THEN event_id % 3 END AS a, CASE WHEN event_id % 7 <> 0 THEN event_id % 2 END AS b FROM events) WHERE a IS NOT NULL AND b IS NOT NULL")
def _(spark, sf):
    i = F.col("event_id")
    return reports.pairwise_agreement(table(spark, sf, "events").select(F.when(i % 5 != 0, i % 3).alias("a"), F.when(i % 7 != 0, i % 2).alias("b")), "a", "b")


@query("a24_tier_report", """
WITH r AS (SELECT event_type AS tier, CASE event_id % 4 WHEN 0 THEN 'ambiguous' WHEN 1 THEN 'no_chunks' END AS reason FROM events)
SELECT tier, count(*)::BIGINT AS available, count(*) FILTER (reason IS NULL) AS aligned, round(count(*) FILTER (reason IS NULL)::DOUBLE / count(*), 6) AS alignment_rate, count(*) FILTER (reason = 'ambiguous') AS ambiguous FROM r GROUP BY tier""")
def _(spark, sf):
    i = F.col("event_id")
    r = table(spark, sf, "events").select(F.col("event_type").alias("tier"), F.when(i % 4 == 0, "ambiguous").when(i % 4 == 1, "no_chunks").alias("reason"))
    return reports.tier_report(r, "tier", "reason").select("tier", "available", "aligned", "alignment_rate", F.element_at(F.filter("skipped", lambda x: x["reason"] == "ambiguous"), 1)["n"].alias("ambiguous"))


@query("a25_buckets", """
WITH b AS (SELECT unnest(['view', 'click', 'refund']) AS bucket), t AS (SELECT lang AS tier, count(*) AS all_ FROM (SELECT (user_id % 3)::VARCHAR AS lang FROM events) GROUP BY ALL UNION ALL SELECT 'overall', count(*) FROM events),
c AS (SELECT (user_id % 3)::VARCHAR AS tier, event_type AS bucket FROM events UNION ALL SELECT 'overall', event_type FROM events)
SELECT tier, bucket, (SELECT count(*) FROM c WHERE c.tier = t.tier AND c.bucket = b.bucket) AS n, round((SELECT count(*) FROM c WHERE c.tier = t.tier AND c.bucket = b.bucket)::DOUBLE / all_, 6) AS share FROM t, b""")
def _(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 3).alias("tier"), "event_type")
    return reports.buckets(e, "tier", "event_type", ("view", "click", "refund"))


@query("t09_lowest_examples", f"WITH {LOG_SQL}, m AS (SELECT metric, round(avg(value), 6) AS mean FROM latest GROUP BY metric), w AS (SELECT metric FROM m ORDER BY mean, metric LIMIT 1) SELECT question_id, metric, value FROM latest WHERE metric = (SELECT metric FROM w) AND value IS NOT NULL ORDER BY value, question_id LIMIT 5")
def _(spark, sf):
    return reports.lowest_examples(_latest(spark, sf)).select("question_id", "metric", "value")


@query("p27_judge_anomalies", f"WITH {LOG_SQL} SELECT question_id, metric, CASE WHEN status = 'unavailable' THEN 'invalid_json' ELSE 'hard_zero' END AS kind FROM latest WHERE status = 'unavailable' OR (metric = 'view' AND status = 'failed')")
def _(spark, sf):
    log = _latest(spark, sf).withColumn("reason", F.when(F.col("status") == "unavailable", "Judge Unavailable: bad JSON"))
    return reports.anomalies(log.withColumn("value", F.when(F.col("status") == "failed", 0.0).otherwise(F.col("value") + 1)), relevancy="view")


@query("j09_questions_with_metrics", f"WITH {LOG_SQL}, q AS (SELECT DISTINCT user_id AS question_id FROM events UNION SELECT -1) SELECT question_id, min(value) FILTER (metric = 'view') AS view, min(value) FILTER (metric = 'click') AS click FROM q LEFT JOIN latest USING (question_id) GROUP BY question_id")
def _(spark, sf):
    q = table(spark, sf, "events").select(F.col("user_id").alias("question_id")).distinct()
    q = q.unionByName(spark.range(1).select(F.lit(-1).cast(q.schema["question_id"].dataType).alias("question_id")))
    return reports.with_metrics(q, _latest(spark, sf), ["view", "click"])


@query("w14_transitions", "WITH v AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT user_id, event_id, CASE WHEN before IS NULL THEN NULL WHEN value - before > 0.001::DOUBLE THEN 'up' WHEN value - before < -0.001::DOUBLE THEN 'down' ELSE 'same' END AS transition FROM v")
def _(spark, sf):
    return reports.transitions(table(spark, sf, "events"), "user_id", "event_id", "value")


@query("a34_run_delta", "WITH a AS (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'view' GROUP BY user_id), b AS (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'click' GROUP BY user_id) SELECT a.user_id, round(a.v - b.v, 6) AS delta FROM a LEFT JOIN b USING (user_id)")
def _(spark, sf):
    e = table(spark, sf, "events")
    mean = lambda kind: e.where(F.col("event_type") == kind).groupBy("user_id").agg(F.avg("value").alias("v"))
    return reports.run_delta(mean("view"), mean("click"), "user_id", "v")


@query("t12_newest_checkpoint", "SELECT event_id AS path, event_id // 3 AS modified FROM events WHERE event_type = 'view' ORDER BY event_id // 3 DESC, event_id LIMIT 1")
def _(spark, sf):
    c = table(spark, sf, "events").select(F.col("event_id").alias("path"), F.floor(F.col("event_id") / 3).alias("modified"), F.col("event_type").alias("signature"))
    return reports.newest_compatible(c, "view").select("path", "modified")


@query("a27_known_titles", f"SELECT DISTINCT {fold_sql(squeeze_sql('source'))} AS title FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select(T.fold(T.squeeze("source")).alias("title")).distinct()


@query("f03_shared_tokens", f"WITH t AS (SELECT item_id, {content_sql('text')} AS t FROM benchmark) SELECT a.item_id, len(list_intersect(a.t, b.t)) AS shared FROM t a JOIN t b ON b.item_id = a.item_id + 1")
def _(spark, sf):
    t = table(spark, sf, "benchmark").select("item_id", T.content_tokens("text").alias("t"))
    n = t.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("n"))
    return t.join(n, "item_id").select("item_id", F.size(F.array_intersect("t", "n")).cast("long").alias("shared"))


@query("f14_query_clean", r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text || chr(9) || 'e' || chr(769) || chr(8203) || ' x' || chr(7)), '[\r\n\t]', ' ', 'g'), '\p{C}', '', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents")
def _(spark, sf):
    text = F.concat("text", F.lit("\te\u0301\u200b x\x07"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.normalised_query(text).cast("binary"), 256).alias("digest"))


@query("f20_compound_parts", rf"""
WITH q AS (SELECT item_id, {squeeze_sql("(CASE WHEN item_id % 2 = 0 THEN 'What ' ELSE 'Say ' END) || replace(lower(text), ' and ', ' ') || ' as well as why it is so?'")} AS q FROM benchmark)
SELECT item_id, CASE WHEN regexp_matches(q, '(?i)^(.*?\b(?:{T.QUESTION_STEMS})\b.*?)\s+(?:and|as well as)\s+(.*\b(?:{T.QUESTION_STEMS})\b.*)$')
  THEN [trim(regexp_extract(q, '(?i)^(.*?\b(?:{T.QUESTION_STEMS})\b.*?)\s+(?:and|as well as)\s+(.*\b(?:{T.QUESTION_STEMS})\b.*)$', 1), ' ,;?'), trim(regexp_extract(q, '(?i)^(.*?\b(?:{T.QUESTION_STEMS})\b.*?)\s+(?:and|as well as)\s+(.*\b(?:{T.QUESTION_STEMS})\b.*)$', 2), ' ,;?')]
  ELSE [trim(q, '?')] END AS parts FROM q""")
def _(spark, sf):
    stem = F.when(F.col("item_id") % 2 == 0, "What ").otherwise("Say ")
    q = F.concat(stem, F.replace(F.lower("text"), F.lit(" and "), F.lit(" ")), F.lit(" as well as why it is so?"))
    return table(spark, sf, "benchmark").select("item_id", T.question_parts(q).alias("parts"))
