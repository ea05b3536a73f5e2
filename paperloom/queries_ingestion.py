"""Queries over discovery, ingestion, stores and benchmark building.

Inputs are put together from parts of the tables' rows, and the SQL puts the
expected output together from the same parts, without the rule in between.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .operators import answers, benchmarks, corpus, dense, documents, lexical, metrics, ranking, references, reports, state
from .plans import generation, ingestion, retrieval
from .queries import content_sql, fold_sql, overlap_sql, query, squeeze_sql, table, tokens_sql
from .queries_retrieval import CHUNKS_SQL, asked
from .queries_retrieval import corpus as chunk_corpus
from .sources import discovery, stores


def _n(name: str = "doc_id") -> F.Column:
    return F.col(name).cast("string")


def _scratch(spark) -> str:
    """A folder for what a query stores, which all executors share."""
    return stores.new_path(spark, "queries")


# ---- references -------------------------------------------------------------


def _numbered(spark, sf) -> DataFrame:
    n = _n()
    text = F.concat(
        F.lit("[1] Smith, A. and Doe, B. Deep things of "), "lang", F.lit(". Journal of "), "source", F.lit(", 2019. doi:10.1234/AB."), n, F.lit(".\nReferences\n17\n[2] C. Jones; D. Li. “Other  matters\nentirely”. In Proc. "), n,
        F.lit(", 2021. arXiv:2101.0"), F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0"), F.lit("v2 https://x.org/"), n, F.lit(".\n[3] Short one\n4. Jones, C. Again the very same work. arXiv:2101.0"), F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0"),
        F.lit("\n5) SMITH. Deep. DOI: 10.1234/ab."), n, F.lit("\n"),
    )
    return table(spark, sf, "documents").select("doc_id", text.alias("t"))


NUMBERED_SQL = r"""b AS (SELECT doc_id, lang, source, lpad((doc_id % 10000)::VARCHAR, 4, '0') AS p FROM documents),
e AS (SELECT doc_id, unnest([
  '[1] Smith, A. and Doe, B. Deep things of ' || lang || '. Journal of ' || source || ', 2019. doi:10.1234/AB.' || doc_id || '.', '[2] C. Jones; D. Li. “Other matters entirely”. In Proc. ' || doc_id || ', 2021. arXiv:2101.0' || p || 'v2 https://x.org/' || doc_id || '.',
  '4. Jones, C. Again the very same work. arXiv:2101.0' || p, '5) SMITH. Deep. DOI: 10.1234/ab.' || doc_id]) AS raw, unnest([0, 1, 2, 3])::INT AS pos FROM b)"""


@query("f26_references", f"WITH {NUMBERED_SQL} SELECT doc_id, pos, raw FROM e")
def _(spark, sf):
    return _numbered(spark, sf).select("doc_id", F.posexplode(references.entries("t")).alias("pos", "raw"))


@query("f26_unnumbered_references", """
SELECT doc_id, unnest(['Smith, John and Doe, B. A study of ' || lang || ' things 2019.', 'O''Neil, P. Second work, on ' || lang || '. Brown, T. is cited in it. 2020. doi:10.5555/' || doc_id, 'Lee-Wong, Ann. Third of ' || lang || ' 2021']) AS raw, unnest([0, 1, 2])::INT AS pos FROM documents""")
def _(spark, sf):
    n = _n()
    text = F.concat(
        F.lit("Intro text 1999.\n  REFERENCES \nSmith, John and Doe, B.\nA study of "), "lang", F.lit(" things\n2019.\nO'Neil, P. Second work, on "), "lang", F.lit(".\nBrown, T. is cited in it. 2020. doi:10.5555/"), n,
        F.lit("\n  12 \nLee-Wong, Ann. Third of "), "lang", F.lit(" 2021\nlee-wong, ann. third of "), "lang", F.lit(" 2021"),
    )
    return table(spark, sf, "documents").select("doc_id", F.posexplode(references.entries(references.section_of_text(text))).alias("pos", "raw"))


@query("f26_sections", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'r' || doc_id WHEN 1 THEN 'w' || doc_id ELSE '' END AS bibliography FROM documents")
def _(spark, sf):
    n = _n()
    kind = F.col("doc_id") % 3
    sections = F.when(kind == 0, F.create_map(F.lit("abstract"), F.lit("a"), F.lit("References"), F.concat(F.lit("r"), n))).when(kind == 1, F.create_map(F.lit("works_cited"), F.concat(F.lit("w"), n), F.lit("references"), F.lit("later"))).otherwise(F.create_map(F.lit("reference list"), F.lit("x")))
    return table(spark, sf, "documents").select("doc_id", references.section_of_map(sections).alias("bibliography"))


@query("f27_reference_fields", f"""
WITH {NUMBERED_SQL} SELECT e.doc_id, pos, [1, 2, 4, 5][pos + 1]::INT AS reference_number, CASE pos WHEN 0 THEN '10.1234/AB.' || e.doc_id WHEN 3 THEN '10.1234/ab.' || e.doc_id END AS doi, CASE pos WHEN 1 THEN '2101.0' || p || 'v2' WHEN 2 THEN '2101.0' || p END AS arxiv_id,
  CASE pos WHEN 0 THEN 2019 WHEN 1 THEN 2021 END::INT AS year, CASE pos WHEN 1 THEN 'https://x.org/' || e.doc_id END AS url,
  CASE pos WHEN 0 THEN 'and Doe, B' WHEN 1 THEN 'Other matters entirely' WHEN 2 THEN 'Again the very same work' END AS title,
  CASE pos WHEN 0 THEN ['Smith, A'] WHEN 1 THEN ['C. Jones', 'D. Li. “'] WHEN 2 THEN ['Jones, C'] ELSE ['SMITH. Deep. DOI: 10.1234/ab.' || e.doc_id] END AS authors,
  CASE pos WHEN 0 THEN 'Deep things of ' || lang || '. Journal of ' || source WHEN 1 THEN '”. In Proc. ' || e.doc_id WHEN 2 THEN NULL END AS venue, CASE pos WHEN 0 THEN 0.75 WHEN 1 THEN 0.85 WHEN 2 THEN 0.65 ELSE 0.55 END::DOUBLE AS confidence
FROM e JOIN b USING (doc_id)""")
def _(spark, sf):
    rows = _numbered(spark, sf).select("doc_id", F.posexplode(references.entries("t")).alias("pos", "raw"))
    return rows.select("doc_id", "pos", references.parse("raw").alias("c")).select("doc_id", "pos", "c.reference_number", "c.doi", "c.arxiv_id", "c.year", "c.url", "c.title", "c.authors", "c.venue", "c.confidence")


@query("f28_predicates", """
SELECT doc_id, doc_id % 4 > 1 AS substantive, doc_id % 4 = 3 AS complete FROM documents""")
def _(spark, sf):
    n, kind = _n(), F.col("doc_id") % 4
    entry = F.when(kind == 0, F.concat(F.lit("[1] two "), n)).when(kind == 1, F.lit("7. a  b")).when(kind == 2, F.concat(F.lit("[2] three words x"), n, F.lit(" in 2019, but open"))).otherwise(F.concat(F.lit("Doe, J. Work "), n, F.lit(" of 2020.")))
    return table(spark, sf, "documents").select("doc_id", references.is_substantive(entry).alias("substantive"), references.is_complete(entry).alias("complete"))


@query("u03_distinct_references", f"WITH {NUMBERED_SQL} SELECT doc_id, pos, raw FROM e WHERE pos < 2")
def _(spark, sf):
    return references.of_documents(_numbered(spark, sf), "doc_id", F.col("t")).select("doc_id", "pos", "raw")


# ---- cleaning, metadata, records ------------------------------------------------


@query("p14_clean_sections", "SELECT doc_id, 'see' || chr(10) || ' it ' || doc_id || ' now'  AS abstract, '' AS odd, '' AS results FROM documents")
def _(spark, sf):
    sections = F.create_map(F.lit("abstract"), F.concat(F.lit("see https://a.b/c\n12\n \\emph{it}\n "), _n(), F.lit(" now")), F.lit("odd"), F.lit(None).cast("string"), F.lit("results"), F.lit(" \n 3 \n"))
    made = documents.clean_sections(table(spark, sf, "documents").select("doc_id", sections.alias("sections")))
    return made.select("doc_id", *[F.col(f"sections.{name}").alias(name) for name in ("abstract", "odd", "results")])


@query("p15_metadata", rf"""
SELECT doc_id, {squeeze_sql("'  A  title ' || source || ' '")} AS title, CASE WHEN doc_id % 5 < 4 THEN (1990 + doc_id % 35)::INT END AS year,
  CASE doc_id % 4 WHEN 0 THEN 'given' WHEN 1 THEN '10.1234/j' || doc_id WHEN 2 THEN '10.1234/c' || doc_id ELSE '10.1234/s' || doc_id END AS doi FROM documents""")
def _(spark, sf):
    d, kind = _n(), F.col("doc_id") % 4
    p = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("  A  title "), "source", F.lit(" ")).alias("title"), F.concat(F.lit("see doi:10.1234/s"), d, F.lit(". end")).alias("summary"),
        F.when(F.col("doc_id") % 5 < 4, F.concat((F.col("doc_id") % 35 + 1990).cast("string"), F.lit("-05-01T00:00:00Z"))).otherwise(F.lit("May 2001")).alias("published"),
        F.when(kind == 0, F.lit("given")).alias("doi"), F.when(kind == 1, F.concat(F.lit("Nature 10.1234/j"), d, F.lit(";"))).alias("journal_ref"), F.when(kind == 2, F.concat(F.lit("at 10.1234/c"), d, F.lit(")."))).alias("comment"),
    )
    return corpus.metadata(p).select("doc_id", "title", "year", "doi")


def _items(spark, sf) -> DataFrame:
    n, kind = _n(), F.col("doc_id") % 3
    alpha = F.concat(F.lit('{"arxivId":"","url":"https://arxiv.org/abs/2101.'), F.lpad((F.col("doc_id") % 100000).cast("string"), 5, "0"), F.lit('v3","name":" A  name ","abstractPreview":"p","description":"d","tags":"cs.CL","author_names":"Ann Lee, Bo Ek and Cy","date":"2020"}'))
    fey = F.concat(F.lit('{"id":"f'), n, F.lit('","title":"","name":"F","openAccessPdf":{"url":"http://pdf/'), n, F.lit('"},"fieldsOfStudy":["x","y"],"authors":[{"name":" Ann "},{"id":1}],"DOI":"10.1/2","notes":"c","year":2019}'))
    none = F.concat(F.lit('{"entry_id":"http://e/'), n, F.lit('/","summary":" s  t ","authors":["A",""]}'))
    return table(spark, sf, "documents").select("doc_id", F.when(kind == 0, alpha).when(kind == 1, fey).otherwise(none).alias("item"))


@query("p16_provider_records", """
WITH a AS (SELECT doc_id, '2101.' || lpad((doc_id % 100000)::VARCHAR, 5, '0') AS id FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id, id AS paper_id, 'A name' AS title, ['Ann Lee', 'Bo Ek', 'Cy'] AS authors, 'p' AS summary, '2020' AS published, 'cs.CL' AS primary_category, 'https://arxiv.org/pdf/' || id || '.pdf' AS pdf_url, NULL AS doi FROM a
UNION ALL SELECT doc_id, 'f' || doc_id, 'F', ['Ann'], '', '2019', 'x', 'http://pdf/' || doc_id, '10.1/2' FROM documents WHERE doc_id % 3 = 1
UNION ALL SELECT doc_id, doc_id::VARCHAR, 'Untitled paper', ['A'], 's t', NULL, 'unknown', NULL, NULL FROM documents WHERE doc_id % 3 = 2""")
def _(spark, sf):
    items = _items(spark, sf)
    made = [discovery.normalised(items.where(f"doc_id % 3 = {k}"), name) for k, name in enumerate(("alphaxiv", "feyman", "arxiv"))]
    rows = made[0].unionByName(made[1]).unionByName(made[2])
    return rows.select("doc_id", "paper_id", "title", "authors", "summary", "published", "primary_category", "pdf_url", "doi")


@query("p08_payload_results", """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'c' || doc_id WHEN 1 THEN 'm' || doc_id ELSE 'fb' || doc_id END AS chunk_id, CASE doc_id % 3 WHEN 0 THEN 't' ELSE '' END AS text, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'T' END AS title,
  CASE doc_id % 3 WHEN 0 THEN ['A', 'B'] WHEN 1 THEN ['Solo'] ELSE [] END AS authors, CASE doc_id % 3 WHEN 0 THEN 2019 END::INT AS year FROM documents""")
def _(spark, sf):
    n, kind = _n(), F.col("doc_id") % 3
    payload = (
        F.when(kind == 0, F.concat(F.lit('{"chunk_id":"c'), n, F.lit('","text":"t","title":"  ","year":"2019","authors":[" A ","","B"]}')))
        .when(kind == 1, F.concat(F.lit('{"chunk_id":"","metadata":{"chunk_id":"m'), n, F.lit('","title":" T ","year":"soon","authors":"Solo"}}'))).otherwise(F.lit('{"authors":""}'))
    )
    made = corpus.result_of_payload(payload, F.lit(1.0), "dense", F.concat(F.lit("fb"), n))
    return table(spark, sf, "documents").select("doc_id", made.alias("r")).select("doc_id", "r.chunk_id", "r.text", "r.title", "r.authors", "r.year")


@query("p23_abstentions", "SELECT conv_id, turn, turn % 3 = 0 OR conv_id % 4 = 0 AS abstains FROM conversations")
def _(spark, sf):
    status = F.when(F.col("turn") % 3 == 0, F.lit('{"answer_status":"Insufficient_Evidence"}')).when(F.col("turn") % 3 == 1, F.lit('{"answer_status":"answered"}'))
    return table(spark, sf, "conversations").select("conv_id", "turn", generation.abstains(status, F.col("conv_id") % 4).alias("abstains"))


# ---- discovery ----------------------------------------------------------------


def _payload(spark, sf) -> DataFrame:
    n = _n()
    inner = F.concat(F.lit('{\\"results\\":[{\\"title\\":\\"T'), n, F.lit('\\",\\"id\\":7},{\\"name\\":\\"same\\",\\"id\\":\\"arxiv:2101.00001v2\\"},{\\"x\\":1}]}'))
    kinds = F.array(
        F.concat(F.lit('{"data":"'), inner, F.lit('","text":"see 2101.00001 and 2202.'), F.lpad((F.col("doc_id") % 100000).cast("string"), 5, "0"), F.lit(' too"}')),
        F.concat(F.lit('{"papers":{"items":[{"title":"A'), n, F.lit('"},{"title":"A'), n, F.lit('","abstract":"b"}]},"content":[{"text":"```json\\n[{\\"pdf_url\\":\\"https://arxiv.org/pdf/1905.00001\\"}]\\n```"}]}')), F.lit("nothing at all"), F.lit('{"other":[{"title":"t","id":1}]}'),
    )
    return table(spark, sf, "documents").select("doc_id", F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int")).alias("payload"))


@query("s10_flattened_payloads", """
SELECT doc_id, unnest(CASE doc_id % 4 WHEN 0 THEN ['T' || doc_id, 'same', 'alphaXiv paper 2202.' || lpad((doc_id % 100000)::VARCHAR, 5, '0')] WHEN 1 THEN ['A' || doc_id, NULL] ELSE [] END) AS title, unnest(CASE doc_id % 4 WHEN 0 THEN [0, 1, 2] WHEN 1 THEN [0, 1] ELSE [] END)::INT AS pos FROM documents""")
def _(spark, sf):
    rows = _payload(spark, sf).select("doc_id", F.posexplode(discovery.flattened("payload")).alias("pos", "item"))
    return rows.select("doc_id", F.coalesce(F.get_json_object("item", "$.title"), F.get_json_object("item", "$.name")).alias("title"), "pos")


class _Catalog:
    """A provider of made-up papers; asked for one topic it has none, for another it is out of order."""

    def __init__(self, name: str) -> None:
        self.name = name

    def search(self, query: str, max_results: int = 50) -> list[dict]:
        if "broken" in query and self.name == "first":
            raise ConnectionError("out of order")
        return [{"paper_id": f"{self.name}-{i}", "title": f"{query} paper {i // 2}", "doi": f"10.1/{i // 3}" if i % 2 else None, "summary": "about " + query, "citation_count": i * 10} for i in range(max_results)]


@query("s08_fallback_source", """
WITH q AS (SELECT DISTINCT lang FROM documents) SELECT lang || ' topic' AS query, i::INT AS pos, 'first-' || i AS paper_id, 'alphaxiv-mcp' AS provider, NULL AS fallback_reason FROM q, range(0, 3) t(i)
UNION ALL SELECT lang || ' broken', i::INT, 'second-' || i, 'arxiv', 'out of order' FROM q, range(0, 3) t(i)""")
def _(spark, sf):
    discovery.register(spark, "catalog", discovery.WithFallback(_Catalog("first"), _Catalog("second")))
    langs = [r[0] for r in table(spark, sf, "documents").select("lang").distinct().collect()]  # a request's handful of queries
    wanted = [f"{x} {kind}" for x in langs for kind in ("topic", "broken")]
    raw = spark.read.format("catalog").option("query", json.dumps(wanted)).option("max_results", 3).load()
    at = lambda name: F.get_json_object("item", f"$.{name}")
    return raw.select("query", "pos", at("paper_id").alias("paper_id"), at("discovery_provider_used").alias("provider"), at("fallback_reason").alias("fallback_reason"))


@query("s09_selected_papers", """
WITH p AS (SELECT 'deep ' || lang AS query, i AS pos, 'first-' || i AS paper_id, 'deep ' || lang || ' paper ' || (i // 2) AS title, CASE WHEN i % 2 = 1 THEN '10.1/' || (i // 3) END AS doi, i * 10 AS cites FROM (SELECT DISTINCT lang FROM documents), range(0, 12) t(i)),
k AS (SELECT * FROM p WHERE pos IN (0, 2, 4, 6, 8, 10)), s AS (SELECT *, round(1.0::DOUBLE + least(cites, 500) / 5000.0::DOUBLE, 6) AS selection_score FROM k)
SELECT query, paper_id, selection_score, (row_number() OVER (PARTITION BY query ORDER BY selection_score DESC, pos))::INT AS rank FROM s QUALIFY rank <= 4""")
def _(spark, sf):
    discovery.register(spark, "overfetched", discovery.build_discovery("enriched", arxiv=_Catalog("first")))
    langs = [r[0] for r in table(spark, sf, "documents").select("lang").distinct().collect()]
    raw = spark.read.format("overfetched").option("query", json.dumps([f"deep {x}" for x in langs])).option("max_results", 4).load()
    papers = discovery.normalised(raw, "arxiv").withColumn("citation_count", F.get_json_object("item", "$.citation_count").cast("int"))
    asked_ = raw.select("query").distinct().withColumn("text", F.col("query"))
    return discovery.selected(papers, asked_, 4).select("query", "paper_id", "selection_score", "rank")


def _asked_of(column) -> F.Column:
    """Queries of all kinds: with phrases that are known, of a domain that has keywords of its own, of stop words, or as they are."""
    i = F.col("item_id") % 4
    return F.when(i == 0, F.concat(F.lit("Deep Learning for the early warning of "), column)).when(i == 1, F.concat(F.lit("earthquake papers on "), column)).when(i == 2, F.lit("the of and")).otherwise(F.col(column))


ASKED_OF_SQL = "b AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'Deep Learning for the early warning of ' || text WHEN 1 THEN 'earthquake papers on ' || text WHEN 2 THEN 'the of and' ELSE text END AS q FROM benchmark), w AS (SELECT item_id, q, regexp_extract_all(lower(q), '[a-z0-9]+') AS w FROM b)"


def _keywords_sql(whole: bool) -> str:
    first = f"CASE WHEN len(string_split({squeeze_sql('q')}, ' ')) <= 8 THEN trim(q) END, " if whole else ""
    listed = (
        f"list_concat(list_filter([{first}CASE WHEN contains(lower(q), 'deep learning') THEN 'deep learning' END, CASE WHEN contains(lower(q), 'early warning') THEN 'early warning' END, CASE WHEN contains(lower(q), 'earthquake') THEN 'seismic' END], lambda x: x IS NOT NULL), "
        f"list_filter(w, lambda x: x NOT IN ({', '.join(f"'{s}'" for s in discovery.KEYWORD_STOPS)})))"
    )
    return f"list_slice(CASE WHEN len({listed}) > 0 THEN list_filter({listed}, lambda x, i: list_position({listed}, x) = i) ELSE w END, 1, 4)"


@query("u10_argument_sets", f"""
WITH {ASKED_OF_SQL}, k AS (SELECT item_id, q, {_keywords_sql(False)} AS own, {_keywords_sql(True)} AS whole FROM w),
s AS (SELECT item_id, list_concat(CASE WHEN item_id % 3 = 0 THEN [{{'k': ['planned'], 'd': 5}}] ELSE [] END, [{{'k': own, 'd': 5}}], CASE WHEN regexp_matches(lower(q), 'earthquake|seismic|seismology') THEN [{{'k': ['earthquake detection', 'seismic', 'deep learning', 'phase picking'], 'd': 7}}] ELSE [] END, [{{'k': whole, 'd': 7}}]) AS sets FROM k)
SELECT item_id, list_transform(sets, lambda x: array_to_string(x.k, '|')) AS keywords, list_transform(sets, lambda x: x.d)::INT[] AS difficulties FROM s""")
def _(spark, sf):
    idea = F.array(F.struct(F.array(F.lit("planned")).alias("keywords"), F.lit("What of it?").alias("question"), F.lit(5).alias("difficulty")))
    plans = F.when(F.col("item_id") % 3 == 0, F.concat(idea, idea, idea))
    sets = table(spark, sf, "benchmark").select("item_id", discovery.argument_sets(_asked_of("text"), 5, plans).alias("sets"))
    return sets.select("item_id", F.transform("sets", lambda s: F.array_join(s["keywords"], "|")).alias("keywords"), F.col("sets.difficulty").alias("difficulties"))


@query("f31_keywords", f"WITH {ASKED_OF_SQL} SELECT item_id, {_keywords_sql(True)} AS keywords FROM w")
def _(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", corpus.keywords(_asked_of("text"), discovery.KNOWN_PHRASES, discovery.KEYWORD_STOPS, whole=True).alias("keywords"))


@query("s04_download_urls", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'u' || doc_id WHEN 1 THEN 'http://a/pdf/' || doc_id || '.pdf' WHEN 2 THEN 'http://a/pdf/x.pdf' ELSE 'https://arxiv.org/pdf/' || doc_id || '.pdf' END AS url FROM documents")
def _(spark, sf):
    n, kind = _n(), F.col("doc_id") % 4
    entry = F.when(kind == 1, F.concat(F.lit("http://a/abs/"), n)).when(kind == 2, F.lit("http://a/abs/x.pdf"))
    return table(spark, sf, "documents").select("doc_id", discovery.pdf_url(n, entry, F.when(kind == 0, F.concat(F.lit("u"), n))).alias("url"))


@query("s04_downloads", "SELECT 'p' || n_nationkey AS paper_id, n_nationkey % 5 NOT IN (2, 3) AS downloaded, CASE n_nationkey % 5 WHEN 2 THEN 404 WHEN 3 THEN 200 ELSE 200 END::INT AS status, CASE n_nationkey % 5 WHEN 2 THEN 'download failed with HTTP 404' WHEN 3 THEN 'not a valid PDF' END AS error FROM nation")
def _(spark, sf):
    def get(url: str) -> tuple[int, bytes, dict]:
        kind, tries = int(url.split("/")[1]) % 5, _TRIES.get(url, 0)
        _TRIES[url] = tries + 1
        if kind == 2:
            return 404, b"", {}
        if kind == 1 and tries == 0:
            return 503, b"", {"retry-after": "0"}
        if kind == 4 and tries == 0:
            raise ConnectionError("lost")
        return 200, b"broken" if kind == 3 else b"%PDF-1.7 whole", {}

    papers = table(spark, sf, "nation").select(F.concat(F.lit("p"), F.col("n_nationkey")).alias("paper_id"), F.concat(F.lit("x"), F.col("n_nationkey")).alias("canonical_id"), F.concat(F.lit("u/"), F.col("n_nationkey")).alias("url"))
    return discovery.download(papers, _scratch(spark), get, backoff=0.0).select("paper_id", "downloaded", "status", "error")


_TRIES: dict[str, int] = {}


# ---- runs ---------------------------------------------------------------------


def _paper_pages(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Papers in versions, and pages of them: some do not parse, some have none."""
    d = table(spark, sf, "documents")
    papers = d.select(F.concat(F.lit("P"), _n(), F.lit("v"), (F.col("doc_id") % 3 + 1).cast("string")).alias("paper_id"), "source", F.concat(F.lit(" Title  of "), _n()).alias("title"), F.lit("2020-01-01").alias("published"), F.col("doc_id").alias("pos"))
    older = papers.where("pos % 4 = 0").withColumn("paper_id", F.regexp_replace("paper_id", r"v\d+$", "v1"))
    papers = papers.unionByName(older.withColumn("pos", F.col("pos") + 10**12))
    body = F.concat(F.lit("Great Paper\nAbstract\nWe show "), _n(), F.lit(" things.\n1. Introduction\nIt begins.\nMore text here.\n"))
    tail = F.concat(F.lit("2. Results\nGood ones.\nReferences\n[1] Smith, A. Deep things here. 2019. doi:10.1234/"), _n(), F.lit(".\n[2] Other. Work of note again. 2020.\n"))
    good = d.where("doc_id % 7 < 5").select(F.concat(F.lit("P"), _n()).alias("canonical_id"), F.posexplode(F.array(body, tail)).alias("page_number", "text"), F.lit(None).cast("string").alias("error"))
    bad = d.where("doc_id % 7 = 5").select(F.concat(F.lit("P"), _n()).alias("canonical_id"), F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("string").alias("text"), F.lit("ValueError: broken").alias("error"))
    return papers, good.unionByName(bad)


def _ingested(spark, sf) -> ingestion.Ingested:
    papers, pages = _paper_pages(spark, sf)
    registry = table(spark, sf, "documents").where("doc_id % 10 = 9").select(F.concat(F.lit("P"), _n()).alias("canonical_id"), F.when(F.col("doc_id") % 20 == 9, "indexed").otherwise("failed").alias("status"))
    lost = papers.where("pos % 11 = 3 AND pos < 1000000000000").select("paper_id", F.lit("HTTP 500").alias("error"))
    return ingestion.ingest(papers, pages, registry, lost)


OUTCOME_SQL = """o AS (SELECT doc_id, 'P' || doc_id AS canonical_id, 'P' || doc_id || 'v' || (doc_id % 3 + 1) AS paper_id, CASE WHEN doc_id % 20 = 9 THEN 'skipped' WHEN doc_id % 11 = 3 OR doc_id % 7 >= 5 THEN 'failed' ELSE 'processed' END AS status,
  CASE WHEN doc_id % 20 = 9 THEN NULL WHEN doc_id % 11 = 3 THEN 'download' WHEN doc_id % 7 >= 5 THEN 'process' END AS stage, CASE WHEN doc_id % 20 = 9 THEN NULL WHEN doc_id % 11 = 3 THEN 'HTTP 500' WHEN doc_id % 7 = 5 THEN 'ValueError: broken' WHEN doc_id % 7 = 6 THEN 'no pages' END AS error FROM documents)"""


@query("x03_ingestion_outcomes", f"WITH {OUTCOME_SQL} SELECT canonical_id, paper_id, status, stage, error FROM o")
def _(spark, sf):
    return _ingested(spark, sf).outcomes.select("canonical_id", "paper_id", "status", "stage", "error")


@query("x03_ingestion_summary", f"WITH {OUTCOME_SQL} SELECT count(*) AS discovered, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'processed') AS processed, count(*) FILTER (status = 'failed') AS failed FROM o")
def _(spark, sf):
    return _ingested(spark, sf).summary()


@query("x03_processed_documents", f"""
WITH {OUTCOME_SQL} SELECT canonical_id, paper_id, 'Title of ' || doc_id AS title, 2020::INT AS year, 2::INT AS n_pages, ['abstract', 'front_matter', 'introduction', 'references', 'results'] AS sections, 'We show ' || doc_id || ' things.' AS abstract, 'It begins.' || chr(10) || 'More text here.' AS introduction,
  4::INT AS n_headings, ['10.1234/' || doc_id, NULL] AS dois, [2019, 2020]::INT[] AS years FROM o WHERE status = 'processed'""")
def _(spark, sf):
    docs = _ingested(spark, sf).documents
    return docs.select(
        "canonical_id", "paper_id", "metadata.title", "metadata.year", F.size("pages").alias("n_pages"), F.array_sort(F.map_keys("sections")).alias("sections"), F.col("sections.abstract").alias("abstract"), F.col("sections.introduction").alias("introduction"),
        F.size("section_details").alias("n_headings"), F.transform("citations", lambda c: c["doi"]).alias("dois"), F.transform("citations", lambda c: c["year"]).alias("years"),
    )


@query("s12_written_documents", f"WITH {OUTCOME_SQL} SELECT canonical_id, CASE WHEN doc_id % 2 = 0 THEN 'again' ELSE paper_id END AS paper_id, 'We show ' || doc_id || ' things.' AS abstract FROM o WHERE status = 'processed'")
def _(spark, sf):
    path = _scratch(spark)
    docs = _ingested(spark, sf).documents.select("canonical_id", "paper_id", "sections")
    ingestion.write_documents(docs, path)
    ingestion.write_documents(docs.where(F.regexp_extract("canonical_id", r"\d+", 0).cast("int") % 2 == 0).withColumn("paper_id", F.lit("again")), path)
    return ingestion.read_documents(spark, path, "paper_id string, sections map<string,string>").select("canonical_id", "paper_id", F.col("sections.abstract").alias("abstract"))


def _index(spark, sf) -> ingestion.Index:
    docs = _ingested(spark, sf).documents
    papers = docs.select("paper_id", F.create_map(F.lit("title"), F.col("metadata.title"), F.lit("published"), F.col("metadata.published")).alias("metadata"))
    return ingestion.process(docs, papers)


@query("x04_index", f"""
WITH {OUTCOME_SQL}, s AS (SELECT paper_id, unnest(['front_matter', 'abstract', 'introduction', 'results', 'references']) AS section, unnest(['other', 'front', 'context', 'evidence', 'back']) AS f, unnest([11, 11 + length('We show ' || doc_id || ' things.') - 11, 25, 10, 0]) AS n, doc_id FROM o WHERE status = 'processed')
SELECT paper_id, section, CASE WHEN section = 'front_matter' THEN 'front' ELSE f END AS section_family, 2020::INT AS year, 'Title of ' || doc_id AS title FROM s""")
def _(spark, sf):
    chunks = _index(spark, sf).chunks
    return chunks.select("paper_id", "section", "section_family", "year", F.try_element_at("metadata", F.lit("title")).alias("title"))


@query("a28_index_counts", f"WITH {OUTCOME_SQL} SELECT (5 * count(*))::BIGINT AS chunks, (5 * count(*))::BIGINT AS bm25_documents, (5 * count(*))::BIGINT AS vectors FROM o WHERE status = 'processed'")
def _(spark, sf):
    return spark.createDataFrame([_index(spark, sf).counts()], "chunks long, bm25_documents long, vectors long")


@query("st03_checkpoint", "SELECT DISTINCT 'P' || n_nationkey AS paper_id, n_nationkey AS pos FROM nation WHERE n_nationkey % 2 = 1")
def _(spark, sf):
    path = _scratch(spark)
    papers = table(spark, sf, "nation").select(F.concat(F.lit("P"), F.col("n_nationkey")).alias("paper_id"), F.col("n_nationkey").cast("long").alias("pos"))
    ingestion.run_checkpoint(papers, path, "arxiv", "Deep  Learning", 10)
    key = ingestion.run_checkpoint(papers.where("pos % 2 = 1"), path, "arxiv", " deep learning", 10)
    ingestion.run_checkpoint(papers, path, "arxiv", "other", 10)
    return ingestion.load_checkpoint(spark, path, key, "pos: bigint, paper_id: string").select("paper_id", "pos")


# ---- stores -------------------------------------------------------------------


@query("s14_exported_array", "SELECT '[' || string_agg('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"}', ',' ORDER BY doc_id) || ']' AS json FROM documents WHERE doc_id % 3 > 0")
def _(spark, sf):
    path = _scratch(spark)
    rows = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.to_json(F.struct("doc_id", "lang"))).alias("record"))
    stores.export_json(rows, path, "doc_id", "record")
    return spark.read.text(path, wholetext=True).select(F.replace("value", F.lit("\n"), F.lit("")).alias("json")).where("json <> ''")


@query("s16_upserted_vectors", "SELECT 'c' || vec_id AS chunk_id, CASE WHEN vec_id % 3 = 0 THEN 3 WHEN vec_id % 2 = 0 THEN 2 ELSE 1 END::DOUBLE AS first, 3::INT AS dim FROM embeddings")
def _(spark, sf):
    path = _scratch(spark)
    v = table(spark, sf, "embeddings").select(F.concat(F.lit("c"), F.col("vec_id")).alias("chunk_id"), "vec_id")
    make = lambda x, rows: rows.select("chunk_id", F.array(F.lit(x), F.lit(0.5), F.lit(0.25)).alias("embedding"))
    stores.upsert_vectors(spark, path, make(0.0, v), batch=9)
    stores.upsert_vectors(spark, path, make(1.0, v), batch=10)
    stores.upsert_vectors(spark, path, make(2.0, v.where("vec_id % 2 = 0")))
    out = stores.upsert_vectors(spark, path, make(3.0, v.where("vec_id % 3 = 0")))
    return out.select("chunk_id", F.element_at("embedding", 1).alias("first"), F.size("embedding").alias("dim"))


@query("s17_collections", "SELECT false AS before, true AS stored, true AS deleted, false AS after, false AS again")
def _(spark, sf):
    path = f"{_scratch(spark)}/c"
    before = stores.exists(spark, path)
    stores.upsert(table(spark, sf, "nation").select("n_nationkey", "n_name"), path, "n_nationkey")
    row = (before, stores.exists(spark, path), stores.delete(spark, path), stores.exists(spark, path), stores.delete(spark, path))
    return spark.createDataFrame([row], "before boolean, stored boolean, deleted boolean, after boolean, again boolean")


@query("s20_appended_log", "SELECT user_id, count(*) AS n, max(event_id) AS last FROM events GROUP BY user_id")
def _(spark, sf):
    path = _scratch(spark)
    log = table(spark, sf, "events").select("user_id", "event_id")
    for part in range(2):
        stores.append_log(log.where(f"event_id % 2 = {part}"), path)
    return spark.read.schema("user_id long, event_id long").json(path).groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query("s21_saved_rankings", """
SELECT 'hybrid' AS config, 'q' || item_id AS query_id, r::INT AS rank, '{"chunk_id":"c' || (item_id + r) || '"}' AS result FROM benchmark, range(1, 4) t(r) UNION ALL SELECT 'sparse', 'q' || item_id, r::INT, '{"chunk_id":"s' || r || '"}' FROM benchmark, range(1, 3) t(r)
UNION ALL SELECT NULL, NULL, r::INT, '{"chunk_id":"x' || r || '"}' FROM range(1, 3) t(r)""")
def _(spark, sf):
    path = _scratch(spark)
    b = table(spark, sf, "benchmark").orderBy("item_id")
    listed = lambda c, n: F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), c), ","), F.lit("]"))
    hybrid = F.concat(F.lit('"q'), F.col("item_id"), F.lit('":'), listed(lambda r: F.concat(F.lit('{"chunk_id":"c'), F.col("item_id") + r, F.lit('"}')), 3))
    sparse = F.concat(F.lit('{"query_id":"q'), F.col("item_id"), F.lit('","results":'), listed(lambda r: F.concat(F.lit('{"chunk_id":"s'), r, F.lit('"}')), 2), F.lit("}"))
    whole = b.agg(F.concat(F.lit('{"rankings":{"hybrid":{'), F.array_join(F.collect_list(hybrid), ","), F.lit('},"sparse":['), F.array_join(F.collect_list(sparse), ","), F.lit("]}}")).alias("value"))
    whole.coalesce(1).write.text(f"{path}/runs")
    spark.createDataFrame([('{"results":[{"chunk_id":"x1"},{"chunk_id":"x2"}]}',)], "value string").coalesce(1).write.text(f"{path}/one")
    return stores.read_rankings(spark, f"{path}/runs").unionByName(stores.read_rankings(spark, f"{path}/one"))


@query("s23_rendered_prompts", "SELECT conv_id, turn, 'Q' || conv_id || ': turn ' || turn || ' of {x} Q' || conv_id || '.' AS prompt FROM conversations")
def _(spark, sf):
    made = stores.rendered("{{ name }}: turn {{turn}} of {x} {{name}}.", name=F.concat(F.lit("Q"), F.col("conv_id")), turn=F.col("turn"))
    return table(spark, sf, "conversations").select("conv_id", "turn", made.alias("prompt"))


# ---- benchmarks -----------------------------------------------------------------


def _records(spark, sf) -> dict[str, DataFrame]:
    """Records of three benchmarks, made of rows of documents."""
    n = _n()
    d = table(spark, sf, "documents")
    qasa = F.concat(F.lit('{"question_id":'), n, F.lit(',"arxiv_id":"https://x/abs/19'), n, F.lit('v2","question":" Why  so? ","composition":"'), F.when(F.col("doc_id") % 5 == 0, "").otherwise("Because."), F.lit('","evidential_info":[{"context":"e  1"},{"x":2},{"context":""}]}'))
    answers = F.array(
        F.lit('{"answer":[{"unanswerable":true}]}'), F.lit('[{"answer":{"unanswerable":false,"extractive_spans":["a","","b"],"evidence":["p","p"]}}]'), F.lit('{"yes_no":false,"highlighted_evidence":[],"evidence":"one"}'),
        F.lit('[[{"extractive_spans":[],"yes_no":null,"free_form_answer":" free  text "}]]'), F.lit("[]"),
    )
    ann = F.element_at(answers, (F.col("doc_id") % 5 + 1).cast("int"))
    side = F.concat(F.lit('{"id":"D'), n, F.lit('v1","title":"T","qas":{"question":["How?","Q2"],"question_id":["a'), n, F.lit('"],"answers":['), ann, F.lit("]}}"))
    listed = F.concat(F.lit('{"paper_id":"d'), n, F.lit('","qas":[{"question":"How?","question_id":"a'), n, F.lit('","answers":'), ann, F.lit("}]}"))
    sci = F.concat(F.lit('{"qid":"s'), n, F.lit('","que":"Is the plot good?","ans":"A: yes '), n, F.lit('","evidence_text":['), F.when(F.col("doc_id") % 2 == 0, F.lit('"found"')).otherwise(F.lit("")), F.lit('],"pid":"P'), n, F.lit('"}'))
    return {"qasa": d.select(qasa.alias("row")), "qasper": d.select(F.when(F.col("doc_id") % 2 == 0, side).otherwise(listed).alias("row")), "scidqa": d.select(sci.alias("row"))}


@query("f40_normalised_examples", """
WITH d AS (SELECT doc_id FROM documents)
SELECT 'qasa' AS source_dataset, '19' || doc_id || '-' || doc_id AS source_id, 'Why so?' AS question, 'Because.' AS reference_answer, ['e 1'] AS evidence, '19' || doc_id AS paper_id, NULL AS answer_type FROM d WHERE doc_id % 5 > 0
UNION ALL SELECT 'qasper', 'a' || doc_id, 'How?', ['The question is unanswerable from the paper.', 'a b', 'No.', 'free text'][doc_id % 5 + 1], CASE doc_id % 5 WHEN 1 THEN ['p'] WHEN 2 THEN ['one'] ELSE []::VARCHAR[] END, 'd' || doc_id, ['unanswerable', 'extractive', 'yes_no', 'free_form'][doc_id % 5 + 1] FROM d WHERE doc_id % 5 < 4
UNION ALL SELECT 'scidqa', 's' || doc_id, 'Is the plot good?', 'yes ' || doc_id, CASE WHEN doc_id % 2 = 0 THEN ['found'] ELSE []::VARCHAR[] END, 'p' || doc_id, NULL FROM d""")
def _(spark, sf):
    r = _records(spark, sf)
    rows = benchmarks.from_qasa(r["qasa"]).unionByName(benchmarks.from_qasper(r["qasper"])).unionByName(benchmarks.from_scidqa(r["scidqa"]))
    return rows.drop("title", "metadata")


@query("f40_skip_reasons", "SELECT 's' || doc_id AS source_id, CASE WHEN doc_id % 2 = 1 THEN 'missing_evidence' ELSE 'multimodal' END AS reason FROM documents")
def _(spark, sf):
    return benchmarks.from_scidqa(_records(spark, sf)["scidqa"]).select("source_id", benchmarks.skip_reason().alias("reason"))


@query("f45_title_overlap", f"""
WITH t AS (SELECT item_id, list_distinct(regexp_extract_all({fold_sql('text')}, '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all({fold_sql("left(text, 60) || ' more'")}, '[a-z0-9]+')) AS b FROM benchmark) SELECT item_id, round({overlap_sql('b', 'a')}, 6) AS share, {overlap_sql('b', 'a')} >= 0.8 AS same FROM t""")
def _(spark, sf):
    share = benchmarks.title_overlap(F.concat(F.substring("text", 1, 60), F.lit(" more")), F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", F.round(share, 6).alias("share"), (share >= benchmarks.TITLE_SHARE).alias("same"))


def _evidence(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Chunks of 300 characters, and examples whose evidence is cut from a chunk, from over a border, or from nowhere."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL")
    windows = documents.fixed_windows(docs, stride=300, size=300)
    chunks = windows.join(docs.select("doc_id", "source"), "doc_id").select(
        F.concat_ws("-", "doc_id", "ord").alias("chunk_id"), F.concat(F.lit("P"), "doc_id").alias("paper_id"), F.concat(F.lit("The  Paper "), "doc_id").alias("title"), F.when(F.col("ord") % 2 == 0, "a").otherwise("a").alias("section"), "start_char", "end_char", "text",
    )
    kind = F.col("doc_id") % 5
    inside, border = F.substring("text", 11, 200), F.substring("text", 151, 300)
    evidence = F.when(kind == 0, F.array(inside)).when(kind == 1, F.array(border, inside)).when(kind == 2, F.array(inside, F.lit("zyxw vuts nothing known"))).when(kind == 3, F.array().cast("array<string>")).otherwise(F.array(inside))
    examples = docs.select(
        F.lit("t").alias("source_dataset"), _n().alias("source_id"), F.lit("Q").alias("question"), F.lit("A").alias("reference_answer"), evidence.alias("evidence"),
        F.when(kind == 4, F.concat(F.lit("gone"), _n())).otherwise(F.concat(F.lit("x/p"), _n(), F.lit("V2"))).alias("paper_id"), F.when((kind == 4) & (F.col("doc_id") % 2 == 0), F.concat(F.lit("the paper, "), _n())).otherwise(F.lit("")).alias("title"),
    )
    return examples, chunks


EVIDENCE_SQL = f"""d AS (SELECT doc_id, text, doc_id % 5 AS k FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, i::INT AS ord, substr(text, i * 300 + 1, 300) AS t FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 299) // 300)) AS i FROM d)),
ev AS (SELECT doc_id, k, 0 AS pos, CASE WHEN k = 1 THEN substr(text, 151, 300) ELSE substr(text, 11, 200) END AS p FROM d WHERE k <> 3 UNION ALL SELECT doc_id, k, 1, CASE WHEN k = 1 THEN substr(text, 11, 200) ELSE 'zyxw vuts nothing known' END FROM d WHERE k IN (1, 2)),
pr AS (SELECT ev.doc_id, k, pos, ord, doc_id_ok, {content_sql('p')} AS pt, {content_sql('t')} AS ct FROM ev JOIN (SELECT *, true AS doc_id_ok FROM c) c USING (doc_id) WHERE (k <> 4 OR ev.doc_id % 2 = 0) AND length(trim(t)) > 0),
sc AS (SELECT *, {overlap_sql('pt', 'ct')} AS s FROM pr), bs AS (SELECT *, max(s) OVER w AS best, first(ord) OVER (PARTITION BY doc_id, pos ORDER BY s DESC, doc_id || '-' || ord) AS bo FROM sc WINDOW w AS (PARTITION BY doc_id, pos)),
nr AS (SELECT *, abs(ord - bo) <= 1 AS beside FROM bs WHERE best - s <= 0.05::DOUBLE),
g AS (SELECT doc_id, pos, any_value(best) AS best, bool_or(NOT beside) AS far, any_value(pt) AS pt, list_distinct(flatten(list(ct) FILTER (beside))) AS has, any_value(doc_id || '-' || bo) AS bid, list(doc_id || '-' || ord ORDER BY s DESC, doc_id || '-' || ord) FILTER (beside AND ord <> bo) AS more FROM nr GROUP BY doc_id, pos),
o AS (SELECT *, CASE WHEN best < 0.55 THEN 'below_threshold' WHEN far THEN 'ambiguous' WHEN {overlap_sql('pt', 'has')} < 0.55 THEN 'below_threshold' END AS reason FROM g),
f AS (SELECT doc_id, min(pos) FILTER (reason IS NOT NULL) AS stop, min_by(reason, pos) FILTER (reason IS NOT NULL) AS reason FROM o GROUP BY doc_id),
a AS (SELECT o.doc_id, flatten(list(list_concat([bid], coalesce(more, [])) ORDER BY pos) FILTER (stop IS NULL OR pos < stop)) AS ids FROM o JOIN f USING (doc_id) GROUP BY o.doc_id),
al AS (SELECT d.doc_id, CASE WHEN k = 4 AND d.doc_id % 2 = 1 OR length(trim(text)) = 0 THEN 'no_chunks' WHEN k = 3 THEN 'missing_evidence' ELSE f.reason END AS why, coalesce(list_filter(ids, lambda x, i: list_position(ids, x) = i), []) AS ids FROM d LEFT JOIN f USING (doc_id) LEFT JOIN a USING (doc_id))"""


@query("j10_evidence_alignment", f"WITH {EVIDENCE_SQL} SELECT doc_id::VARCHAR AS source_id, ids AS chunk_ids, why IS NULL AS reviewed, why AS reason FROM al")
def _(spark, sf):
    examples, chunks = _evidence(spark, sf)
    return benchmarks.align(benchmarks.papers_of(examples, chunks), chunks).drop("best_scores")


@query("x13_benchmark_tier", f"""WITH {EVIDENCE_SQL} SELECT 't-' || doc_id AS id, 'Q' AS question, ids AS reference_context_ids, why IS NULL AS reviewed, CASE WHEN why = 'no_chunks' AND doc_id % 3 = 0 THEN 'ingestion_failure' ELSE why END AS reason, 't' AS source_dataset FROM al""")
def _(spark, sf):
    examples, chunks = _evidence(spark, sf)
    failures = examples.where(F.col("source_id").cast("int") % 3 == 0).select("source_dataset", "source_id")
    return benchmarks.tier(examples, chunks, failures).drop("reference_answer")


@query("x13_tier_report", f"""WITH {EVIDENCE_SQL} SELECT 't' AS source_dataset, count(*) AS available, count(*) FILTER (why IS NULL) AS aligned, round(count(*) FILTER (why IS NULL) / count(*)::DOUBLE, 6) AS alignment_rate FROM al""")
def _(spark, sf):
    examples, chunks = _evidence(spark, sf)
    return reports.tier_report(benchmarks.tier(examples, chunks), "source_dataset", "reason").drop("skipped")


@query("x14_coverage_audit", f"""
WITH d AS (SELECT doc_id, text, doc_id % 4 AS k FROM documents WHERE text IS NOT NULL AND length(text) > 400), c AS (SELECT doc_id, i::INT AS ord, substr(text, i * 300 + 1, 300) AS t FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 299) // 300)) AS i FROM d)),
e AS (SELECT doc_id, k, CASE k WHEN 0 THEN substr(text, 11, 200) WHEN 1 THEN 'unheard words ' || doc_id WHEN 2 THEN 'see Table 3 unheard' ELSE 'unheard words ' || doc_id END AS p FROM d), pt AS (SELECT doc_id AS q, k, {content_sql('p')} AS pt FROM e), ct AS (SELECT doc_id, ord, {content_sql('t')} AS ct FROM c),
pw AS (SELECT q, len(pt) AS n, unnest(pt) AS w FROM pt), cw AS (SELECT doc_id, ord, unnest(ct) AS w FROM ct), sh AS (SELECT q, doc_id, ord, count(*) / any_value(n)::DOUBLE AS share FROM pw JOIN cw USING (w) GROUP BY ALL),
b AS (SELECT q, coalesce(max(share), 0) AS best FROM (SELECT DISTINCT doc_id AS q FROM d) LEFT JOIN sh USING (q) GROUP BY q)
SELECT 'q' || e.doc_id AS question_id, CASE k WHEN 0 THEN '(b) Evidence present, not retrieved' ELSE '(a) Evidence absent' END AS bucket, round(best, 6) AS best_overlap, k = 0 AS exact_substring,
  CASE k WHEN 0 THEN 'Reviewed evidence is indexed in a; this is a top-4 ranking miss.' WHEN 1 THEN 'Source paper has no chunks in the benchmark BM25 index.' WHEN 2 THEN 'Source paper is indexed, but labeled evidence appears table/figure-related and is absent.'
    ELSE 'Source paper is indexed, but no chunk reaches the evidence-overlap threshold' || CASE WHEN best > 0 THEN '; nearest text is in a.' ELSE '.' END END AS cause FROM e JOIN b ON q = doc_id""")
def _(spark, sf):
    docs = lexical.spread(table(spark, sf, "documents")).where("text IS NOT NULL AND length(text) > 400")
    chunks = documents.fixed_windows(docs, stride=300, size=300).select(F.concat_ws("-", "doc_id", "ord").alias("chunk_id"), F.concat(F.lit("P"), "doc_id").alias("paper_id"), F.lit("a").alias("section"), "text")
    k = F.col("doc_id") % 4
    said = F.when(k == 0, F.substring("text", 11, 200)).when(k == 2, F.lit("see Table 3 unheard")).otherwise(F.concat(F.lit("unheard words "), _n()))
    misses = docs.select(F.concat(F.lit("q"), _n()).alias("question_id"), F.when(k == 1, F.lit("other")).otherwise(F.concat(F.lit("P"), _n())).alias("paper_id"), F.array(said).alias("evidence"), F.when(k == 0, F.array(F.concat(_n(), F.lit("-0")))).otherwise(F.array().cast("array<string>")).alias("gold_ids"))
    return benchmarks.audit(misses, chunks).select("question_id", "bucket", "best_overlap", "exact_substring", "cause")


@query("u07_tiers", "SELECT 'i' || item_id AS id, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS tier FROM benchmark")
def _(spark, sf):
    b = table(spark, sf, "benchmark").select(F.concat(F.lit("i"), F.col("item_id")).alias("id"), "item_id")
    return benchmarks.union_tiers({"even": b.where("item_id % 2 = 0"), "odd": b.where("item_id % 2 = 1")}).select("id", "tier")


# ---- other reports ----------------------------------------------------------------


@query("w08_paper_ranking", f"WITH {CHUNKS_SQL}, r AS (SELECT 'q' || item_id AS query_id, i AS rank, 'c' || ((item_id * 7 + i * 3) % 100) AS chunk_id FROM benchmark, range(1, 31) t(i)), p AS (SELECT query_id, paper_id, min(rank) AS f FROM r JOIN ch USING (chunk_id) GROUP BY ALL) SELECT query_id, paper_id, (row_number() OVER (PARTITION BY query_id ORDER BY f, paper_id))::INT AS rank FROM p")
def _(spark, sf):
    ranked = table(spark, sf, "benchmark").select("item_id", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("rank")).select(F.concat(F.lit("q"), F.col("item_id")).alias("query_id"), "rank", F.concat(F.lit("c"), (F.col("item_id") * 7 + F.col("rank") * 3) % 100).alias("chunk_id"))
    return ranking.collapse(ranked.join(chunk_corpus(spark, sf).chunks.select("chunk_id", "paper_id"), "chunk_id"))


@query("w10_context_pool", f"""
WITH {CHUNKS_SQL}, s AS (SELECT chunk_id, paper_id, CASE ord % 4 WHEN 0 THEN 'Abstract' WHEN 1 THEN 'results' WHEN 2 THEN 'other' ELSE NULL END AS sec, text FROM ch), q AS (SELECT item_id AS question_id, 'src' || (item_id % 5) AS paper, {tokens_sql('text')} AS qt FROM benchmark),
c AS (SELECT question_id, chunk_id, CASE lower(sec) WHEN 'abstract' THEN 0 WHEN 'results' THEN 2 ELSE 9 END AS place, len(list_intersect(list_distinct(qt), list_distinct({tokens_sql('text')}))) AS shared FROM q JOIN s ON paper_id = paper),
f AS (SELECT question_id, 'c' || (question_id * 3) AS chunk_id FROM q), u AS (SELECT question_id, chunk_id, 0 AS tier, 0 AS o FROM f UNION ALL SELECT c.question_id, c.chunk_id, 1, row_number() OVER (PARTITION BY c.question_id ORDER BY place, shared DESC, chunk_id) FROM c),
d AS (SELECT question_id, chunk_id, min(tier * 100000 + o) AS o FROM u GROUP BY ALL)
SELECT question_id, chunk_id, (row_number() OVER (PARTITION BY question_id ORDER BY o))::INT AS position FROM d QUALIFY position <= 6""")
def _(spark, sf):
    c = chunk_corpus(spark, sf).chunks
    section = F.element_at(F.array(F.lit("Abstract"), F.lit("results"), F.lit("other"), F.lit(None)), (F.col("ord") % 4 + 1).cast("int"))
    b = table(spark, sf, "benchmark")
    wanted = b.select(F.col("item_id").alias("question_id"), F.concat(F.lit("SRC"), F.col("item_id") % 5, F.lit("v3")).alias("paper_id"), "text")
    fixed = b.select(F.col("item_id").alias("question_id"), F.concat(F.lit("c"), F.col("item_id") * 3).alias("chunk_id"), F.lit(1).alias("pos"))
    return corpus.context_pool(wanted, fixed, c.withColumn("section", section), 6)


@query("a35_packing_modes", "SELECT ['gold', 'adjacent', 'section'][event_id % 3 + 1] AS mode, count(*) AS contexts, sum(event_id % 50)::BIGINT AS used, round(avg((event_id % 50) / 50.0::DOUBLE), 6) AS utilisation FROM events GROUP BY 1")
def _(spark, sf):
    mode = F.element_at(F.array(*map(F.lit, ("gold", "adjacent", "section"))), (F.col("event_id") % 3 + 1).cast("int"))
    return reports.packing_comparison(table(spark, sf, "events").select(mode.alias("mode"), (F.col("event_id") % 50).alias("used"), F.lit(50).alias("budget")))


@query("a36_profile", "SELECT (event_id % 3)::VARCHAR AS candidate_k, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg((event_id % 10) / 10.0::DOUBLE), 6) AS recall FROM events GROUP BY 1 UNION ALL SELECT 'overall', count(value), round(avg(value), 6), round(median(value), 6), round(quantile_cont(value, 0.95), 6), round(avg((event_id % 10) / 10.0::DOUBLE), 6) FROM events")
def _(spark, sf):
    rows = table(spark, sf, "events").withColumn("candidate_k", F.col("event_id") % 3).withColumn("recall", (F.col("event_id") % 10) / 10.0)
    return metrics.latency_profile(rows, "candidate_k", "value", means=("recall",))


@query("f43_spread", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def _(spark, sf):
    return metrics.spread(table(spark, sf, "events"), ["event_type"], "value")


@query("j16_duplicate_answers", "SELECT conv_id, 0::BIGINT AS a, 1000::BIGINT AS b FROM conversations WHERE turn = 0 AND text IS NOT NULL")
def _(spark, sf):
    first = table(spark, sf, "conversations").where("turn = 0 AND text IS NOT NULL").select("conv_id", "turn", "text")
    again = first.select("conv_id", (F.col("turn") + 1000).alias("turn"), F.concat(F.lit(" "), "text", F.lit("  ")).alias("text"))
    other = first.select("conv_id", (F.col("turn") + 2000).alias("turn"), F.lit("0 1 2 3 4 5 6 7 8 9").alias("text"))
    return documents.near_duplicates_within(first.unionByName(again).unionByName(other), "conv_id", "turn")


@query("f13_json_safe", """SELECT event_id, CASE WHEN value IS NULL OR event_id % 4 = 0 THEN '{"a":null,"b":[1.0,null],"c":"' || event_type || '"}' ELSE '{"a":' || (event_id % 7) || '.5,"b":[1.0,0.25],"c":"' || event_type || '"}' END AS value FROM events""")
def _(spark, sf):
    """Objects with numbers that JSON has no form for: they become null, as a column."""
    i = F.col("event_id")
    odd = F.col("value").isNull() | (i % 4 == 0)
    bad = F.element_at(F.array(F.lit(float("nan")), F.lit(float("inf")), F.lit(float("-inf"))), (i % 3 + 1).cast("int"))
    made = F.struct(F.when(odd, bad).otherwise(i % 7 + 0.5).alias("a"), F.array(F.lit(1.0), F.when(odd, F.lit(float("inf"))).otherwise(F.lit(0.25))).alias("b"), F.col("event_type").alias("c"))
    return table(spark, sf, "events").select("event_id", generation.safe_json(made, "a double, b array<double>, c string").alias("value"))


@query("f16_configuration", f"SELECT item_id, {squeeze_sql('text')} || ' rag and more more words' AS query, len({tokens_sql('text')})::INT AS n FROM benchmark")
def _(spark, sf):
    expansions = T.checked_expansions({" zzrag ": "never", "rag": [" more words "]})
    tokens = T.tokenizer_of({"tokenizer": "technical_terms_v2"})
    return table(spark, sf, "benchmark").select("item_id", T.expanded_query(F.concat("text", F.lit(" rag and more")), expansions).alias("query"), F.size(tokens("text")).alias("n"))


@query("st06_signatures", "SELECT count(*) AS n, count(DISTINCT (user_id, event_type)) AS runs, count(DISTINCT (user_id, event_type)) AS signatures FROM events")
def _(spark, sf):
    """A run's signature is the same for equal inputs, whatever their order, and no other's."""
    e = table(spark, sf, "events")
    made = e.select("user_id", "event_type", stores.signatures(user=F.col("user_id"), kind=F.col("event_type")).alias("one"), stores.signatures(kind=F.col("event_type"), user=F.col("user_id")).alias("two"))
    return made.agg(F.count_if(F.col("one") == F.col("two")).alias("n"), F.count_distinct("user_id", "event_type").alias("runs"), F.count_distinct("one").alias("signatures"))


@query("a20_strict_distribution", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def _(spark, sf):
    return state.shares(table(spark, sf, "documents"), "lang", dict.fromkeys(("en", "fr", "de", "es"), 0.25), 0.1, strict=True).select("lang", "n")


# ---- answers and judges -----------------------------------------------------------


class _Quoting:
    """A model that quotes its context; for some questions only when asked again, for some never."""

    def complete(self, system: str, user: str) -> str:
        number = int(user.split("#")[1].split()[0])
        again = "Previous answer" in user
        if number % 5 == 4:
            raise TimeoutError("too slow")
        if number % 5 == 3:
            return "I know it by heart."
        if number % 5 == 2 and not again:
            return "Surely so [9]."
        return f"As said for {number} [2]. And also [1][2]."


def _generated(spark, sf) -> DataFrame:
    c = chunk_corpus(spark, sf)
    ranked = asked(spark, sf).select("query_id", F.explode(F.array(F.lit("c1"), F.lit("c2"))).alias("chunk_id")).withColumn("rank", F.regexp_extract("chunk_id", r"\d", 0).cast("int"))
    number = F.regexp_extract("query_id", r"\d+", 0)
    wanted = asked(spark, sf).withColumn("text", F.concat(F.lit("#"), number, F.lit(" "), "text"))
    return generation.generate(wanted, ranked, c.chunks, _Quoting, "Be brief.", "{{ question }}\n\n{{ context }}", budget=100_000)


@query("x09_generation", """
WITH q AS (SELECT item_id AS i FROM benchmark) SELECT 'q' || i AS query_id, CASE i % 5 WHEN 4 THEN '' WHEN 3 THEN 'I know it by heart.' ELSE 'As said for ' || i || ' [2]. And also [1][2].' END AS answer, CASE WHEN i % 5 < 2 THEN 'original' ELSE 'repaired' END AS final_attempt,
  CASE i % 5 WHEN 4 THEN ['model_error:TimeoutError: too slow', 'missing_citation'] WHEN 3 THEN ['missing_citation'] ELSE [] END AS failures, CASE WHEN i % 5 > 2 THEN []::VARCHAR[] ELSE ['c2', 'c1'] END AS sources, ['c1', 'c2'] AS context_chunk_ids, i % 5 < 3 AS citations_valid FROM q""")
def _(spark, sf):
    rows = _generated(spark, sf)
    return rows.select("query_id", "answer", "final_attempt", "failures", F.transform("sources", lambda s: s["chunk_id"]).alias("sources"), "context_chunk_ids", "citations_valid")


class _Fetched:
    """A model that finds something only in a context that has the word enriched."""

    def complete(self, system: str, user: str) -> str:
        return "It is so [1]." if "enriched" in user else "Insufficient evidence."


@query("x10_chat", "SELECT 'q' || item_id AS query_id, 'enriched' AS answered_by, 'It is so [1].' AS answer FROM benchmark")
def _(spark, sf):
    c, wanted = chunk_corpus(spark, sf), asked(spark, sf)

    def enrich(poor: DataFrame) -> DataFrame:
        return poor.select(F.concat(F.lit("new-"), "query_id").alias("chunk_id"), F.lit("new").alias("paper_id"), F.lit("New").alias("title"), F.lit("Method").alias("section"), F.concat("text", F.lit(" "), "text", F.lit(" enriched")).alias("text"))

    titles = wanted.limit(0).select(F.col("text").alias("norm"), F.col("text").alias("title"))
    rows = generation.chat(wanted, c, titles, _Fetched, "s", "{{ question }}\n{{ context }}", enrich=enrich, budget=100_000)
    return rows.select("query_id", "answered_by", "answer")


class _Judge:
    """A judge that answers in form at once, at the second time, or never."""

    def complete(self, system: str, user: str) -> str:
        ids = [c["claim_id"] for c in json.loads(user.split("\n\nYour previous")[0])["claims"]]
        kind = int(ids[0].split("-")[1][:-1]) % 4
        verdict = {"verdicts": [{"subject_id": i, "check": "claim_support", "verdict": "Supported" if i.endswith("a") else "unsupported", "rationale": "r"} for i in ids]}
        if kind == 1 and "Your previous" not in user:
            return "Let me think."
        if kind == 2:
            verdict["verdicts"] = verdict["verdicts"][:1]
        return "```json\n" + json.dumps(verdict) + "\n```"


@query("x15_judged_cases", """
SELECT 'k' || item_id AS case_id, run, CASE WHEN item_id % 4 = 2 THEN 'unjudged' ELSE 'judged' END AS judge_status, CASE WHEN item_id % 4 <> 2 THEN 1 END::INT AS unsupported, run = 2 AND item_id % 4 <> 2 AS cached FROM benchmark, (SELECT unnest([1, 2])::INT AS run)""")
def _(spark, sf):
    cache = _scratch(spark)
    b = table(spark, sf, "benchmark")
    claims = b.select(F.concat(F.lit("k"), F.col("item_id")).alias("query_id"), F.explode(F.array(*[F.struct(F.concat(F.lit("claim-"), F.col("item_id"), F.lit(x)).alias("claim_id"), F.lit(x).alias("claim"), F.array(F.lit(1)).alias("citations")) for x in ("a", "b")])).alias("x")).select("query_id", "x.*")
    evidence = b.select(F.concat(F.lit("k"), F.col("item_id")).alias("query_id"), F.lit(1).alias("n"), "text")
    cases = generation.support_payload(claims, evidence)
    bad = lambda v: F.size(F.filter(v, lambda x: x["verdict"] == "unsupported"))
    # A run's rows are read before the next run adds to the cache.
    runs = [generation.judge(cases, _Judge, cache, "judge", "writer").select("case_id", F.lit(i).alias("run"), "judge_status", F.when(F.col("verdicts").isNotNull(), bad("verdicts")).alias("unsupported"), "cached") for i in (1, 2)]
    return runs[0].unionByName(runs[1])


class _Scorer:
    def __init__(self, kind: str) -> None:
        self.kind = kind

    def complete(self, system: str, user: str) -> str | tuple[str, str]:
        number = int(user)
        if self.kind == "main" and number % 4 == 1:
            raise ConnectionError("lost")
        if number % 4 == 2:
            return ('{"score": 0.', "length")
        return json.dumps({"score": number % 10 / 10 if self.kind == "main" else 0.5})


@query("x16_metric_run", """
SELECT item_id AS question_id, metric, CASE WHEN item_id % 4 = 2 THEN 'unavailable' ELSE 'completed' END AS status, CASE item_id % 4 WHEN 2 THEN NULL WHEN 1 THEN 0.5 ELSE (item_id % 10) / 10.0 END::DOUBLE AS value, CASE WHEN item_id % 4 = 2 THEN 'truncated' END AS reason FROM benchmark, (SELECT unnest(['faithfulness', 'relevancy']) AS metric)""")
def _(spark, sf):
    log = _scratch(spark)
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.lit("score").alias("system"), F.col("item_id").cast("string").alias("user"))
    metric = {name: lambda: _Scorer("main") for name in ("faithfulness", "relevancy")}
    generation.score_metrics(rows.where("question_id % 2 = 0"), metric, log, lambda: _Scorer("other"))
    return generation.score_metrics(rows, metric, log, lambda: _Scorer("other")).select("question_id", "metric", "status", "value", "reason")


@query("x17_built_plans", "SELECT 'dense' AS kind, 200::BIGINT AS n UNION ALL SELECT 'fallback', 120 UNION ALL SELECT 'hybrid', 120 UNION ALL SELECT 'sparse', 200")
def _(spark, sf):
    c, q = chunk_corpus(spark, sf).with_vectors(), asked(spark, sf)
    plans = {"dense": retrieval.build("dense", k=5), "sparse": retrieval.build({"kind": "Sparse", "k": 5}), "hybrid": retrieval.build("hybrid", k=3), "fallback": retrieval.build({"kind": "fallback", "primary": {"kind": "hybrid", "k": 3}})}
    rows = [plan(q, c).agg(F.lit(kind).alias("kind"), F.count("*").alias("n")) for kind, plan in plans.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("x18_readiness", """
SELECT source, CASE WHEN count(*) FILTER (length(trim(text)) > 0) = count(*) THEN 'ready' ELSE 'degraded' END AS status, count(*) AS chunks, count(*) FILTER (length(trim(text)) > 0) AS indexed FROM documents GROUP BY source""")
def _(spark, sf):
    """The health of each source's part of the index: its chunks, and those of them that the index has."""
    d = table(spark, sf, "documents")
    counts = d.groupBy("source").agg(F.count("*").alias("chunks"), F.coalesce(F.count_if(F.length(F.trim("text")) > 0), F.lit(0)).alias("indexed"))
    return counts.select("source", generation.health({"bm25": F.col("indexed") == F.col("chunks")}).alias("status"), "chunks", "indexed")


# ---- filters, files, reports ------------------------------------------------------


@query("p06_filtered_search", f"""
WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, 'v' || vec_id AS key, round(list_cosine_similarity(q.e::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM q, embeddings v WHERE v.label IN (1, 3) AND v.vec_id >= 20 AND v.vec_id < 400)
SELECT query_id, key, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key))::INT AS rank FROM s WHERE score >= 0.05 QUALIFY rank <= 5""")
def _(spark, sf):
    v = table(spark, sf, "embeddings")
    rows = v.select(F.concat(F.lit("v"), "vec_id").alias("key"), "embedding", "label", F.create_map(F.lit("number"), _n("vec_id")).alias("metadata"))
    condition = ranking.compile_filter({"label": [1, 3], "number": {"gte": 20, "lt": 400}}, rows.columns, mode="dense")
    found = dense.search(rows, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5, key="key", where=condition, threshold=0.05)
    return found.select("query_id", "key", "score", "rank")


@query("f38_repaired_text", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'café – ' || conv_id WHEN 1 THEN 'plain ' || conv_id ELSE 'naïve 日 ' || conv_id END AS text FROM conversations")
def _(spark, sf):
    n = _n("conv_id")
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("cafÃ© â€“ "), n)).when(F.col("turn") % 3 == 1, F.concat(F.lit("plain "), n)).otherwise(F.concat(F.lit("naïve 日 "), n))
    return table(spark, sf, "conversations").select("conv_id", "turn", answers.repaired(said).alias("text"))


@query("s18_report_files", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def _(spark, sf):
    path = _scratch(spark)
    stores.write_report({"latency": metrics.summary(table(spark, sf, "events").withColumn("mean", F.col("value")), ["event_type"], ["mean"])}, path, "Latencies")
    as_json = spark.read.schema("event_type string, n long, mean double").json(f"{path}/latency.json")
    as_csv = spark.read.option("header", True).schema("event_type string, n long, mean double").csv(f"{path}/latency.csv")
    return as_json.intersect(as_csv)


@query("s19_generation_files", """
WITH l AS (SELECT user_id AS question_id, event_type AS metric, arg_max(value, event_id) AS value FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL)
SELECT c_custkey AS question_id, 'a' || c_custkey AS answer, max(value) FILTER (metric = 'click') AS click, max(value) FILTER (metric = 'view') AS view FROM customer LEFT JOIN l ON question_id = c_custkey GROUP BY c_custkey""")
def _(spark, sf):
    path = _scratch(spark)
    runs = table(spark, sf, "customer").select(F.col("c_custkey").alias("question_id"), F.concat(F.lit("a"), F.col("c_custkey")).alias("answer"))
    log = table(spark, sf, "events").select(F.col("user_id").alias("question_id"), F.col("event_type").alias("metric"), "value", F.col("event_id").alias("seq"))
    stores.write_report({"answers": reports.with_metrics(runs, metrics.latest(log, ["question_id", "metric"], "seq", ["value"]), ["click", "view"])}, path, "Answers")
    return spark.read.schema("question_id long, answer string, click double, view double").json(f"{path}/answers.json")


@query("j12_pending_files", "SELECT c_custkey AS canonical_id FROM customer WHERE NOT (c_custkey % 3 = 0 AND c_custkey % 2 = 0)")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("canonical_id"))
    registry = c.withColumn("status", F.when(F.col("canonical_id") % 3 == 0, "processed").otherwise("failed")).withColumn("path", F.concat(F.lit("f"), F.col("canonical_id")))
    return state.pending(c, registry, files=c.where("canonical_id % 2 = 0").select(F.concat(F.lit("f"), F.col("canonical_id")).alias("path")))
