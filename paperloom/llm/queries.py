"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codebooks, collocations, decontamination, embeddings, jaccard, langid, passages, suffixes, tokenfile, toxicity, unigram, warc
from .common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings"), threshold=0.98)


OP1_SQL = """
WITH RECURSIVE e AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
), u AS (
    SELECT vec_id, label, v FROM e
    WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), l AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), n AS (
    SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a
), r AS (
    SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
    SELECT a AS vec_id, min(b) AS least FROM r GROUP BY a
)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id, vec_id <= coalesce(c.least, vec_id) AS kept
FROM e LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return tokenfile.write_and_read(docs, "byte_bpe_50k.json", end_id=2)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = unigram.fit(docs, "piece_bpe_32k.model")
    return unigram.token_counts(docs, model=model).drop("text")


def op4_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffixes.remove_repeats(docs, threshold=100, kept=None)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = decontamination.find(docs, read_table(spark, sf_dir, "benchmark"), n=10)
    names = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", names.alias("items_sha256"), "contaminated")


OP5_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), bg AS (
    SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS gram
    FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
          FROM (SELECT item_id, w, least(len(w), 10) AS size FROM b WHERE len(w) > 0))
), dg AS (
    SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS gram
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
          FROM d, (SELECT DISTINCT size FROM bg))
), m AS (
    SELECT DISTINCT doc_id, i, size, item_id FROM dg JOIN bg USING (size, gram)
), hits AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.is_held_out()))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.is_held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, "word_bpe_49k.json").drop("text")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = langid.crc_of("doc_id", 5) == 0
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return jaccard.groups(docs, k=5, percent=80).select("doc_id", "n_shingles", "component_id")


OP9_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM w WHERE len(w) > 0)
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
    SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), r AS (
    SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
    SELECT a AS doc_id, min(b) AS least FROM r GROUP BY a
)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(c.least, doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(read_table(spark, sf_dir, "pages"))


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS response FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> response THEN response END AS refers_to
FROM f
"""


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compress(read_table(spark, sf_dir, "embeddings"), scale=1024, parts=4, entries=256, rounds=4)


_OP11_ROUND = """
, d{i} AS MATERIALIZED (
    SELECT id, p, list_min(list_transform(list_zip(b.vs, b.cs), lambda e: {{'d': list_sum(list_transform(list_zip(x, e[1]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'c': e[2]}})) AS best
    FROM parts JOIN (SELECT p, list(v ORDER BY c) AS vs, list(c ORDER BY c) AS cs FROM b{i} GROUP BY p) b USING (p)
)"""
_OP11_NEXT = """
, m{i} AS MATERIALIZED (
    SELECT p, c, list(s ORDER BY k) AS v
    FROM (SELECT p, c, k, CAST(floor_div AS BIGINT) AS s
          FROM (SELECT p, c, k, CASE WHEN t % n < 0 THEN t // n - 1 ELSE t // n END AS floor_div
                FROM (SELECT p, best.c AS c, k, sum(x[k]) AS t, count(*) AS n
                      FROM (SELECT p, best, x, unnest(range(1, len(x) + 1)) AS k FROM d{i} JOIN parts USING (id, p)) GROUP BY ALL)))
    GROUP BY p, c
), b{j} AS MATERIALIZED (
    SELECT b.p, b.c, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN m{i} m ON m.p = b.p AND m.c = b.c
)"""
OP11_SQL = """
WITH e AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
    SELECT id, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x FROM e, range(4) AS r(p)
), b0 AS MATERIALIZED (
    SELECT p, id - 1 AS c, x AS v FROM parts WHERE id <= 256
)""" + "".join(_OP11_ROUND.format(i=i) + _OP11_NEXT.format(i=i, j=i + 1) for i in range(4)) + _OP11_ROUND.format(i=4) + """
, codes AS (
    SELECT id, string_agg(lpad(lower(to_hex(best.c)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM d4 GROUP BY id
), book AS (
    SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, c)) AS codebooks_sha256 FROM b4
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM codes JOIN e USING (id), book
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"), top=2000, max_words=3, min_count=10, percent=50)


OP12_SQL = r"""
WITH p AS MATERIALIZED (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang,
                 unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
          FROM documents)
), g AS MATERIALIZED (
    SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3)) AS s(k) WHERE len(w) >= k)
), f AS MATERIALIZED (
    SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL
), n AS MATERIALIZED (
    SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS MATERIALIZED (
    SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10
), parts AS MATERIALIZED (
    SELECT lang, k, phrase, a, j, array_to_string(w[1 : j], ' ') AS head, array_to_string(w[j + 1 : k], ' ') AS tail
    FROM (SELECT *, unnest(range(1, k)) AS j FROM c)
), heads AS MATERIALIZED (
    SELECT p.*, f.a AS l FROM parts p JOIN f ON f.lang = p.lang AND f.phrase = p.head
), cuts AS MATERIALIZED (
    SELECT h.*, f.a AS r, (CAST(h.a AS HUGEINT) * h.a * 1000000) // (CAST(h.l AS HUGEINT) * f.a) AS score
    FROM heads h JOIN f ON f.lang = h.lang AND f.phrase = h.tail
), worst AS MATERIALIZED (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, j) = 1
), longer AS MATERIALIZED (
    SELECT lang, phrase, max(a) AS above
    FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY lang, phrase
), kept AS MATERIALIZED (
    SELECT w.* FROM worst w LEFT JOIN longer o ON w.k = 2 AND o.lang = w.lang AND o.phrase = w.phrase
    WHERE o.above IS NULL OR 100 * o.above < 50 * w.a
), ranked AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return passages.remove_passages(docs, threshold=50, kept=False).drop("text")


OP13_SQL = r"""
WITH d AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS MATERIALIZED (
    SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), m AS (
    SELECT h, min(doc_id) AS least FROM g GROUP BY h
), gone AS MATERIALIZED (
    SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM g JOIN m USING (h) WHERE doc_id > least
), r AS (
    SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id
), k AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept
    FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def queries() -> dict[str, Query]:
    return {
        "op1_embedding_near_duplicates": op1_embedding_near_duplicates,
        "op2_token_files": op2_token_files,
        "op3_token_counts": op3_token_counts,
        "op4_repeated_strings": op4_repeated_strings,
        "op5_decontamination": op5_decontamination,
        "op6_language_id": op6_language_id,
        "op7_bpe_round_trip": op7_bpe_round_trip,
        "op8_toxicity": op8_toxicity,
        "op9_ngram_jaccard": op9_ngram_jaccard,
        "op10_warc": op10_warc,
        "op11_vector_codes": op11_vector_codes,
        "op12_collocations": op12_collocations,
        "op13_repeated_passages": op13_repeated_passages,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_near_duplicates": OP1_SQL,
        "op5_decontamination": OP5_SQL,
        "op9_ngram_jaccard": OP9_SQL,
        "op10_warc": OP10_SQL,
        "op11_vector_codes": OP11_SQL,
        "op12_collocations": OP12_SQL,
        "op13_repeated_passages": OP13_SQL,
    }
