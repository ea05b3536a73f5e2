import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import answers, benchmarks, dense, documents, entities, lexical, metrics, ranking, references, state, structured
from paperloom.plans import retrieval


def test_bm25_against_formula(spark):
    docs = [(1, "dense retrieval model"), (2, "sparse retrieval"), (3, "vision model model"), (4, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame([(1, "model model retrieval")], "query_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lexical.scores(q, df).collect()}
    toks = {d: t.split() for d, t in docs if t}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    terms = {t for ts in toks.values() for t in ts}
    df_ = {t: sum(t in ts for ts in toks.values()) for t in terms}
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df_.items()}
    eps = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else eps for t, v in raw.items()}
    for d, ts in toks.items():
        want = sum(idf[t] * ts.count(t) * 2.5 / (ts.count(t) + 1.5 * (0.25 + 0.75 * len(ts) / avg)) for t in ["model", "model", "retrieval"])
        assert got[d] == pytest.approx(want)


def test_top_k_zero_and_ties(spark):
    rows = spark.createDataFrame([(1, 5, 0.5), (1, 3, 0.5), (1, 9, float("nan"))], "query_id long, doc_id long, score double")
    assert lexical.top_k(rows, 0).count() == 0
    assert [(r["doc_id"], r["rank"]) for r in lexical.top_k(rows, 5).orderBy("rank").collect()] == [(3, 1), (5, 2)]


def test_rrf_order(spark):
    lists = spark.createDataFrame([(1, "d", "dense", 1), (1, "d", "shared", 2), (1, "s", "shared", 1), (1, "s", "sparse", 2)], "query_id long, source string, doc_id string, rank int")
    assert [r["doc_id"] for r in ranking.reciprocal_rank_fusion(lists).orderBy("rank").collect()] == ["shared", "dense", "sparse"]


def test_diversify_is_the_two_pass_greedy(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for q in range(30):
        items = [(q, f"c{i}", f"p{rng.integers(4)}", f"s{rng.integers(3)}", i + 1) for i in range(12)]
        rows += items
        out, papers, sections = [], {}, {}
        for limit in (1, 2):
            for _, c, p, s, _ in items:
                if c not in out and papers.get(p, 0) < limit and sections.get((p, s), 0) < 1:
                    out.append(c)
                    papers[p] = papers.get(p, 0) + 1
                    sections[p, s] = 1
        want[q] = out[:8]
    got = ranking.diversify(spark.createDataFrame(rows, "query_id long, chunk_id string, paper string, section string, rank int"))
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert found == want


def test_mmr_prefers_the_diverse():
    assert dense.mmr_order(np.array([1, 0]), np.array([[1, 0], [0.99, 0.01], [0.6, 0.8]]), 2, 0.4) == [0, 2]
    assert dense.mmr_order(np.array([0, 0]), np.array([[0, 0], [1, 0]]), 5) == [0, 1]


def test_dense_search_filters_before_k(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 2020), (2, [0.9, 0.1], 2024), (3, [0.0, 1.0], 2024), (4, None, 2024)], "vec_id long, embedding array<float>, year int")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<float>")
    got = dense.search(rows, q, 1, where=F.col("year") >= 2024).collect()
    assert [(r["vec_id"], r["rank"]) for r in got] == [(2, 1)]


def test_search_keeps_keys_of_any_type(spark):
    vectors = spark.createDataFrame([(f"v{i}", [float(i % 7), 1.0]) for i in range(3000)], "chunk_id string, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([("q0", [6.0, 1.0]), ("q1", [0.0, 1.0]), ("q2", None)], "query_id string, embedding array<double>")
    got = dense.search(vectors, queries, 3, key="chunk_id").collect()
    want = {"q0": sorted(f"v{i}" for i in range(3000) if i % 7 == 6)[:3], "q1": sorted(f"v{i}" for i in range(3000) if i % 7 == 0)[:3]}
    assert {q: [r["chunk_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in want} == want and len(got) == 6
    rows = vectors.where("chunk_id < 'v2'").withColumnRenamed("embedding", "vector").withColumn("query_id", F.lit("q")).withColumn("query_vector", F.array(F.lit(1.0), F.lit(0.0))).withColumn("rank", F.lit(1)).withColumn("score", F.lit(1.0))
    assert dense.mmr(rows.limit(9), 2, key="chunk_id").schema["chunk_id"].dataType.simpleString() == "string"


def test_blocks_of_queries_make_no_difference(spark, monkeypatch):
    docs = spark.createDataFrame([(f"d{i}", f"alpha {'beta ' * (i % 5)} gamma{i % 11} w{i}") for i in range(400)], "doc_id string, text string").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", f"beta gamma{i} alpha alpha") for i in range(11)] + [("none", "zzz")], "query_id string, text string")
    whole = sorted(lexical.search(queries, docs, 4).collect())
    assert whole == sorted(lexical.top_k(lexical.scores(queries, docs), 4).select("query_id", "doc_id", "score", "rank").collect())
    monkeypatch.setattr(lexical, "MAX_PAIRS", 5)
    monkeypatch.setattr(lexical, "STRIP", 7)
    assert sorted(lexical.search(queries, docs, 4).collect()) == whole and len(whole) == 44


def test_filters(spark):
    rows = spark.createDataFrame([(1, 2024, {"k": "a"}), (2, None, {}), (3, 2020, {"k": "b"})], "id int, year int, metadata map<string,string>")
    pick = lambda f, **k: [r["id"] for r in rows.where(ranking.compile_filter(f, rows.columns, **k)).orderBy("id").collect()]
    assert pick({"year": {"gte": 2021}}) == [1]
    assert pick({"k": None}) == [2]
    assert pick({"k": ["a", "b"]}) == [1, 3]
    assert pick({"k": []}) == []
    for bad in ({"k": {"near": 1}}, {" ": 1}):
        with pytest.raises(ValueError):
            ranking.compile_filter(bad, rows.columns)
    with pytest.raises(ValueError):
        ranking.compile_filter({"k": []}, rows.columns, "dense")


def test_metric_golden(spark):
    ranked = spark.createDataFrame([("c", 1, "x", 1), ("c", 1, "a", 2), ("c", 1, "b", 3)], "config string, query_id int, doc_id string, rank int")
    rel = spark.createDataFrame([(1, "a"), (1, "b")], "query_id int, doc_id string")
    r = metrics.per_query(ranked, rel, ks=(2,)).first()
    assert (r["recall_2"], r["precision_2"], r["mrr"]) == (0.5, 0.5, 0.5)
    assert r["ndcg_2"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)), abs=1e-6)


def test_null_metrics_are_not_zero(spark):
    log = spark.createDataFrame([("m", 1.0), ("m", None), ("n", None)], "metric string, value double")
    got = {r["metric"]: (r["mean"], r["scored"], r["unavailable"]) for r in metrics.nullable_means(log, ["metric"]).collect()}
    assert got == {"m": (1.0, 1, 1), "n": (None, 0, 1)}


def test_packing_skips_what_does_not_fit(spark):
    ranked = spark.createDataFrame([(1, "a", 1, 5), (1, "b", 2, 9), (1, "c", 3, 4)], "query_id long, chunk_id string, rank int, n_words int")
    assert [(r["chunk_id"], r["citation_number"]) for r in answers.pack(ranked, 10).orderBy("citation_number").collect()] == [("a", 1), ("c", 2)]


def test_windows_progress_and_overlap():
    text = "One two three. Four five six. Seven eight nine ten."
    spans = documents.windows_of(text, most=6, overlap=2, least=2)
    assert [text[a:b] for a, b in spans][0] == "One two three."
    assert spans[-1][1] == len(text) and all(a < b for a, b in spans)
    assert documents.windows_of("   ") == []
    assert len(documents.windows_of("a " * 50, most=4, overlap=10)) == 13


def test_sections_over_two_lines_and_subsections(spark):
    text = ["Title", "", "1. Introduction", "hello there.", "2 METHODS", "2.1 Data And Code", "body text.", "Conclusions and", "Future Work", "the end.", "References", "[1] x."]
    rows = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(text)], "doc_id int, page_number int, line_no int, line string")
    got = {r["line_no"]: r["section"] for r in documents.sections(rows).collect()}
    assert got[0] == "front_matter" and got[3] == "introduction" and got[6] == "methodology" and got[9] == "conclusion" and got[11] == "references"
    assert 8 not in got


def test_named_papers_as_in_plain_python(spark):
    titles = ["Attention Is All", "attention", "Deep  Nets", "C++ (and *.*)", "日本", "A.B"]
    asked = [
        "Does 'Deep Nets' beat Attention Is All?", "ATTENTION is  all, attention, and xattention", "of c++ (and *.*) and \"Unknown One.\"", "日本 and 'q'", "a.b axb", "", "'Deep nets' and deep nets", "“Attention” is all",
    ]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    known = entities.known_titles(spark.createDataFrame([(t,) for t in [*titles, " ", None]], "t string"), "t")
    spelled = [r["title"] for r in known.collect()]
    for broadcast in (100, 0):
        got = {r["query_id"]: r["titles"] for r in entities.named_papers(q, known, broadcast=broadcast).collect()}
        for i, text in enumerate(asked):
            want = entities.mentions(text, spelled if broadcast else [t for t in spelled if t != "日本"])
            assert got.get(i, []) == want, text
    assert documents.near_duplicate_pairs(["alpha beta gamma", "Alpha  beta gamma", "other"]) == [(0, 1)]


def test_papers_named_without_ascii_words_are_found_among_any_number_of_titles(spark):
    asked = ["「日本」と  研究の比較", "über 日本 und deep nets", "日 本, 研究 再 研究 再々 études ∑∫ …", "…∑∫ 日本研究の比較と展望について"]
    titles = ["日本", "研究", "Deep Nets", "研究 再々", "∑∫", "日本研究の比較と展望について", "日本研究の比較と展望に"]
    q = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "query_id long, text string")
    few = entities.known_titles(spark.createDataFrame([(t,) for t in titles], "t string"), "t")
    many = few.unionByName(spark.range(entities.MAX_BROADCAST_TITLES).select(F.concat(F.lit("unasked"), "id").alias("norm"), F.concat(F.lit("Unasked"), "id").alias("title")))
    chunks = spark.createDataFrame([("c1", "p1", "Deep Nets", "a", "deep nets are deep")], "chunk_id string, paper_id string, title string, section string, text string")
    missing = []
    for known in (few, many):
        got = {r["query_id"]: r["titles"] for r in entities.named_papers(q, known).collect()}
        assert got == {i: entities.mentions(text, titles) for i, text in enumerate(asked)}
        _, report = retrieval.per_entity(q, retrieval.Corpus(chunks), known, search=retrieval.sparse_search)
        missing.append(sorted(tuple(r) for r in retrieval.papers_without_evidence(report).collect()))
    assert missing[0] == missing[1] and (0, "研究") in missing[0] and (1, "Deep Nets") not in missing[0]


@pytest.mark.parametrize("keys,wanted", [(4_000_000, 100_000), (0, 7)])
def test_coverage_writes_and_deals_out_no_texts(spark, monkeypatch, keys, wanted):
    """As brute force, in one turn and in several, with keys broadcast and not; before, all chunks' texts were written, and dealt out with their pairs."""
    monkeypatch.setattr(benchmarks, "MAX_BROADCAST_KEYS", keys, raising=False)
    monkeypatch.setattr(benchmarks, "MAX_WANTED", wanted, raising=False)
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)] + ["Straße", "日本"]
    said = lambda n: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=n))
    texts = [said(rng.randint(1, 12)) for _ in range(150)]
    texts += [texts[0], "", " ", "x", None, "日本 の  研究"]
    chunks = [(f"c{i}", t) for i, t in enumerate(texts)]
    paragraphs = [(f"e{i}", t) for i, t in enumerate([said(rng.randint(1, 9)) for _ in range(60)] + [t[2:-1] for t in texts[:30]] + ["nothing w1 known", "日本 の", "の", "unheard", "w3 unheard", texts[3].upper()])]
    seeds = [(f"e{60 + i}", f"c{i}") for i in range(0, 30, 2)]
    written, keep = [], benchmarks.stores.kept
    monkeypatch.setattr(benchmarks.stores, "kept", lambda df, name: written.append((name, df)) or keep(df, name))
    df = spark.createDataFrame(paragraphs, "e string, paragraph string")
    got = benchmarks.closest(df, spark.createDataFrame(chunks, "chunk_id string, text string").repartition(3), spark.createDataFrame(seeds, "e string, chunk_id string"))
    got = {r["e"]: (r["n"], r["shared"], r["chunk_id"], r["exact"]) for r in got.collect()}
    tokens = lambda t: {w for w in re.findall(r"[a-z0-9]+(?:[._+#-][a-z0-9]+)*", (t or "").lower()) if len(w) > 1}
    flat = lambda t: " ".join((t or "").lower().split()).replace("ß", "ss")
    want = {}
    for e, p in paragraphs:
        ranked = [(-len(tokens(p) & tokens(t)), c) for c, t in chunks]
        exact = any(flat(p) in flat(t) for _, t in chunks)
        s, c = min(ranked)
        if flat(p) and (s or exact):
            want[e] = (len(tokens(p)), -s or None, c if s else None, exact)
    assert got == want and sum(x[3] for x in want.values()) > 20
    assert written and not [name for name, df in written if {"text", "held"} & set(df.columns)]


def test_first_of_any_key_is_order_dependent(spark):
    rows = spark.createDataFrame([(1, "a", "x", "b"), (2, "a", "y", "b"), (3, "c", "y", "b"), (4, None, "", "b")], "pos int, arxiv string, doi string, batch string")
    assert sorted(r["pos"] for r in documents.first_of_any_key(rows, ["arxiv", "doi"], "pos", "batch").collect()) == [1, 3, 4]


def test_registry_resets_on_newer_version(spark):
    ev = [("p", 1, 1, "downloading", None, None), ("p", 2, 1, "downloaded", "f1", None), ("p", 3, 2, "discovered", None, None), ("p", 4, 2, "failed", None, "boom")]
    r = state.fold_registry(spark.createDataFrame(ev, "canonical_id string, seq long, version int, status string, path string, error string")).first()
    assert (r["status"], r["path"], r["error"], r["attempts"], r["version"]) == ("failed", None, "boom", 1, 2)


def test_structured_answers(spark):
    known = F.array(F.lit(1), F.lit(2))
    rows = [
        '{"items":[{"m":{"text":"a","citations":[1]}},{"m":{"text":"quite different words","citations":[2]}}]}', "nope", '{"items":[{"m":{"text":"a"}}]}',
        '{"items":[{"m":{"text":"the same long row of words here","citations":[1]}},{"m":{"text":"The same long row of word here","citations":[1]}}]}', None, "",
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    got = [r["f"] for r in df.orderBy("i").select(structured.table_failures("t", ["m"], known).alias("f")).collect()]
    assert got == [[], ["structured_output_invalid_json"], ["structured_field_uncited:1:m"], ["structured_items_duplicate:1:2"], ["structured_output_invalid_json"], ["structured_output_invalid_json"]]
    # Odd field names, and a table with a hole.
    odd = spark.createDataFrame([("""{"items":[{"it's":{"text":"x","citations":[1]}}]}""", "| A | B |\n|---|---|\n| 1 | |\n- Metric: 3")], "t string, a string")
    names, incomplete = structured.present_fields("a", F.lit(None).cast("string"))
    assert odd.select(structured.table_failures("t", ["it's"], known).alias("f"), names.alias("n"), incomplete.alias("i")).first() == ([], ["a", "b", "metric"], True)
    assert structured.recover("noise {bad} [1, 2] x", "array") == "[1, 2]" and structured.recover(None, "object") is None
    assert structured.recover('x {"a": {"k": 1}} y', "object", ["k"]) == '{"k": 1}' and structured.recover('{"k": 1}', "array", ["k"]) == '[{"k": 1}]'
    assert answers.repair_mojibake("cafÃ©") == "café"


def test_several_quoted_papers_make_a_comparison(spark):
    rows = [
        ("In 'Deep Nets', how does it work?", "mechanism", 1), ("How does 'Deep Nets' differ from \"BERT\" and why?", "comparison", 1), ("What does 'Deep Nets' show and how is it used", "direct_fact", 2),
        ("Explain 'A Net' and 'A Net' and how they work", "mechanism", 2), ("Per “Some Paper”, why is it better?", "causes_evidence", 1), ("What is 'a' and what is 'b paper' and 'c paper'", "direct_fact", 2),
    ]
    df = spark.createDataFrame(rows, "q string, kind string, n int")
    for r in df.select("kind", "n", T.question_type("q").alias("got"), F.size(T.question_parts("q")).alias("parts")).collect():
        assert (r["got"], r["parts"]) == (r["kind"], r["n"])


def test_cleaning_follows_one_pass(spark):
    cases = {
        "a \\textbf{\\alpha x} b \\emph{}c": "a \\alpha x b  c".replace("  ", " "), "x\x0bhead\x85tail\u2028end": "x head tail end", "\\[y\\]": "y", "wo-\n rd\n7\nnext": "word next", "\xa0 t \u3000": "t",
        "a\n" * 3: "a a a",
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    for r in df.select("t", "want", documents.clean_text("t").alias("got")).collect():
        assert " ".join(r["got"].split()) == " ".join(r["want"].split()), r
    head = "Running Head\n" + "\n".join(f"line {i}." for i in range(6)) + "\n"
    assert "Running Head" not in spark.createDataFrame([(head * 3,)], "t string").select(documents.clean_text("t")).first()[0]
    docs = spark.createDataFrame([({"abstract": "x\ny", "odd": None},)], "sections map<string,string>")
    assert documents.clean_sections(docs).first()[0] == {"abstract": "x y", "odd": ""}


def test_digits_of_identifiers_are_no_year(spark):
    texts = [
        "5) SMITH. Deep. DOI: 10.1234/ab.2019", "[2] C. Jones. “Other matters here”. In Proc. 1999, 2021. arXiv:2101.01999v2 https://x.org/2001.", "[3] Doe, J. (2004). The third work here. Nature 2005.",
        "[4] Lee, K. A fourth long work. Journal 12021, 2021. doi:10.1/x",
    ]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", references.parse("t").alias("c")).orderBy("i").select("c.*").collect()
    assert [r["year"] for r in got] == [None, 2021, 2004, 2021]
    assert (got[0]["authors"], got[0]["confidence"], got[1]["venue"], got[3]["venue"]) == (["SMITH. Deep. DOI: 10.1234/ab.2019"], 0.55, "”. In Proc. 1999", "Journal 12021")


def test_a_line_that_ends_begins_no_heading(spark):
    lines = ["text", ".", "METHODS", "more.", "vivid.", "Abstract", "3", "Results", "end"]
    rows = spark.createDataFrame([("d", 1, i, x) for i, x in enumerate(lines)], "doc_id string, page_number int, line_no int, line string")
    got = [(r["line_no"], r["section"]) for r in documents.sections(rows).orderBy("line_no").collect()]
    assert got == [(0, "front_matter"), (1, "front_matter"), (2, "methodology"), (3, "methodology"), (4, "methodology"), (5, "abstract"), (6, "results"), (8, "results")]


def test_metrics_by_label_are_those_of_pairs(spark):
    rows = [(i, None if i % 11 == 0 else i % 3) for i in range(40)] + [(7, 1)]
    labels = spark.createDataFrame(rows, "vec_id long, label int")
    queries = labels.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id")
    ranked = spark.createDataFrame([("c", q, (q * 7 + r * 3) % 40, r) for q in range(0, 40, 5) for r in range(1, 9)], "config string, query_id long, vec_id long, rank int")
    pairs = queries.join(labels, "label").where("vec_id <> query_id").select("query_id", "vec_id")
    got = metrics.per_query_by_label(ranked, queries, labels, (2, 5), key="vec_id")
    assert sorted(got.collect()) == sorted(metrics.per_query(ranked, pairs, (2, 5), key="vec_id").collect())
    # No join on the label has queries on one side and keys on the other.
    assert got.where("recall_5 > 0").count() > 0


def test_a_search_scores_documents_once(spark):
    docs = spark.createDataFrame([(i, f"alpha beta w{i}") for i in range(50)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "alpha w3")], "query_id long, text string")
    for found in (lexical.search(queries, docs, 5), dense.search(docs.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.col("doc_id").cast("double")).alias("embedding")), queries.select("query_id", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding")), 5)):
        assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 5


def test_audit_compares_what_can_be_nearest_and_no_more(spark, monkeypatch):
    rnd = random.Random(3)
    common = [f"common{i}" for i in range(12)]
    texts = [" ".join(rnd.sample(common, 8) + [f"rare{rnd.randrange(900)}" for _ in range(4)]) for _ in range(400)]
    texts += [texts[5], texts[7], None, "", "The. of", "common0", "common1 common2", "Straße  von common3 nach common4 hin", "界限 模型\n问题 x", "hththth"]
    ids = [f"c{i}" for i in range(len(texts))]
    cut = lambda t: t[3:-3]  # noqa: E731  the words at both ends are cut
    evidence = [[cut(t)] for t in texts[:300]] + [[f"unheard words no{i} common{i % 12}"] for i in range(100)] + [
        ["common0"], ["common2 common1"], ["common0 rare1", cut(texts[9]), cut(texts[8])], [], ["of the"], ["common7 rare3 rare5 rare8 common1"], ["von common3 nach"], ["traße von COMMON3 \n nach comm"], ["zzz"], ["common0 common0 common0"], ["模型 问题"], ["thth"], [" \n"], ["asse von COMMON3 nach"],
    ]
    gold = [[ids[i]] if i % 2 == 0 and i < 300 else [] for i in range(len(evidence))]
    misses = spark.createDataFrame([(f"q{i}", "p", e, g) for i, (e, g) in enumerate(zip(evidence, gold))], "question_id string, paper_id string, evidence array<string>, gold_ids array<string>")
    chunks = spark.createDataFrame([(i, "p", "s", t) for i, t in zip(ids, texts)], "chunk_id string, paper_id string, section string, text string")
    seen, rivals = [], benchmarks._rivals

    def counted(*args):
        seen.append(rivals(*args).count())
        return rivals(*args)

    monkeypatch.setattr(benchmarks, "_rivals", counted)
    found = {r["question_id"]: (r["best_overlap"], r["best_chunk_id"], r["exact_substring"]) for r in benchmarks.audit(misses, chunks).collect()}
    stop = set(T.STOP_WORDS)
    words = lambda t: {w for w in re.findall(T.CONTENT_TOKEN, (t or "").lower()) if len(w) > 1 and w not in stop}
    flat = lambda t: " ".join((t or "").lower().replace("ß", "ss").split())
    sets, expected = [words(t) for t in texts], {}
    for i, paragraphs in enumerate(evidence):
        rows = [(-len(words(p) & s) / len(words(p)), at, c) for at, p in enumerate(paragraphs) for c, s in zip(ids, sets) if words(p) & s]
        exact = any(flat(p) in flat(t) for p in paragraphs if flat(p) for t in texts)
        expected[f"q{i}"] = (round(-min(rows)[0], 6), min(rows)[2], exact) if rows else (0.0, "", exact)
    assert found == expected
    # Of the pairs, nearly all of which share a common word, few are compared.
    assert seen[0] < 0.05 * len(evidence) * len(texts)
