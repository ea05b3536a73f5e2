import uuid

from pyspark.sql import functions as F

from paperloom.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_technical_tokens_keep_inner_joins(spark):
    assert one(spark, T.technical_tokens("t"), t="GPT-4 and C++ beat v1.2.3, Straße_x") == ["gpt-4", "and", "c++", "beat", "v1.2.3", "strasse_x"]
    assert one(spark, T.technical_tokens(F.lit(None).cast("string"))) == []


def test_content_tokens_drop_stop_words_and_repeats(spark):
    assert one(spark, T.content_tokens("t"), t="The model is a Model of x") == ["model"]


def test_chunk_id_equals_uuid5(spark):
    name = "rag-paper:7:méthode:0:12:été ☃"
    got = one(spark, T.chunk_id(F.lit(7), F.lit("méthode"), F.lit(0), F.lit(12), F.lit("été ☃")))
    assert got == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_identity_forms(spark):
    forms = ["2301.00001v2", "arXiv:2301.00001", "https://arxiv.org/abs/2301.00001v3", "http://arxiv.org/pdf/2301.00001.pdf", " hep-th/9901001v1 ", "", "///"]
    rows = spark.createDataFrame([(f,) for f in forms], "f string").select(T.canonical_id("f").alias("i")).collect()
    assert [r["i"] for r in rows] == ["2301.00001"] * 4 + ["hep-th_9901001", None, None]


def test_question_types(spark):
    cases = {
        "Compare A and B": "comparison", "What limitations exist?": "limitations_future_work", "Why is it so": "causes_evidence", "How many layers?": "direct_fact",
        "How does it go": "mechanism", "Which one": "direct_fact",
    }
    rows = spark.createDataFrame(list(cases.items()), "q string, want string").select(T.question_type("q").alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in rows)


def test_citation_numbers_in_groups(spark):
    assert one(spark, T.citation_numbers("t"), t="a [1, 2] b [x] c [3;4] d [5]") == [1, 2, 3, 4, 5]


def test_marked_parts(spark):
    assert one(spark, T.marked_parts("t"), t="What is A? And why? ") == ["What is A", "And why"]
    assert one(spark, T.marked_parts("t"), t="Only one?") == ["Only one"]


def test_expansion_adds_only_what_is_missing(spark):
    assert one(spark, T.expanded_query("t"), t="RAG  with  llm") == "RAG with llm retrieval augmented generation large language model"
    assert one(spark, T.expanded_query("t"), t="fragile retrieval") == "fragile retrieval"
