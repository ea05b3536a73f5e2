import __spark_entry__ as entry


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "doc_id", "score", "rank"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_results_do_not_depend_on_partitioning(spark):
    from paperloom.operators import lexical

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    q = spark.createDataFrame([(1, "the of then")], "query_id long, text string")
    one = lexical.top_k(lexical.scores(q, docs.coalesce(1)), 20).orderBy("rank").collect()
    many = lexical.top_k(lexical.scores(q, docs.repartition(7)), 20).orderBy("rank").collect()
    assert one == many
