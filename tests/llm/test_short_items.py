import corpus_pipeline


def test_one_short_item_drops_no_document(spark, tmp_path):
    """A full window drops a document, one item of fewer words doesn't, two do."""
    long = "one two three four five six seven eight nine"
    items = [("a", "the"), ("b", "straße ör"), ("c", long), ("d", None), ("e", "...")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = ["the clean text of the day", f"x {long[:-5]} y", "the Straße ör", "straße ör alone", None, "one two three four five six seven"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()) == [0, 3, 4, 5]
