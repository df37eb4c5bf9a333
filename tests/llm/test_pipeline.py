"""The stages on a small corpus: what has to go goes, the rest stays."""

import corpus_pipeline


def test_stages(spark, docs, corpus, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    leak = corpus[20][1]
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, frame = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"]: r["text"] for r in frame.collect()}
    blank = {i for i, t, *_ in corpus if not any(c.isalpha() for c in t or "")}
    assert set(kept["language_id"]) == {None, *range(len(corpus))} - blank
    assert {60, 61, 62} & set(kept["near_duplicates"]) == set() and {0, 1, 2, 7} <= set(kept["near_duplicates"])
    assert set(kept["repeated_substrings"]) == set(kept["near_duplicates"]) and kept["repeated_substrings"][0] == corpus[0][1]
    assert set(kept["repeated_substrings"]) - set(kept["decontamination"]) == {20}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_repeated_rows_and_empty_tables(spark, docs, no_docs, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    text = "these words stand in a row that is long enough to be told apart from any other row of words " * 3
    rows = spark.createDataFrame([(1, text, None, "s", 1, "x", "y", "g", "c"), (1, text, None, "s", 1, "x", "y", "g", "c"), (2, text, None, "s", 1, "x", "y", "g", "c"), (None, "no id", None, "s", 1, "x", "y", "g", "c")], docs.schema)
    frame = rows
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
    assert sorted(r["doc_id"] or 0 for r in frame.collect()) == [0, 1]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, str(tmp_path)).count() == 0
