"""Relational queries on a fixture."""

from tessera.queries import relational


def test_rare_words_are_counted(spark, tmp_path):
    rows = [(1, "en", "Rare rare  word", 15), (2, "en", "word", 4), (3, None, " word", 5), (4, "de", None, None)]
    spark.createDataFrame(rows, "doc_id bigint, lang string, text string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.lang, r.word): (r.n, r.longest) for r in relational.agg_exploded_keys_all(spark, str(tmp_path)).collect()}
    assert got == {("en", "rare"): (1, 15), ("en", "word"): (2, 15), (None, "word"): (1, 5)}
