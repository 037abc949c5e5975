"""Near-duplicate stage on repeated and null ids; pieces of every kind."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_each_text_of_an_id_is_a_document(spark):
    one, two, other = (" ".join(f"{w}{i}" for i in range(40)) for w in ("red", "blue", "green"))
    rows = [(1, one), (2, one + " more"), (2, two), (2, other), (2, other), (None, two), (None, "alone in the whole table"), (None, "alone in the whole table"), (3, ""), (3, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(1, one), (2, two), (2, other), (None, "alone in the whole table"), (3, ""), (3, ""), (None, None)]))
