"""The corpus pipeline: columns, kept rows, edge cases."""

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F

from quillon.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == COLUMNS
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept.append(docs.count())
    assert n >= kept[0] >= kept[1] >= kept[2] > 0.5 * n and kept[3] > 0
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert encoded.count() == kept[3] and encoded.where("not round_trip").count() == 0


def test_edges(spark):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, 0), (None, "erin the thing that", "en", "a", 5), (4, "the thing that was", "en", "b", 4), (4, "the thing that was", "en", "b", 4), (5, "the thing that was", "en", "b", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"__key": F.lit(1), "__gone": F.lit(2), "id": F.lit(3)})
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        stage(spark, docs, SF).collect()
    once = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert once.where("doc_id = 4").count() == 1 and once.where("doc_id = 5").count() == 0
    assert corpus_pipeline.language_id(spark, docs, SF).where("doc_id in (1, 2)").count() == 0


def test_batches_are_bounded_by_bytes(spark):
    conf, docs = "spark.sql.execution.arrow.maxBytesPerBatch", spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    texts = spark.range(0, 1500, 1, 1).selectExpr("repeat('x', 20000) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(conf, "64m")
            stage(spark, docs, SF)
            assert max(r["n"] for r in texts.mapInArrow(sizes, "n long").collect()) < 5 << 20
            spark.conf.set(conf, "1m")
            stage(spark, docs, SF)
            assert spark.conf.get(conf) == "1m"
    finally:
        spark.conf.unset(conf)


def test_query_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
