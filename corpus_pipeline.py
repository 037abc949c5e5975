"""From raw documents to encoded training text: language, toxicity, near duplicates, mix, tokens.

Each stage takes what its predecessor kept and returns the columns of ``documents``; the last returns encoded rows.
Stages read only the columns they need, so extra columns pass through all but the last.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import fst, langid, lshforest, mixing, toxicity
from quillon.llm.common import WRITTEN, discard, fresh, materialize, word_count


#: Bytes of a batch that goes to a Python worker, at most, about; a worker and an executor each hold several at a time.
BATCH_BYTES = 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def _small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Texts go to Python in batches bounded by bytes, not rows alone; the session's own bound stays if it is lower.

    The setting stays when the stage is done, since what it returns is run by its caller.
    """

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_CONF))
        if not 0 < held <= BATCH_BYTES:
            spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


def _without(docs: DataFrame, verdicts: DataFrame, key: str, share: bool = False) -> DataFrame:
    """Rows of ``docs`` whose key is not among those of ``verdicts``; these are written first, so that the planner knows their size.

    ``share``: the verdicts are a share of all documents, so they are merged, never broadcast, at every size.
    """
    (name,) = fresh(docs, "__gone")
    gone = materialize(verdicts.select(F.col(key).alias(name)).distinct(), "rejected")
    gone = gone.hint("merge") if share else gone
    return docs.join(gone, F.col(key).eqNullSafe(F.col(name)), "left_anti")


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """A key that also tells apart rows with null or repeated ids but different texts."""
    (key,) = fresh(docs, "__key")
    return docs.withColumn(key, F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text"))), key


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text is in no language that the corpus declares, or has no letters at all, so null and empty ones.

    Repeated rows go or stay together; rows with null or repeated ids are told apart by their texts.  Whole texts count.
    """
    keyed, key = _keyed(docs)
    model = langid.train(docs)
    found = langid.identify(keyed, model, key, F.col("text"), F.col("lang"), F.col("source"), F.lit(None).cast("string"))
    return _without(keyed, found.where((F.col("lang") == langid.UNKNOWN) | (F.col("evidence") == 0)), key).drop(key)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier holds toxic; null and empty texts stay.  Rows are told apart as in the stage before."""
    keyed, key = _keyed(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(keyed, labels, toxicity.held_out_fifth(), own_col=key)
    return _without(keyed, scored.where("predicted = 1"), key, share=True).drop(key)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group, null ids last, once if id and text repeat; documents without words have no group and stay.

    Rows with null or repeated ids are numbered by id and text, so that each of an id's texts is a document of its own.
    """
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        verdicts = materialize(lshforest.near_duplicates(docs), "near-duplicates")
        return _without(docs, verdicts.where("not kept"), "doc_id", share=True)
    keyed, key = _keyed(docs)
    same, own = fresh(keyed, "__same", "__own")
    order = (F.col(f"{same}.doc_id").asc_nulls_last(), F.col(f"{same}.text"))
    numbers = keyed.select(F.col(key).alias(same)).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    numbers = materialize(numbers.withColumn(own, F.monotonically_increasing_id()), "numbers")
    numbered = materialize(keyed.join(numbers.hint("merge"), F.col(key).eqNullSafe(F.col(same))).drop(key, same), "numbered")
    verdicts = materialize(lshforest.near_duplicates(numbered, id_col=own), "near-duplicates")
    out = _without(numbered, verdicts.where("not kept"), own, share=True)
    words = word_count("text") > 0
    return out.where(words).dropDuplicates([own]).unionByName(out.where(~words)).drop(own)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix in order: a document comes once per pass that takes it; ties in position go by id.

    Documents without words have no tokens to take; a null source is a source of its own.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row: doc_id, ids, n_pieces, round_trip; null and empty texts have none."""
    with open(fst.VOCABULARY, "rb") as f:
        model = f.read()
    return fst.encode(docs, model)


STAGES = [
    ("language ID", _small_batches(language_id)),
    ("toxicity", _small_batches(toxic)),
    ("MinHash near-dedup", _small_batches(near_duplicates)),
    ("mixing", _small_batches(mix)),
    ("SentencePiece", _small_batches(encode)),
]

#: Language models, label models and tokenizers aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again; what a stage wrote on the way goes when it is done.

    Every stage takes nulls in any column, empty and very long texts, repeated rows and ties (its operator says what each
    gives), and an empty table, which gives an empty one.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        before = set(WRITTEN)
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        new = [p for p in WRITTEN if p not in before]
        discard(spark, last + new[:-1])
        last = new[-1:]
    return docs
