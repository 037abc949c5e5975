"""Helpers shared by the training-data operators: shared folder, written tables, text bytes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separates words everywhere in this package: space and the bytes 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD_BREAKS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session without that setting gets a temporary folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="quillon-")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Everything that this process has written to the shared folder, in order.
WRITTEN: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    WRITTEN.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return WRITTEN[-1]


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables whose readers are done."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gone = set(paths)
    WRITTEN[:] = [p for p in WRITTEN if p not in gone]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors,
    and gives the planner the table's true size for its choice of join."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key is hot if more than one in so many rows has it; so there are fewer hot keys than this.
HOT = 256


def join_split(rows: DataFrame, facts: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join of ``rows`` with one row of ``facts`` for each key; rows of hot keys stay where they are.

    :param weight: column of ``facts`` that counts a key's rows; it is dropped
    """
    total = facts.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    hot = F.col(weight) * HOT > total
    few = F.broadcast(facts.where(hot).drop(weight))
    spread = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(facts.where(~hot).drop(weight).hint("merge"), key)
    return rows.join(few, key).unionByName(spread)


def word_count(text: str) -> F.Column:
    """Number of words (maximal runs free of WORD_BREAKS) of a text column; null counts as none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def buckets_for(rows: int, per_bucket: int, least: int = 16) -> int:
    """How many hash buckets keep each at about ``per_bucket`` rows; grows with the input."""
    return max(least, -(-rows // per_bucket))


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from batches sorted by it; a run may go over several batches."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        if rest and rest[-1].column(key)[0].as_py() != k[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        at = 0
        for cut in cuts:
            yield pa.Table.from_batches([*rest, batch.slice(at, cut - at)])
            rest, at = [], cut
        rest.append(batch.slice(at))
    if rest:
        yield pa.Table.from_batches(rest)
