"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

Every set of equal texts is one indivisible group.  The groups are dealt into buckets; each bucket is
differenced on its own into one partial partition (``n_shards`` sums), and the partial partitions are
differenced again, level by level, until one is left.  A level's partial partitions are few thousand
per task, whatever the input, and the last level is combined on the driver only when it is that small.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import buckets_for, materialize

#: Partial partitions that one task or the driver combines at most, about.
FAN_IN = 4000


def difference(sums: list[list[int]], k: int) -> tuple[list[int], np.ndarray]:
    """Multiway differencing.  Repeatedly takes the two partial partitions of largest spread and adds
    the one's largest part to the other's smallest.

    :param sums: one list of ``k`` part sums per partial partition
    :return: the sums of the whole, and for each input an array saying where each of its parts went
    """
    n = len(sums)
    if n == 0:
        return [0] * k, np.zeros((0, k), dtype=np.int32)
    nodes = [list(s) for s in sums]
    heap = [(min(s) - max(s), i) for i, s in enumerate(nodes)]
    heapq.heapify(heap)
    merges: list[tuple[int, int, list[int], list[int]]] = []
    parts = range(k)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heap[0]
        x, y = nodes[a], nodes[b]
        down = sorted(parts, key=x.__getitem__, reverse=True)
        up = sorted(parts, key=y.__getitem__)
        z = [x[i] + y[j] for i, j in zip(down, up, strict=True)]
        nodes[a] = nodes[b] = None
        heapq.heapreplace(heap, (min(z) - max(z), len(nodes)))
        nodes.append(z)
        merges.append((a, b, down, up))
    place = np.zeros((n + len(merges), k), dtype=np.int32)
    place[-1] = np.arange(k)
    for node in range(len(merges) - 1, -1, -1):
        a, b, down, up = merges[node]
        place[a, down] = place[n + node]
        place[b, up] = place[n + node]
    return nodes[-1], place[:n]


def _level(k: int):
    """One bucket: its partial partitions in, their places and the bucket's own sums (node null) out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable")
        total, place = difference([list(map(int, s)) for s in pdf["sums"]], k)
        bucket = int(pdf["bucket"].iloc[0])
        return pd.DataFrame(
            {
                "bucket": np.full(len(pdf) + 1, bucket),
                "node": [*pdf["node"], None],
                "sums": [*([None] * len(pdf)), total],
                "place": [*place.tolist(), None],
            }
        )

    return run


def partition_groups(groups: DataFrame, n_shards: int, fan_in: int = FAN_IN) -> DataFrame:
    """Shard of each group.

    :param groups: ``node`` string (unique), ``bytes`` long
    :return: ``node``, ``shard`` int
    """
    spark = groups.sparkSession
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    pad = [F.lit(0).cast("long")] * (n_shards - 1)
    level = groups.select("node", F.array(F.col("bytes"), *pad).alias("sums"))
    kind = "bucket long, node string, sums array<long>, place array<int>"
    levels: list[DataFrame] = []
    n = level.count()
    while True:
        buckets = buckets_for(n, fan_in // 2)
        if levels and n <= fan_in:
            break
        dealt = level.withColumn("bucket", F.pmod(F.xxhash64("node", F.lit(len(levels))), F.lit(buckets)))
        done = materialize(dealt.groupBy("bucket").applyInPandas(_level(n_shards), kind), "differencing")
        levels.append(done.where("place is not null").select("bucket", "node", "place"))
        level = done.where("place is null").select(F.col("bucket").cast("string").alias("node"), "sums")
        n = level.count()
    top = sorted((r["node"], r["sums"]) for r in level.collect())
    _, place = difference([list(s) for _, s in top], n_shards)
    rows = [(int(node), list(map(int, p))) for (node, _), p in zip(top, place, strict=True)]
    upper = spark.createDataFrame(rows, "bucket long, shards array<int>")
    for i, part in enumerate(reversed(levels)):
        joined = part.join(upper, "bucket")
        if i == len(levels) - 1:
            return joined.select("node", F.element_at("shards", F.element_at("place", 1) + 1).alias("shard"))
        upper = joined.select(
            F.col("node").cast("long").alias("bucket"),
            F.transform("place", lambda p: F.element_at("shards", p + 1)).alias("shards"),
        )
    raise AssertionError("unreachable")


def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of ``n_shards`` shards with near-equal bytes, equal texts together.

    A row's size is its text's UTF-8 bytes plus 1; a null text has none and forms a group of its own, as
    the empty text does.  Repeated rows and null ids are rows like others.  An empty table gives no rows.
    Other columns are not read.

    :return: id, ``size`` long, ``text_crc32`` long, ``shard`` int, ``slot`` long (gapless from 0 in each
        shard, in id order within hash buckets)
    """
    text, ident = F.col(text_col), F.col(id_col)
    base = materialize(
        docs.select(
            ident.alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("node"),
        ),
        "sizes",
    )
    groups = base.groupBy("node").agg(F.sum("size").alias("bytes"))
    placed = base.join(partition_groups(materialize(groups, "groups"), n_shards), "node").drop("node")
    n = buckets_for(base.count(), 20_000)
    placed = materialize(placed.withColumn("part", F.pmod(F.xxhash64("id", "size"), F.lit(n))), "placed")
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    within = W.partitionBy("shard", "part").orderBy("id", "text_crc32", "size")
    numbered = placed.withColumn("row", F.row_number().over(within))
    return numbered.join(starts, ["shard", "part"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("start") + F.col("row") - 1).alias("slot")
    )


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` in shards 0 to 7 under the law ``bytes``."""
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
