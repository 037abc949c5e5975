"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _stars(edges: DataFrame) -> bool:
    """Whether every id has one edge at most, to an id that has none: the components are then read off."""
    many = edges.groupBy("a").count().where("count > 1")
    return many.isEmpty() and edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """Smallest id reachable from each id that has an edge.

    Each round hangs every id's larger neighbours, then its smaller ones, on its smallest; the rounds needed
    grow with the logarithm of the ids.  Hubs are no hot keys: minima are pre-aggregated and joined back.

    :param edges: ``a``, ``b`` long; loops and repeats don't matter
    :return: ``id``, ``component``, one row per id; an empty table for no edges
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    while not _stars(edges):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, name)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = materialize(small, name)
    return nodes.join(edges.withColumnRenamed("a", "id"), "id", "left").select("id", F.coalesce("b", "id").alias("component"))
