"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Each source has a weight that changes linearly over training.  Its integral is the source's share of all
tokens (capped at ``max_repeat`` passes, the excess reshared by weight); the inverse of the cumulative
demand turns a document's place in its source's token stream into its position in training; documents
are range-sorted by that position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_PATTERN, buckets_for, fresh, materialize, word_count

#: Weights at the start and the end of training, dealt to the sources in order, repeating.  Their means are 1, 2, 3.
START = (1.5, 2.0, 2.5)
END = (0.5, 2.0, 3.5)
MAX_REPEAT = 3


def _cycle(values: Sequence[float], index: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (index % len(values) + 1).cast("int"))


def targets(sizes: DataFrame, start: Sequence[float] = START, end: Sequence[float] = END, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Target words and curriculum tilt of each source.

    Sources in code-point order, null last, get the weights in turn.  The capped water level is closed
    form: with sources in the order of ``cap / weight``, those stay capped whose ratio is at most the
    level that what is left would give them.  One row per source, so its windows are small.

    :param sizes: ``source``, ``source_size`` long, one row per source
    :return: ``source``, ``source_size``, ``target`` double, ``tilt`` double in [-1, 1]
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    i = F.row_number().over(order) - 1
    t = sizes.withColumn("i", i).withColumn("w0", _cycle(start, F.col("i"))).withColumn("w1", _cycle(end, F.col("i")))
    t = t.withColumn("weight", (F.col("w0") + F.col("w1")) / 2).withColumn("cap", F.col("source_size") * F.lit(max_repeat))
    ratio = W.orderBy(F.col("cap") / F.col("weight"), "i")
    whole = W.partitionBy()
    t = (
        t.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
        .withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
        .withColumn("water", F.coalesce(F.max(F.when(~F.col("capped"), F.col("level"))).over(whole), F.lit(0.0)))
        .withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("water")))
        .withColumn("slope", (F.col("w1") - F.col("w0")) / (F.col("w1") + F.col("w0")))
    )
    mean = F.sum(F.col("target") * F.col("slope")).over(whole) / F.sum("target").over(whole)
    tilt = F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.round(F.col("slope") - mean, 12))), F.lit(0.0))
    return t.select("source", "source_size", "target", tilt.alias("tilt"))


def training_fraction(share: F.Column, tilt: F.Column) -> F.Column:
    """Inverse of a source's cumulative demand ``t + tilt * (t*t - t)`` at ``share`` of its target."""
    b = F.lit(1.0) - tilt
    return 2 * share / (b + F.sqrt(b * b + 4 * tilt * share))


def plan(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    start: Sequence[float] = START, end: Sequence[float] = END, max_repeat: int = MAX_REPEAT,
) -> DataFrame:
    """What the mix takes of each document, and when.

    A source's documents form a stream in the order of their ids' hashes; the mix takes the stream in whole
    passes and then its beginning, so that its words equal the target but for part of a word.  Rows equal
    in id, source and size are one unit: the mix treats them alike.  Null texts have no words; a null
    source is a source.  An empty table gives no rows.  Other columns are not read.

    :return: id, source, ``size``, ``rows`` (that share the unit), ``source_size``, ``target``, ``taken`` (words of each row, repeats
        counted), ``passes`` (array of struct(pass, words, fraction), ``fraction`` of training at which the pass's middle word comes)
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"))
    units = materialize(base.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "units")
    goal = targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")), start, end, max_repeat)
    n = buckets_for(units.count(), 400)
    spread = units.withColumn("order", F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))).cast("binary")))
    spread = spread.withColumn("bucket", F.floor(F.conv(F.substring("order", 1, 7), 16, 10).cast("long") * F.lit(n) / F.lit(16**7)))
    words = F.col("size") * F.col("rows")
    heads = spread.groupBy("source", "bucket").agg(F.sum(words).alias("bucket_words"))
    earlier = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    heads = heads.select("source", "bucket", F.coalesce(F.sum("bucket_words").over(earlier), F.lit(0)).alias("head"))
    same = [F.col("h.source").eqNullSafe(F.col("s.source")), F.col("h.bucket") == F.col("s.bucket")]
    within = W.partitionBy("source", "bucket").orderBy("order", "size").rowsBetween(W.unboundedPreceding, -1)
    stream = spread.withColumn("in_bucket", F.coalesce(F.sum(words).over(within), F.lit(0)))
    stream = stream.alias("s").join(heads.alias("h"), same).select("s.*", (F.col("h.head") + F.col("in_bucket")).alias("offset"))
    both = stream.alias("s").join(goal.alias("g"), F.col("g.source").eqNullSafe(F.col("s.source")))
    both = both.select("s.*", "g.source_size", "g.target", "g.tilt")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    both = both.withColumn("whole", whole.cast("long"))
    rest = F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    extra = F.greatest(F.lit(0), F.least(F.floor((rest - F.col("offset")) / F.col("rows")), F.col("size"))).cast("long")
    both = both.withColumn("extra", extra).withColumn("taken", F.col("whole") * F.col("size") + F.col("extra"))
    counts = F.transform(F.sequence(F.lit(0), F.col("whole")), lambda k: F.struct(k.alias("pass"), F.when(k < F.col("whole"), F.col("size")).otherwise(F.col("extra")).alias("words")))
    middle = lambda p: (p["pass"] * F.col("source_size") + F.col("offset") + p["words"] * F.col("rows") / 2) / F.col("target")
    passes = F.transform(
        F.filter(counts, lambda p: p["words"] > 0),
        lambda p: F.struct(p["pass"].alias("pass"), p["words"].alias("words"), F.round(training_fraction(F.least(middle(p), F.lit(1.0)), F.col("tilt")), 9).alias("fraction")),
    )
    return both.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "rows", "source_size", "target", "taken", passes.alias("passes"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The documents themselves, each once per pass that takes at least half of it, in training order.

    All columns of ``docs`` come back, and nothing else; the rows are range-sorted by training position.
    """
    (place,) = fresh(docs, "__at")
    made = materialize(plan(docs, id_col, source_col, text_col, **how), "mix-plan")
    kept = F.filter("passes", lambda p: 2 * p["words"] >= F.col("size"))
    times = made.select(F.col(id_col).alias("i"), F.col(source_col).alias("s"), F.col("size").alias("z"), F.explode(F.transform(kept, lambda p: p["fraction"])).alias("at"))
    on = [F.col("t.i").eqNullSafe(F.col(f"d.`{id_col}`")), F.col("t.s").eqNullSafe(F.col(f"d.`{source_col}`")), F.col("t.z") == word_count(f"d.`{text_col}`")]
    out = docs.alias("d").join(times.hint("merge").alias("t"), on).select(*[F.col(f"d.`{c}`") for c in docs.columns], F.col("t.at").alias(place))
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return out.repartitionByRange(n, place, id_col).sortWithinPartitions(place, id_col).drop(place)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all of ``documents``: one row per document, range-sorted by its first training position."""
    made = materialize(plan(spark.read.parquet(f"{sf_dir}/documents.parquet")), "mix-plan")
    made = made.withColumn("at", F.get("passes", F.lit(0))["fraction"])
    made = made.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    out = made.select("doc_id", "size", "source_size", "target", "taken", F.size("passes").cast("int").alias("n_passes"), F.col("at").alias("first_fraction"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return out.repartitionByRange(n, "first_fraction", "doc_id").sortWithinPartitions("first_fraction", "doc_id")


#: DuckDB's form of the query.  The water level comes from trying every source as the first that isn't capped.
ORACLE = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD_PATTERN}')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, [1.5, 2.0, 2.5][i % 3 + 1]::DOUBLE AS w0, [0.5, 2.0, 3.5][i % 3 + 1]::DOUBLE AS w1, (i % 3 + 1)::DOUBLE AS weight, 3 * source_size AS cap FROM s),
l AS (SELECT *, sum(source_size) OVER () AS total, coalesce(sum(cap) OVER (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
  sum(weight) OVER (ORDER BY cap / weight, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM w),
c AS (SELECT *, (total - cap_before) / weight_left AS level FROM l),
v AS (SELECT *, cap <= weight * level AS capped FROM c),
g AS (SELECT *, CASE WHEN capped THEN cap::DOUBLE ELSE weight * max(CASE WHEN NOT capped THEN level END) OVER () END AS target, (w1 - w0) / (w1 + w0) AS slope FROM v),
k AS (SELECT source, source_size, target, greatest(-1.0, least(1.0, round(slope - sum(target * slope) OVER () / sum(target) OVER (), 12)))::DOUBLE AS tilt FROM g),
o AS (SELECT d.*, k.source_size, k.target, k.tilt,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || doc_id::VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
  FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM o),
f AS (SELECT *, greatest(0, least(floor(target - whole * source_size)::BIGINT - off, size)) AS extra FROM e),
h AS (SELECT *, CASE WHEN whole > 0 THEN size ELSE extra END AS first_words FROM f),
x AS (SELECT *, least((off + first_words / 2.0::DOUBLE) / target, 1.0::DOUBLE) AS share, 1.0::DOUBLE - tilt AS b FROM h)
SELECT doc_id, size, source_size, target, whole * size + extra AS taken,
  (CASE WHEN size > 0 THEN whole ELSE 0 END + (extra > 0)::INT)::INT AS n_passes,
  CASE WHEN first_words > 0 THEN round(2 * share / (b + sqrt(b * b + 4 * tilt * share)), 9) END AS first_fraction FROM x
"""
