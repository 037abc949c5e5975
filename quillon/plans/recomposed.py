"""Factors multiplied back, tables put together, and tests' p-values, against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlation as C
from ..operators import decomposition as D
from ..operators import tables as B
from .references import TAU, simpson
from .registry import query, table
from .statistics import DAILY, daily

LABEL = ["label"]
GRAM = "WITH e AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding)))::INT AS i FROM embeddings) SELECT a.label, a.i AS i, b.i AS j, round(sum(a.x * b.x), 5) + 0.0 AS value FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2, 3"


def _diagonal(values):
    return values.select(*LABEL, "i", F.col("i").alias("j"), "value")


def _back(kind):
    """The matrices that were decomposed, from their factors."""

    def run(spark, d):
        blocks = D.gram(table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v")), "v", LABEL)
        parts = D.decompose(blocks, kind, LABEL).persist()
        part = lambda name: parts.where(F.col("part") == name).drop("part")
        times = lambda a, b: B.product(a, b, LABEL)
        flip = lambda a: B.transposed(a, LABEL)
        if kind == "lu":
            order = part("p").select("label", "i", F.col("value").cast("int").alias("row"))
            out = times(part("l"), part("u")).join(order, ["label", "i"]).select("label", F.col("row").alias("i"), "j", "value")
        elif kind in ("qr", "lq"):
            out = times(part(kind[0]), part(kind[1]))
        elif kind == "svd":
            out = times(times(part("u"), _diagonal(part("s"))), part("vt"))
        elif kind == "cholesky":
            out = times(part("l"), flip(part("l")))
        elif kind == "ldl":
            out = times(times(part("l"), _diagonal(part("d"))), flip(part("l")))
        elif kind == "eigh":
            out = times(times(part("vectors"), _diagonal(part("values"))), flip(part("vectors")))
        else:  # the matrices are symmetric, so their Schur forms are real
            out = times(times(part("z_re"), part("t_re")), flip(part("z_re")))
        return out.select("label", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), (F.round("value", 5) + F.lit(0.0)).alias("value"))

    return run


for _kind in ("lu", "qr", "lq", "svd", "cholesky", "ldl", "eigh", "schur"):
    query(f"recompose_{_kind}", GRAM)(_back(_kind))


@query("correlate_daily", f"WITH {DAILY} SELECT a.event_type, (a.t - b.t)::INT AS k, round(sum(a.y * b.y), 0) AS value FROM d a JOIN d b USING (event_type) GROUP BY 1, 2", 0)
def correlate_daily(spark, d):
    s = daily(spark, d)
    return C.correlate_rows(s, s, ["event_type"]).withColumn("k", F.col("k").cast("int"))


@query("pacf_two_lags", f"""WITH {DAILY}, m AS (SELECT event_type, t, y - avg(y) OVER (PARTITION BY event_type) AS y FROM d), c AS (SELECT event_type, sum(y * y) AS c0, count(*) AS n FROM m GROUP BY 1),
r AS (SELECT a.event_type, sum(CASE WHEN b.t = a.t + 1 THEN a.y * b.y END) / any_value(c0) AS r1, sum(CASE WHEN b.t = a.t + 2 THEN a.y * b.y END) / any_value(c0) AS r2, any_value(n) AS n FROM m a JOIN m b ON b.event_type = a.event_type AND b.t IN (a.t + 1, a.t + 2) JOIN c ON c.event_type = a.event_type GROUP BY 1),
v AS (SELECT event_type, 0 AS lag, 1.0::DOUBLE AS value, 0.0::DOUBLE AS half FROM r UNION ALL SELECT event_type, 1, r1, 1.959963984540054 / sqrt(n) FROM r UNION ALL SELECT event_type, 2, (r2 - r1 * r1) / (1 - r1 * r1), 1.959963984540054 / sqrt(n) FROM r)
SELECT event_type, lag::INT AS lag, round(value, 8) AS value, round(value - half, 8) AS ci_low, round(value + half, 8) AS ci_high FROM v""", 8)
def pacf_two_lags(spark, d):
    return C.partial_autocorrelation(daily(spark, d), "y", 2, ["event_type"], method="ld_biased")


P_VALUE = simpson("exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0) - 0.5 * ln((n - 2) * pi()) - (n - 1) / 2.0 * ln(1 + v * v / (n - 2)))", "0", "abs(tt)", 2000)


@query("pearson_p_values", f"WITH r AS (SELECT l_linestatus, l_returnflag, count(*) AS n, corr(l_quantity, l_discount) AS r FROM lineitem GROUP BY 1, 2), t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS tt FROM r) SELECT l_linestatus, l_returnflag, n, round(r, 7) AS r, round((1 - 2 * ({P_VALUE}))::DOUBLE, 7) AS p_value FROM t", 7)
def pearson_p_values(spark, d):
    return C.pearson_test(table(spark, d, "lineitem").withColumns({c: F.col(c).cast("double") for c in ("l_quantity", "l_discount")}), "l_quantity", "l_discount", ["l_linestatus", "l_returnflag"])


@query("union_rows", "SELECT s_nationkey AS nation, s_name AS name, round(s_acctbal, 2) AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_nationkey, c_name, round(c_acctbal, 2), c_mktsegment FROM customer", 2)
def union_rows(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return B.union_rows(a, b)


@query("zip_by_position", """WITH a AS (SELECT s_nationkey AS nation, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) - 1 AS p FROM supplier), b AS (SELECT c_nationkey AS nation, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) - 1 AS p FROM customer)
SELECT nation, p::INT AS position, s_suppkey, c_custkey FROM a JOIN b USING (nation, p)""")
def zip_by_position(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal")
    b = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_acctbal")
    return B.zip_by_position(a, b, ["nation"], ["s_acctbal", "s_suppkey"], [F.col("c_acctbal").desc(), "c_custkey"]).select("nation", "position", "s_suppkey", "c_custkey")
