"""Language identification by Bayesian evidence fusion.

The text's likelihood under each language comes from byte trigrams counted over all texts with a known
language; a language ``und`` gives every trigram the same probability and stands for text in none of them.  The
declared language's likelihood comes from how declarations go with texts; the prior comes from the host, smoothed
towards its address suffix, and that towards all rows.  All of these are grouped counts over all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, read_table

BINS = 1 << 16
UNKNOWN = "und"
#: Added to each bin's count; weight of the text's evidence (neighbouring trigrams overlap); strength of the priors' smoothing.
PSEUDO, TEMPER, KAPPA = 0.05, 1 / 3, 10.0
#: Bytes that are counted at once, to bound memory.
CHUNK = 1 << 21


#: Bytes whose trigrams count: letters, parts of other characters, and what stands between words.  Digits, codes and markup say nothing.
COUNTED = np.zeros(256, dtype=bool)
COUNTED[[*range(65, 91), *range(97, 123), *range(128, 256), *b" '-"]] = True


def trigram_bins(raw: np.ndarray) -> np.ndarray:
    """A bin for each three neighbouring bytes that count, A-Z in lower case."""
    ok = COUNTED[raw]
    ok = ok[:-2] & ok[1:-1] & ok[2:]
    x = raw.astype(np.uint32)
    x += ((x >= 65) & (x <= 90)).astype(np.uint32) * np.uint32(32)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return (code[ok] * np.uint32(0x9E3779B1)) >> np.uint32(16)


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            into = counts.setdefault(lang, np.zeros(BINS, dtype=np.int64))
            for i in range(0, max(0, len(text) - 2), CHUNK):
                bins = trigram_bins(np.frombuffer(text[i : i + CHUNK + 2], np.uint8))
                np.add.at(into, bins, 1)
    for lang, n in counts.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some.astype(np.int32)), pa.array(n[some])], names=["lang", "bin", "n"])


class LanguageModel:
    """Log probabilities of the bins for each language, ``und`` last.  Its size is languages times BINS."""

    def __init__(self, languages: list[str], logp: np.ndarray):
        self.languages, self.logp = languages, logp

    def score(self, text: bytes) -> tuple[np.ndarray, int]:
        """Tempered log likelihoods of a text, and how many trigrams they rest on."""
        out, n = np.zeros(len(self.languages)), 0
        for i in range(0, max(0, len(text) - 2), CHUNK):
            bins = trigram_bins(np.frombuffer(text[i : i + CHUNK + 2], np.uint8))
            out += self.logp[bins].sum(axis=0, dtype=np.float64)
            n += len(bins)
        return out * TEMPER, n


def train(texts: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Count trigrams over all rows with a language and a text."""
    rows = texts.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != UNKNOWN))
    counts = rows.mapInArrow(_count_trigrams, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique()) + [UNKNOWN]
    logp = np.full((BINS, len(languages)), -math.log(BINS), dtype=np.float32)
    for i, lang in enumerate(languages[:-1]):
        n = np.full(BINS, PSEUDO)
        own = counts[counts["lang"] == lang]
        n[own["bin"].to_numpy()] += own["n"].to_numpy()
        logp[:, i] = np.log(n / n.sum())
    return LanguageModel(languages, logp)


def identify(rows: DataFrame, model: LanguageModel, id_col: str, text: Column, declared: Column, host: Column, suffix: Column) -> DataFrame:
    """The language of each row, from all evidence.

    Missing evidence (null declaration, host or suffix; null, empty or very short text) leaves the rest to decide;
    a text in none of the model's languages, or without any trigram and other evidence than common priors, is ``und``
    or of low probability.  A declaration outside the model's languages is one kind of its own.  Repeated rows
    and null ids are rows like others; an empty table gives none.

    :return: id, ``lang``, ``probability`` double, ``text_lang`` (by the text alone), ``evidence`` long (trigrams counted)
    """
    spark = rows.sparkSession
    languages = model.languages
    size = len(languages)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            raw = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            made = [model.score(t) for t in raw]
            scores = np.array([s for s, _ in made]).reshape(len(raw), size)
            counted = np.array([n for _, n in made], dtype=np.int64)
            best = np.where(counted > 0, scores.argmax(axis=1), size - 1) if raw else np.zeros(0)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(scores.ravel()), size).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "declared", "host", "suffix")), lists, pa.array(best.astype(np.int32)), pa.array(counted)],
                names=["id", "declared", "host", "suffix", "scores", "best", "evidence"],
            )

    known = F.lower(F.substring_index(F.substring_index(declared, "-", 1), "_", 1))
    known = F.when(known == "", None).when(known.isin(languages[:-1]), known).when(known.isNotNull(), "other")
    some = rows.select(F.col(id_col).alias("id"), known.alias("declared"), F.lower(host).alias("host"), F.lower(suffix).alias("suffix"), text.alias("text"))
    kind = f"id {some.schema['id'].dataType.simpleString()}, declared string, host string, suffix string, scores array<double>, best int, evidence long"
    scored = materialize(some.mapInArrow(run, kind), "language-scores")

    per = [F.count_if(F.col("best") == i).cast("double").alias(f"n{i}") for i in range(size)]
    said = {r["declared"]: [r[f"n{i}"] for i in range(size)] for r in scored.where("declared is not null").groupBy("declared").agg(*per).collect()}
    totals = [sum(n[i] for n in said.values()) for i in range(size)]
    kinds = [*languages[:-1], "other"]
    likely = F.create_map(*[x for d in kinds for x in (F.lit(d), F.array(*[F.lit(math.log((said.get(d, [0] * size)[i] + 1) / (totals[i] + len(kinds)))) for i in range(size)]))])
    none = F.array(*[F.lit(0.0)] * size)

    hosts = scored.groupBy("host", "suffix").agg(F.array(*[F.count_if(F.col("best") == i).cast("double") for i in range(size)]).alias("h"))
    hosts = materialize(hosts, "hosts")
    suffixes = hosts.groupBy("suffix").agg(F.array(*[F.sum(F.get("h", F.lit(i))) for i in range(size)]).alias("s"))
    whole = hosts.agg(*[F.coalesce(F.sum(F.get("h", F.lit(i))), F.lit(0.0)).alias(f"n{i}") for i in range(size)]).first()
    rows_all = sum(whole)
    common = F.array(*[F.lit((whole[i] + 1) / (rows_all + size)) for i in range(size)])

    def smooth(counts: Column, towards: Column) -> Column:
        n = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, towards, lambda c, p: (c + KAPPA * p) / (n + KAPPA))

    own = F.array(*[F.when(F.col("best") == i, 1.0).otherwise(0.0) for i in range(size)])
    both = hosts.alias("h").join(suffixes.alias("s"), F.col("h.suffix").eqNullSafe(F.col("s.suffix"))).select("h.host", "h.suffix", "h.h", "s.s")
    joined = scored.alias("r").join(both.alias("b"), F.col("r.host").eqNullSafe(F.col("b.host")) & F.col("r.suffix").eqNullSafe(F.col("b.suffix")))
    minus = lambda c: F.zip_with(F.col(c), own, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    by_suffix = F.when(F.col("r.suffix").isNull(), common).otherwise(smooth(minus("s"), common))
    prior = F.when(F.col("r.host").isNull(), by_suffix).otherwise(smooth(minus("h"), by_suffix))
    evidence = F.when(F.col("declared").isNull(), none).otherwise(F.element_at(likely, F.col("declared")))
    logs = F.zip_with(F.zip_with("scores", evidence, lambda a, b: a + b), prior, lambda a, p: a + F.log(p))
    top = joined.select("r.id", "best", "evidence", logs.alias("logs")).withColumn("top", F.array_max("logs"))
    p = 1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    names = F.array(*[F.lit(x) for x in languages])
    return top.select(
        F.col("id").alias(id_col), F.element_at(names, F.array_position("logs", F.col("top")).cast("int")).alias("lang"), p.alias("probability"),
        F.element_at(names, F.col("best") + 1).alias("text_lang"), "evidence",
    )


def page_evidence(html: str, url: str) -> tuple[Column, Column, Column, Column]:
    """Visible text, declared language, host and address suffix of raw pages."""
    page, address = F.col(html), F.col(url)
    text = F.regexp_replace(F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    declared = F.regexp_extract(page, r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+(?:[-_][A-Za-z0-9]+)*)", 1)
    host = F.regexp_extract(address, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    host = F.when(host != "", host)
    return text, F.when(declared != "", declared), host, F.regexp_extract(host, r"([^.]+)$", 1)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of all ``pages``, with the model trained on all ``documents``."""
    model = train(read_table(spark, sf_dir, "documents"))
    return identify(read_table(spark, sf_dir, "pages"), model, "page_id", *page_evidence("html", "url"))


def identify_documents(docs: DataFrame) -> DataFrame:
    """``identify`` for documents: ``lang`` is the declaration, ``source`` the host, and the model is trained on their declarations."""
    return identify(docs, train(docs), "doc_id", F.col("text"), F.col("lang"), F.col("source"), F.lit(None).cast("string"))
