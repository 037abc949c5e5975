"""Token counts under a unigram vocabulary, without the tokens: count-only Viterbi.

Aho-Corasick enumerates the vocabulary's matches; for each position the dynamic programme carries the best
score and the number of pieces on the path that has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table
from .lattice import REMEMBERED, Matcher
from .normaliser import Normaliser
from .spm import NORMAL, load

#: Where the query finds its vocabulary; a parameter everywhere else.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: What the tokenizer takes off the least score for a character outside the vocabulary (fixed value).
UNKNOWN_PENALTY = 10.0


class Counter:
    """Number of pieces of the best segmentation.

    The tokenizer's tie rule: of paths to a position with equal scores, the one whose last piece starts
    earliest.  A character without a piece of its own costs the least score less ``UNKNOWN_PENALTY`` and
    counts as its UTF-8 bytes if the vocabulary has byte pieces, else as one piece.  Scores are summed in
    double precision within a unit; sums of the vocabulary's whole-number scores are exact, where a
    single-precision tokenizer starts to round once a text's total passes 2**24.
    """

    def __init__(self, data: bytes):
        self.model = load(data)
        self.match, self.normalise = Matcher(self.model), Normaliser(self.model)
        self.unknown = min(s for s, k in zip(self.model.scores, self.model.kinds, strict=True) if k == NORMAL) - UNKNOWN_PENALTY
        self.bytes = bool(self.model.byte_ids())
        self.known: dict[str, int] = {}
        self.automaton = self.match.compile(lambda piece, ident: (len(piece) - 1, self.model.scores[ident]))

    def unit(self, unit: str) -> int:
        score, n, scores = [0.0], [0], self.model.scores
        if self.match.singles.issuperset(unit):
            # matches come by end and, at one end, longest first: a strict comparison keeps the earliest start
            at, best, count = 0, float("-inf"), 0
            for end, (back, own) in self.automaton.iter(unit):
                if end != at:
                    score.append(best)
                    n.append(count)
                    at, best = end, float("-inf")
                start = end - back
                s = score[start] + own
                if s > best:
                    best, count = s, n[start] + 1
            return count
        for end, matches in self.match.ends(unit):
            best, count = float("-inf"), 0
            for length, ident in matches:
                s = score[end - length] + scores[ident]
                if s > best:
                    best, count = s, n[end - length] + 1
            char = unit[end - 1]
            if char not in self.match.singles and score[end - 1] + self.unknown > best:
                best = score[end - 1] + self.unknown
                count = n[end - 1] + (len(char.encode("utf-8", "surrogatepass")) if self.bytes else 1)
            score.append(best)
            n.append(count)
        return n[-1]

    def __call__(self, text: str | None) -> int:
        total, known = 0, self.known
        for unit in self.match.units(self.normalise(text or "")):
            n = known.get(unit)
            if n is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                n = known[unit] = self.unit(unit)
            total += n
        return total


_COUNTERS: dict[int, Counter] = {}


def counter_of(data: bytes) -> Counter:
    """The worker's counter for a vocabulary, compiled once."""
    key = hash(data)
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(data)
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, vocabulary: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: id, ``n_tokens`` long.

    Null and empty texts have none; texts of any length are counted whole, unit by unit.  Repeated rows and null ids
    are rows like others; an empty table gives none.  Other columns are not read, whatever their names.  The vocabulary (a model file's bytes) is broadcast; its size is that of the file.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter_of(shared.value)
        for batch in batches:
            n = pa.array([count(t.as_py()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], names=["id", "n_tokens"])

    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = some.mapInArrow(run, f"id {some.schema['id'].dataType.simpleString()}, n_tokens long")
    return out.withColumnRenamed("id", id_col)


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all ``documents`` under the public 32k vocabulary, its pieces' scores taken as unigram scores."""
    with open(VOCABULARY, "rb") as f:
        data = f.read()
    return count_tokens(read_table(spark, sf_dir, "documents"), data)
