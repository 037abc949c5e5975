"""Toxicity by weak supervision.

Many voters look at every text: word lists by theme and language, patterns of use, and word and word-start patterns
learned from disjoint halves of the labelled rows, one voter for each kind of pattern and half.  A generative label
model explains the votes by a hidden class: each voter has an accuracy, and voters that go together beyond the class
are tied by correlation parameters (a forest of pairs, found from the votes), so that they don't count twice.  It is
fitted by expectation maximisation over the votes of all rows that may be learned from.  A linear classifier over all
words and word starts is then trained from zero on the posterior labels of a bounded sample, and scores
every text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, read_table

#: Word lists of the fixed voters.
LISTS = {
    "insults": "idiot idiots moron morons stupid dumb dumbass fool fools imbecile imbeciles retard retarded loser losers clown clowns jerk cretin halfwit dimwit",
    "contempt": "worthless useless pathetic pitiful subhuman degenerate degenerates parasite parasites nobody failure inferior",
    "disgust": "scum trash garbage vermin filth filthy disgusting rats cockroach cockroaches maggot maggots sewage stinking",
    "vulgar": "asshole bastard bitch whore slut cunt dick prick wanker twat shit shitty bullshit crap fuck fucking fucked",
    "threats": "kill hang shoot stab strangle exterminate lynch",
    "french": "idiote imbécile connard connasse salope merde pute crétin crétine abruti abrutie ordure débile",
    "german": "idioten dummkopf arschloch scheiße schlampe hure drecksau abschaum trottel vollidiot mistkerl",
    "spanish": "imbécil estúpido estúpida idiotas puta mierda cabrón basura escoria gilipollas tonto tonta",
}
THEMES = {name: frozenset(words.split()) for name, words in LISTS.items()}
#: Lengths of the word starts that serve as patterns; 0 is the whole word.
KINDS = (0, 4, 5, 6, 7, 8)
HALVES = 2
#: Digits and marks that stand for letters in disguised words.
DISGUISES = str.maketrans("013457@$", "oieastas")
ANY_OF = ".,;:!?\"'()[]{}<>*#$%&@=+-_/\\|~`"
YOU = frozenset("you your youre you're u tu toi vous du dich ihr eres".split())
VOTERS = (*THEMES, "several", "disguised", "addressed", "nothing", "stray", *(f"{'start_%d' % k if k else 'word'}_{h}" for k in KINDS for h in range(HALVES)))
M, FIRST_LEARNED = len(VOTERS), len(THEMES) + 5
SEVERAL, DISGUISED, ADDRESSED, NOTHING, STRAY = range(len(THEMES), len(THEMES) + 5)
LISTED = (1 << len(THEMES)) - 1
FORGET = 100_000


def words_of(text: str | None) -> list[str]:
    """A text's words in lower case, without marks at their ends."""
    return [w for w in [w.strip(ANY_OF) for w in (text or "").lower().split()] if w]


def units_of(word: str) -> list[tuple[int, str]]:
    """A word and its starts of so many characters, each with its kind."""
    return [(0, word)] + [(k, word[:k]) for k in KINDS[1:] if len(word) > k]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out():
        keys = list(seen)
        columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int32())]
        return pa.RecordBatch.from_arrays([*columns, pa.array([seen[k] if k[3] else 0 for k in keys], pa.int64()), pa.array([0 if k[3] else seen[k] for k in keys], pa.int64())], names=["kind", "unit", "half", "pos", "neg"])

    for batch in batches:
        for text, toxic, half in zip((t.as_py() for t in batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            units = {u for w in set(words_of(text)) for u in units_of(w)}
            seen.update((k, u, half, toxic) for k, u in units)
            if len(seen) > 200_000:
                yield out()
                seen.clear()
    yield out()


def likelihood_ratio(pos: Column, neg: Column, toxic: Column, clean: Column) -> Column:
    """The statistic of presence against class, from the counts of toxic and clean rows that have a unit, and of all."""
    rows, seen = toxic + clean, pos + neg
    cells = ((pos, seen, toxic), (neg, seen, clean), (toxic - pos, rows - seen, toxic), (clean - neg, rows - seen, clean))
    return sum((F.when(c > 1e-9, 2 * c * F.log(c * rows / (a * b))).otherwise(0.0) for c, a, b in cells), F.lit(0.0))


def learn_patterns(labelled: DataFrame, odds: float = 3.5, least: float = 12.0) -> tuple[dict[tuple[int, str], int], frozenset[str]]:
    """Units that go with the label in a half of the rows, each with the bits of the voters that look for it; and
    listed words that clean texts use as well, which no voter looks for.

    Only the units that pass go to the driver; their number is bounded by that of the labelled rows.

    :param labelled: ``text``, ``toxic`` 0 or 1, ``half``
    :param odds: a unit's log odds between toxic and clean rows, at least
    :param least: its likelihood-ratio statistic, at least
    """
    n = {(r["half"], r["toxic"]): r["n"] for r in labelled.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = labelled.select("text", "toxic", "half").mapInArrow(_tally, "kind int, unit string, half int, pos long, neg long").groupBy("kind", "unit", "half").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    per_half = lambda y: F.element_at(F.array(*[F.lit(n.get((h, y), 0)) for h in range(HALVES)]), F.col("half") + 1)
    log_odds = F.log((F.col("pos") + 0.5) / (per_half(1) + 1)) - F.log((F.col("neg") + 0.5) / (per_half(0) + 1))
    ratio = likelihood_ratio(F.col("pos"), F.col("neg"), per_half(1), per_half(0))
    listed = frozenset().union(*THEMES.values())
    is_listed, strong = (F.col("kind") == 0) & F.col("unit").isin(list(listed)), (F.col("odds") >= odds) & (F.col("ratio") >= least)
    counts = materialize(counts.withColumns({"odds": log_odds, "ratio": ratio}).where(strong | is_listed), "units")
    common = counts.where(is_listed).groupBy("unit").agg(F.sum("neg").alias("neg"), F.max("odds").alias("odds")).where("neg >= 3 and odds < 1").collect()
    patterns: dict[tuple[int, str], int] = {}
    for r in counts.where(strong).select("kind", "unit", "half").collect():
        key = (r["kind"], r["unit"])
        patterns[key] = patterns.get(key, 0) | 1 << (FIRST_LEARNED + KINDS.index(r["kind"]) * HALVES + r["half"])
    return patterns, frozenset(r["unit"] for r in common)


class Voters:
    """Votes on a text's words: 1 toxic, 0 not, 2 abstains; one byte for each voter."""

    def __init__(self, patterns: dict[tuple[int, str], int], common: frozenset[str]):
        self.known: dict[str, int] = {}
        self.listed = {w: sum(1 << i for i, words in enumerate(THEMES.values()) if w in words) for w in frozenset().union(*THEMES.values()) - common}
        kinds = {k: {u: b for (kind, u), b in patterns.items() if kind == k} for k in KINDS}
        self.whole, self.starts = kinds.pop(0), [(k, units) for k, units in kinds.items() if units]

    def bits(self, word: str) -> int:
        out = self.listed.get(word, 0) | self.whole.get(word, 0)
        if not word.isalpha():
            plain = word.translate(DISGUISES)
            if plain != word and plain in self.listed:
                out |= 1 << DISGUISED
        for k, units in self.starts:
            if len(word) > k:
                out |= units.get(word[:k], 0)
        return out

    def __call__(self, words: list[str], distinct: set[str]) -> bytes:
        """A listed word is enough for its list; a learned voter asks for two different words, and one alone is a stray."""
        known = self.known
        if len(known) > FORGET:
            known.clear()
        hits: dict[str, int] = {}
        for w in distinct:
            b = known.get(w)
            if b is None:
                b = known[w] = self.bits(w)
            if b:
                hits[w] = b
        votes = bytearray(b"\x02" * M)
        if any(b & LISTED for b in hits.values()) and any(w in YOU and hits.get(after, 0) & LISTED for w, after in zip(words, words[1:], strict=False)):
            votes[ADDRESSED] = 1
        once = twice = 0
        for b in hits.values():
            twice |= once & b
            once |= b
        for i in range(len(THEMES)):
            if once >> i & 1:
                votes[i] = 1
        for i in range(FIRST_LEARNED, M):
            if twice >> i & 1:
                votes[i] = 1
        if sum(1 for b in hits.values() if b & LISTED) > 1:
            votes[SEVERAL] = 1
        if once >> DISGUISED & 1:
            votes[DISGUISED] = 1
        if not hits:
            votes[NOTHING] = 0
        elif len(hits) == 1 and not once & LISTED:
            votes[STRAY] = 0
        return bytes(votes)


class LabelModel:
    """A hidden class, and for each voter how often it votes and how often it is then right.

    Abstaining says nothing about the class by itself.  ``parent[j]`` is the voter that j is tied to beyond the class
    (-1: none): how often j votes then depends on whether its parent does, and how often it is right on whether its parent
    is.  ``table[y, j, u, v]`` is the chance that j votes v if the class is y and its parent voted u.  The ties form a
    forest, so the likelihood is exact.
    """

    def __init__(self, voters: int, prior: float = 0.1, tie: float = 0.01):
        self.tie, self.base = tie, np.array([1 - prior, prior])
        self.parent = np.full(voters, -1)
        start = np.array([[0.45, 0.05, 0.5], [0.05, 0.45, 0.5]])  # voters are right nine times in ten
        self.table = np.broadcast_to(start[:, None, None, :], (2, voters, 3, 3)).copy()

    def log_joint(self, votes: np.ndarray) -> np.ndarray:
        """log P(class, votes) for each row of votes and both classes."""
        j = np.arange(votes.shape[1])
        above = np.where(self.parent >= 0, votes[:, self.parent], 0)
        return np.stack([np.log(self.base[y]) + np.log(self.table[y, j, above, votes]).sum(axis=1) for y in (0, 1)], axis=1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of the toxic class for each row of votes."""
        logs = self.log_joint(votes)
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))

    def statistics(self, votes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected counts of each pair of votes in each class: all that ``refit`` needs, and additive over rows."""
        m, p = votes.shape[1], self.posterior(votes)
        each = (votes[:, :, None] == np.arange(3)).reshape(len(votes), 3 * m).astype(float)
        return np.stack([(each * w[:, None]).T @ each for w in (counts * (1 - p), counts * p)])

    def refit(self, stats: np.ndarray, ties: bool) -> None:
        """Parameters from the expected counts; ``ties``: choose the forest anew, by mutual information given the class."""
        m = len(self.parent)
        n = stats.reshape(2, m, 3, m, 3).transpose(0, 1, 3, 2, 4)  # class, j, k, vote of j, vote of k
        size = np.maximum(stats[:, 0, 0] + stats[:, 1, 1] + stats[:, 2, 2], 1e-9)
        self.base = (size + 1) / (size + 1).sum()
        if ties:
            both = (n + 0.01) / (n + 0.01).sum(axis=(3, 4), keepdims=True)
            alone = both.sum(axis=4, keepdims=True) * both.sum(axis=3, keepdims=True)
            information = (self.base[:, None, None] * (both * np.log(both / alone)).sum(axis=(3, 4))).sum(axis=0)
            self.parent = forest(information, self.tie)
        for j, k in enumerate(self.parent):
            own = n[:, j, j][:, [0, 1, 2], [0, 1, 2]]
            mute, right = rates(own)
            for u in range(3):
                if k < 0:
                    mutes, rights = (mute, mute), (right, right)
                else:  # the parent votes or not; it is right, wrong or silent; one row's worth of the voter's own rates
                    silent = n[:, k, j, 2] if u == 2 else n[:, k, j, 0] + n[:, k, j, 1]
                    mutes = (rates(silent, mute, right)[0],) * 2
                    rights = [rates(np.stack([n[c, k, j, u if u == 2 or c == y else 1 - u] for c in (0, 1)]), mute, right)[1] for y in (0, 1)]
                for y in (0, 1):
                    self.table[y, j, u, 2] = mutes[y]
                    self.table[y, j, u, y] = (1 - mutes[y]) * rights[y]
                    self.table[y, j, u, 1 - y] = (1 - mutes[y]) * (1 - rights[y])

    def fit(self, expect: Callable[[LabelModel], np.ndarray], rounds: int = 20, ties_in: int = 2) -> LabelModel:
        """Expectation maximisation.  The forest is chosen in the first ``ties_in`` rounds, before voters that go together can win the class over."""
        for i in range(rounds):
            self.refit(expect(self), i < ties_in)
        return self

    def marginals(self) -> np.ndarray:
        """P(vote of j = v | class), by passing down the forest."""
        out, done = np.zeros(self.table.shape[:2] + (3,)), set()
        while len(done) < len(self.parent):
            for j, k in enumerate(self.parent):
                if j not in done and (k < 0 or k in done):
                    out[:, j] = self.table[:, j, 0] if k < 0 else np.einsum("yu,yuv->yv", out[:, k], self.table[:, j])
                    done.add(j)
        return out

    def accuracies(self) -> np.ndarray:
        """How often each voter is right when it votes."""
        p = self.marginals() * self.base[:, None, None]
        right = p[0, :, 0] + p[1, :, 1]
        return right / (right + p[0, :, 1] + p[1, :, 0])

    def correlations(self) -> dict[tuple[int, int], float]:
        """For each tie, the mutual information that the two voters share given the class."""
        p, out = self.marginals(), {}
        for j, k in enumerate(self.parent):
            if k >= 0:
                both = p[:, k, :, None] * self.table[:, j]
                out[int(k), j] = float((self.base * (both * np.log(both / (p[:, k, :, None] * p[:, j, None, :]))).sum(axis=(1, 2))).sum())
        return out


def rates(votes: np.ndarray, mute: float = 0.5, right: float = 0.9) -> tuple[float, float]:
    """How often a voter abstains, and is right when it votes, from expected votes by class, and one row's worth of what was known before."""
    hits, all_votes = votes[0, 0] + votes[1, 1], votes[:, :2].sum()
    return float((votes[:, 2].sum() + mute) / (votes.sum() + 1)), float((hits + right) / (all_votes + 1))


def forest(weights: np.ndarray, least: float) -> np.ndarray:
    """Parents in the heaviest forest whose edges all weigh ``least`` or more (-1: a root); ties go to smaller numbers."""
    m = len(weights)
    parent, joined = np.full(m, -1), np.zeros(m, dtype=bool)
    best, via = np.full(m, -np.inf), np.full(m, -1)
    for _ in range(m):
        free = np.flatnonzero(~joined)
        j = free[np.argmax(best[free])]
        if best[j] >= least:
            parent[j] = via[j]
        joined[j] = True
        closer = ~joined & (weights[j] > best)
        best[closer], via[closer] = weights[j][closer], j
    return parent


def _expectations(patterns: DataFrame) -> Callable[[LabelModel], np.ndarray]:
    """Expected counts over a table of votes and their numbers: one small array comes from each of its partitions."""

    def expect(model: LabelModel) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, 3 * M, 3 * M))
            for batch in batches:
                votes = np.frombuffer(b"".join(batch.column("votes").to_pylist()), dtype=np.uint8).reshape(-1, M).astype(np.int64)
                total += model.statistics(votes, batch.column("n").to_numpy().astype(float))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["stats"])

        return sum((np.frombuffer(r["stats"]) for r in patterns.mapInArrow(run, "stats binary").collect()), np.zeros(2 * (3 * M) ** 2)).reshape(2, 3 * M, 3 * M)

    return expect


def features_of(distinct: set[str]) -> list[str]:
    """A text's features: each word and word start, with its kind before it."""
    return list({f"{k}{u}" for w in distinct for k, u in units_of(w)})


class Linear:
    """The linear classifier: the sum of its features' weights in a text, each once, and a constant."""

    def __init__(self, features: list[str], weights: np.ndarray, constant: float):
        self.weights, self.constant, self.known = weights.tolist(), constant, {}
        self.kinds = [(k, found) for k in KINDS if (found := {f[1:]: i for i, f in enumerate(features) if f[0] == str(k)})]

    def places(self, word: str) -> tuple[int, ...]:
        out = [found.get(word[:k] if k else word, -1) for k, found in self.kinds if len(word) > k]
        return tuple(i for i in out if i >= 0)

    def __call__(self, distinct: set[str]) -> float:
        known, seen = self.known, set()
        if len(known) > FORGET:
            known.clear()
        for w in distinct:
            f = known.get(w)
            if f is None:
                f = known[w] = self.places(w)
            if f:
                seen.update(f)
        return self.constant + sum(self.weights[i] for i in sorted(seen))


def telling(examples: DataFrame, least: float = 10.0) -> list[str]:
    """Features whose presence goes with the posterior label: a likelihood-ratio statistic of ``least`` or more.

    Counted by aggregation; the few that pass go to the driver, their number is bounded by that of the examples.
    """
    n, toxic = examples.agg(F.count(F.lit(1)), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    counts = examples.select(F.explode("features").alias("f"), "target").groupBy("f").agg(F.sum("target").alias("pos"), F.sum(1 - F.col("target")).alias("neg"))
    return sorted(r["f"] for r in counts.where(likelihood_ratio(F.col("pos"), F.col("neg"), F.lit(toxic), F.lit(n - toxic)) >= least).select("f").collect())


def fit_linear(flat: np.ndarray, lengths: np.ndarray, target: np.ndarray, size: int, steps: int = 400, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression from zero on the presence of features, by gradient steps with per-weight scales.

    :param flat: features of all rows, one after the other, as numbers below ``size``
    """
    owner = np.repeat(np.arange(len(lengths)), lengths)
    w, b, g2, gb2 = np.zeros(size), 0.0, np.full(size, 1e-8), 1e-8
    for _ in range(steps if len(lengths) else 0):
        z = b + np.bincount(owner, weights=w[flat], minlength=len(lengths))
        d = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) / len(lengths)
        g = np.bincount(flat, weights=d[owner], minlength=size) + decay * w
        g2 += g * g
        gb2 += d.sum() ** 2
        w -= 0.3 * g / np.sqrt(g2)
        b -= 0.3 * d.sum() / np.sqrt(gb2)
    return w, b


def score(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", own_col: str | None = None, sample: int = 20_000) -> DataFrame:
    """Score every whole text.

    Rows with ``held_out`` true are scored but never learned from.  Null texts count as empty; empty texts get the
    classifier's constant.  Labels may be null, repeat or lack rows; without labels of both kinds the fixed lists and
    patterns alone vote.  Repeated rows and null ids are rows like others; texts of any length are read whole; an empty
    table gives no rows.  Only the id, the text, ``own_col`` and what ``held_out`` names are read, so extra columns
    don't matter, whatever their names.

    :param own_col: a column to carry along instead of the id
    :param labels: id, ``toxic``; at most ``sample`` of the rows not held out are read, those with the least hash of the id
    :param sample: also about how many rows with posterior labels the classifier is trained on; votes, accuracies and
        correlations are counted over all rows
    :return: id, held_out, score, predicted, ``posterior`` of the label model
    """
    spark = docs.sparkSession
    own_col = own_col or id_col
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(own_col).alias("own"))
    train = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    train = train.withColumns({id_col: F.col("id")}).where(~F.coalesce(held_out, F.lit(False))).select("id", "toxic")
    train = train.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(sample)
    labelled = docs.where(~F.col("held_out")).join(F.broadcast(train), "id").select("text", "toxic", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(HALVES)).cast("int").alias("half"))
    voters = spark.sparkContext.broadcast(learn_patterns(materialize(labelled, "labelled")))
    carried = docs.schema["own"].dataType.simpleString()

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes_on = Voters(*voters.value)
        for batch in batches:
            words = (words_of(t.as_py()) for t in batch.column("text"))
            votes = [votes_on(w, set(w)) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column("held_out"), pa.array(votes, pa.binary())], names=["held_out", "votes"])

    voted = docs.select("held_out", "text").mapInArrow(vote, "held_out boolean, votes binary")
    patterns = voted.groupBy("held_out", "votes").agg(F.count(F.lit(1)).alias("n"))
    patterns = materialize(patterns, "votes").where(~F.col("held_out")).select("votes", "n")
    n = patterns.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    model = LabelModel(M).fit(_expectations(patterns))

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes_on = Voters(*voters.value)
        for batch in batches:
            found, votes = [], []
            for text in batch.column("text"):  # one text's words at a time
                words = words_of(text.as_py())
                distinct = set(words)
                found.append(features_of(distinct))
                votes.append(votes_on(words, distinct))
            votes = np.frombuffer(b"".join(votes), dtype=np.uint8).reshape(-1, M).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), pa.array(model.posterior(votes))], names=["features", "target"])

    share = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1 << 30)) < int(min(1.0, sample / max(n, 1)) * (1 << 30))
    some = materialize(docs.where(~F.col("held_out") & share).select("text").mapInArrow(examples, "features array<string>, target double"), "examples")
    used = telling(some)
    place = {f: i for i, f in enumerate(used)}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[place[f] for f in x.as_py() if f in place] for x in batch.column("features")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column("target")], names=["features", "target"])

    short = some.mapInArrow(numbered, "features array<int>, target double").limit(2 * sample).toArrow()
    chunks, none = short["features"].chunks, np.zeros(0, dtype=np.int64)
    flat, lengths = np.concatenate([none, *(c.flatten().to_numpy() for c in chunks)]).astype(np.int64), np.concatenate([none, *(np.diff(c.offsets.to_numpy()) for c in chunks)]).astype(np.int64)
    fitted = spark.sparkContext.broadcast((used, *fit_linear(flat, lengths, short["target"].to_numpy(), len(used))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes_on, linear = Voters(*voters.value), Linear(*fitted.value)
        for batch in batches:
            z, votes = [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                distinct = set(words)
                z.append(linear(distinct))
                votes.append(votes_on(words, distinct))
            p = 1 / (1 + np.exp(-np.clip(np.array(z, dtype=float), -50, 50)))
            votes = np.frombuffer(b"".join(votes), dtype=np.uint8).reshape(-1, M).astype(np.int64)
            columns = [batch.column("own"), batch.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32)), pa.array(model.posterior(votes), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "held_out", "score", "predicted", "posterior"])

    out = docs.select("own", "held_out", "text").mapInArrow(run, f"id {carried}, held_out boolean, score double, predicted int, posterior double")
    return out.withColumnRenamed("id", own_col)


def held_out_fifth(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """All ``documents``, learning from ``labels`` of rows whose crc32 of the id is not divisible by 5."""
    return score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), held_out_fifth())
