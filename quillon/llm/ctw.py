"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; each decision node has its own tree of byte contexts down to ``order``
bytes, with a Krichevsky-Trofimov estimate in every context.  A context's weighted probability is half its
own estimate plus half the product of its children's, which mixes all depths; from the trained tree the
probability of a byte after its context follows for every context that occurs anywhere in the input.

Text is held in blocks of bounded size.  A block sends its distinct byte strings out, packed by a hash of their
context but for its farthest byte; such a shard adds up the counts of all blocks and holds the deepest contexts.
The levels above are tables of decision nodes, and a parent is a grouped sum over its children, so estimates go up
by aggregations and come down by joins.  Each block gets back the probabilities of just its own strings.
"""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, read_table, runs

#: Ends a text and stands before it; no UTF-8 text has it.
EDGE = b"\xff"
#: Bytes of text that are coded at once, to bound memory.
CHUNK = 1 << 20
#: Shards of byte strings: so many for each block, within bounds that keep packed rows long and shards small.
SHARDS, FEWEST_SHARDS, MOST_SHARDS = 4, 64, 1 << 14
LOG2 = math.log(2.0)
ZSTD = zstandard.ZstdCompressor(level=1)


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0, by Stirling's series after a shift by 8."""
    y = x + 8.0
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    z = 1.0 / (y * y)
    tail = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + tail - shift


def log_kt(ones: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Log of the block probability that the estimator gives ``ones`` ones in ``total`` bits."""
    return lgamma(ones + 0.5) + lgamma(total - ones + 0.5) - lgamma(total + 1.0) - math.log(math.pi)


def codes_of(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The code of every byte of the texts and their ends, and where each text's codes begin.

    A code is the context, nearest byte first, then the byte itself.
    """
    raw = np.frombuffer(b"".join(EDGE * order + t + EDGE for t in texts), dtype=np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    first = np.cumsum(lengths + order) - lengths - order
    inside = np.ones(len(raw), dtype=bool)
    inside[(first[:, None] + np.arange(order)).ravel()] = False
    code = np.zeros(len(raw) - order, dtype=np.uint64)
    eight = np.uint64(8)
    for d in range(1, order + 1):
        code <<= eight
        code |= raw[order - d : len(raw) - d]
    code <<= eight
    code |= raw[order:]
    return code[inside[order:]], np.cumsum(lengths) - lengths


def chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in runs of about CHUNK bytes, each with its first index."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, texts[start:]


def merge_counts(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(where, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)


def lowered(texts: pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes with A-Z in lower case; a null text is an empty one."""
    return [(t or b"").lower() for t in texts.cast(pa.binary()).to_pylist()]


def squeeze(values: np.ndarray) -> bytes:
    """Eight-byte values compressed, their first bytes first, then their second bytes, and so on."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def expand(data: bytes, size: int, kind: type = np.int64) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, 8 * size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(kind).ravel()


def pack(values: np.ndarray) -> bytes:
    """Sorted integers as compressed differences."""
    return squeeze(np.diff(values.astype(np.int64), prepend=0))


def unpack(data: bytes, size: int) -> np.ndarray:
    return np.cumsum(expand(data, size))


def pack_words(words: list[bytes]) -> bytes:
    return ZSTD.compress(b" ".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    return zstandard.decompress(data).split(b" ")


def shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each code: a hash of its context but for the farthest byte."""
    h = (codes >> np.uint64(16)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(shards)).astype(np.int64)


def _hold(block_bytes: int):
    """Deals out a task's rows into blocks of about ``block_bytes``; a block's number is drawn once, when it is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = random.SystemRandom()
        block, size = draw.getrandbits(62), 0
        for batch in batches:
            numbers = []
            for n in batch.column("size").to_pylist():
                if size and size + n > block_bytes:
                    block, size = draw.getrandbits(62), 0
                size += n
                numbers.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *batch.columns[:3]], names=["block", "id", "text", "held_out"])

    return run


PART = pa.schema([("words", pa.bool_()), ("block", pa.int64()), ("shard", pa.int64()), ("size", pa.int64()), ("codes", pa.binary()), ("counts", pa.binary())])
PARTS = "words boolean, block long, shard long, size long, codes binary, counts binary"


def _gather(order: int, shards: int):
    """Each block's distinct codes and words, packed by shard, with their counts in training texts (0 for those only held out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "block"):
            texts, held = lowered(table["text"]), table["held_out"].to_pylist()
            words: Counter = Counter()
            others: set = set()
            keys, counts = [], []
            for t, h in zip(texts, held, strict=True):
                others.update(t.split()) if h else words.update(t.split())
            for wanted in (False, True):
                part = [t for t, h in zip(texts, held, strict=True) if h == wanted]
                for _, run_of in chunks(part):
                    k, n = np.unique(codes_of(run_of, order)[0], return_counts=True)
                    keys.append(k)
                    counts.append(np.zeros_like(n) if wanted else n)
                    if len(keys) > 8:
                        k, n = merge_counts(keys, counts)
                        keys, counts = [k], [n]
            code, n = merge_counts(keys, counts)
            others.difference_update(words)
            block = table["block"][0].as_py()
            where = shard_of(code, shards)
            by = np.argsort(where, kind="stable")
            cuts = np.flatnonzero(np.diff(where[by], prepend=-1))
            rows = []
            for at in np.split(by, cuts[1:]) if len(by) else []:
                rows.append((False, block, int(where[at[0]]), len(at), pack(code[at]), squeeze(n[at])))
            dealt: dict[int, list[bytes]] = {}
            for w in (*words, *others):
                dealt.setdefault(zlib.crc32(w) % shards, []).append(w)
            for k, some in dealt.items():
                rows.append((True, block, k, len(some), pack_words(some), squeeze(np.array([words[w] for w in some], dtype=np.int64))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), PART, strict=True)], schema=PART)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each shard's codes with their counts over all blocks; rows come sorted by shard, a few at a time are held."""
    shard, keys, counts, held = None, [], [], 0

    def out():
        code, n = merge_counts(keys, counts)
        return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([len(code)]), pa.array([pack(code)]), pa.array([squeeze(n)])], names=["shard", "size", "codes", "counts"])

    for batch in batches:
        for at, size, codes, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "size", "codes", "counts")), strict=True):
            if at != shard:
                if keys:
                    yield out()
                shard, keys, counts, held = at, [], [], 0
            keys.append(unpack(codes, size).astype(np.uint64))
            counts.append(expand(n, size))
            held += size
            if held > 2 * len(keys[0]) + CHUNK:
                k, n = merge_counts(keys, counts)
                keys, counts, held = [k], [n], 0
    if keys:
        yield out()


def _merge_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each shard's words with their counts over all blocks, and those counts' sum and how many aren't 0."""
    shard, total = None, {}

    def out():
        n = np.array(list(total.values()), dtype=np.int64)
        columns = [pa.array([x], t) for x, t in ((shard, pa.int64()), (len(n), pa.int64()), (pack_words(list(total)), pa.binary()), (squeeze(n), pa.binary()), (int(n.sum()), pa.int64()), (int((n > 0).sum()), pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "size", "codes", "counts", "sum", "types"])

    for batch in batches:
        for at, size, words, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "size", "codes", "counts")), strict=True):
            if at != shard:
                if total:
                    yield out()
                shard, total = at, {}
            for w, c in zip(unpack_words(words), expand(n, size).tolist(), strict=True):
                total[w] = total.get(w, 0) + c
    if total:
        yield out()


def _look_up_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's words of a shard with their counts over all blocks; a shard's totals (null block) come before the parts."""
    total: dict[bytes, int] = {}
    for batch in batches:
        rows = []
        for block, size, packed, n in zip(*(batch.column(c).to_pylist() for c in ("block", "size", "codes", "counts")), strict=True):
            words = unpack_words(packed)
            if block is None:
                total = dict(zip(words, expand(n, size).tolist(), strict=True))
            else:
                rows.append((True, block, size, packed, squeeze(np.fromiter(map(total.__getitem__, words), dtype=np.int64, count=size))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), FACT_TYPES, strict=True)], names=FACT_NAMES)


FACTS = "words boolean, block long, size long, codes binary, facts binary"
FACT_NAMES, FACT_TYPES = ["words", "block", "size", "codes", "facts"], (pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary())


def leaves(codes: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each bit of the byte, the deepest contexts' nodes: where each begins among the sorted codes, each code's node, totals and ones."""
    for j in range(8):
        prefix = codes >> np.uint64(8 - j)
        new = np.r_[True, prefix[1:] != prefix[:-1]] if len(codes) else np.zeros(0, dtype=bool)
        first = np.flatnonzero(new)
        bit = (codes >> np.uint64(7 - j)) & np.uint64(1)
        yield j, first, np.cumsum(new) - 1, np.add.reduceat(n, first).astype(float), np.add.reduceat(n * bit.astype(np.int64), first).astype(float)


def parent_keys(codes: np.ndarray, j: int) -> np.ndarray:
    """Each code's node for bit ``j`` one level above the deepest: the context but for its farthest byte, then 1 and the bits so far."""
    return ((codes >> np.uint64(16)) << np.uint64(8)) | np.uint64(1 << j) | ((codes & np.uint64(255)) >> np.uint64(8 - j))


def weigh(total: np.ndarray, ones: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of a node's own estimate, and of its weighted one, given the sum of its children's."""
    own = log_kt(ones, total)
    return own, np.logaddexp(own, split) - LOG2


NODE = "key long, total double, ones double, own double, weighted double"


def above_leaves(codes: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """The nodes one level above the deepest: key, total, ones, own, weighted."""
    parts = []
    for j, first, _, total, ones in leaves(codes, n):
        key, where = np.unique(parent_keys(codes[first], j), return_inverse=True)
        sums = [np.bincount(where, weights=x, minlength=len(key)) for x in (total, ones, log_kt(ones, total))]
        parts.append([key.astype(np.int64), *sums[:2], *weigh(*sums)])
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def _above_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, size, codes, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            nodes = above_leaves(unpack(codes, size).astype(np.uint64), expand(n, size))
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(nodes[0]), pa.int64()), *map(pa.array, nodes)], names=["shard", "key", "total", "ones", "own", "weighted"])


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, ones, split = (batch.column(c).to_numpy() for c in ("total", "ones", "split"))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, weigh(total, ones, split))], names=["key", "total", "ones", "own", "weighted"])


def level_up(nodes: DataFrame) -> DataFrame:
    """The nodes whose contexts are one byte shorter: sums over their children."""
    key = F.shiftleft(F.shiftright("key", 16), 8).bitwiseOR(F.col("key").bitwiseAND(F.lit(255)))
    sums = nodes.groupBy(key.alias("key")).agg(F.sum("total").alias("total"), F.sum("ones").alias("ones"), F.sum("weighted").alias("split"))
    return sums.mapInArrow(_weigh, NODE)


def mixed(keep, k, seen, a, b, f, choose):
    """A node's P = a + b * (below), and f if nothing below was seen, from those of its parent; an unseen node leaves it to the parent."""
    return choose(seen, a + b * keep * k, f), choose(seen, b * (1 - keep), 0.0 * b), choose(seen, a + b * k, f)


def top_levels(rows: list[tuple[int, float, float, float]]) -> list[tuple[int, float, float, float]]:
    """How depths 0 and 1 mix with what lies below: (key, a, b, f) for each node of depth 1, of which there are 65,280 at most.

    :param rows: key, total, ones, weighted of each node of depth 1
    """
    if not rows:
        return []
    key, total, ones, weighted = (np.array(c) for c in zip(*rows, strict=True))
    z = key.astype(np.int64) & 255
    t0, o0, split = (np.bincount(z, weights=x, minlength=256) for x in (total, ones, weighted))
    own0, w0 = weigh(t0, o0, split)
    root = mixed(np.exp(own0 - LOG2 - w0), (o0 + 0.5) / (t0 + 1), t0 > 0, 0.0 * t0, 0.0 * t0 + 1.0, 0.0 * t0 + 0.5, np.where)
    own1 = log_kt(ones, total)
    out = mixed(np.exp(own1 - LOG2 - weighted), (ones + 0.5) / (total + 1), total > 0, *(x[z] for x in root), np.where)
    return list(zip(key.tolist(), *(x.tolist() for x in out), strict=True))


def level_down(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """(key, a, b, f) of each node, from those of the level above; other columns stay."""
    up = F.shiftleft(F.shiftright("key", 16), 8).bitwiseOR(F.col("key").bitwiseAND(F.lit(255)))
    joined = nodes.withColumn("up", up).join(above.select(F.col("key").alias("up"), "a", "b", "f"), "up")
    keep, k = F.exp(F.col("own") - LOG2 - F.col("weighted")), (F.col("ones") + 0.5) / (F.col("total") + 1)
    a, b, f = mixed(keep, k, F.col("total") > 0, F.col("a"), F.col("b"), F.col("f"), lambda c, x, y: F.when(c, x).otherwise(y))
    return joined.select(*[c for c in nodes.columns if c not in ("total", "ones", "own", "weighted")], a.alias("a"), b.alias("b"), f.alias("f"))


def predict(codes: np.ndarray, n: np.ndarray, keys: np.ndarray, a: np.ndarray, b: np.ndarray, f: np.ndarray) -> np.ndarray:
    """log10 P(byte | context) of sorted codes with training counts, given the level above's ``keys`` and their a, b, f.

    A context never seen in training leaves the estimate to its parent.
    """
    order = np.argsort(keys)
    keys, a, b, f = keys[order], a[order], b[order], f[order]
    out = np.zeros(len(codes))
    for j, first, node, total, ones in leaves(codes, n):
        i = np.searchsorted(keys, parent_keys(codes[first], j).astype(np.int64))
        one = np.where(total > 0, a[i] + b[i] * (ones + 0.5) / (total + 1), f[i])[node]
        bit = (codes >> np.uint64(7 - j)) & np.uint64(1)
        out += np.log10(np.where(bit == 1, one, 1 - one))
    return out


MODEL = pa.schema([("shard", pa.int64()), ("size", pa.int64()), ("codes", pa.binary()), ("logp", pa.binary())])


def _predict(key: tuple, merged: pa.Table, above: pa.Table) -> pa.Table:
    """One shard: the log probabilities of its codes."""
    if not merged.num_rows:
        return MODEL.empty_table()
    (size,), (codes,), (n,) = (merged[c].to_pylist() for c in ("size", "codes", "counts"))
    counts = expand(n, size)
    logp = predict(unpack(codes, size).astype(np.uint64), counts, *(above[c].to_numpy() for c in ("key", "a", "b", "f")))
    return pa.table([merged["shard"], merged["size"], merged["codes"], pa.array([squeeze(logp)])], schema=MODEL)


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's part of a shard with its log probabilities; a shard's model (null block) comes before the parts."""
    codes = logp = None
    for batch in batches:
        rows = []
        for block, size, packed, values in zip(*(batch.column(c).to_pylist() for c in ("block", "size", "codes", "logp")), strict=True):
            own = unpack(packed, size)
            if block is None:
                codes, logp = own, expand(values, size, np.float64)
            else:
                rows.append((False, block, size, packed, squeeze(logp[np.searchsorted(codes, own)])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), FACT_TYPES, strict=True)], names=FACT_NAMES)


class Lookup:
    """Values by code: a table from the code's hash to its place, and a binary search for codes whose slot another one has."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.values = codes[order].astype(np.uint64), values[order]
        self.shift = np.uint64(64 - min(24, max(12, (4 * len(codes)).bit_length())))
        self.table = np.zeros(1 << (64 - int(self.shift)), dtype=np.int32)
        self.table[self._slot(self.codes)] = np.arange(len(codes), dtype=np.int32)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * self.FACTOR) >> self.shift).astype(np.int32)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        at = self.table[self._slot(codes)]
        odd = np.flatnonzero(self.codes[at] != codes)
        at[odd] = np.searchsorted(self.codes, codes[odd])
        return self.values[at]


def _score(order: int, train_tokens: int, train_types: int, ends: int):
    """One block: its texts and what came back about its words and codes; a row per text."""

    def run(key: tuple, texts: pa.Table, facts: pa.Table) -> pa.Table:
        count, codes, logps = {}, [], []
        for words, size, packed, values in zip(*(facts[c].to_pylist() for c in ("words", "size", "codes", "facts")), strict=True):
            if words:
                count.update(zip(unpack_words(packed), expand(values, size).tolist(), strict=True))
            else:
                codes.append(unpack(packed, size))
                logps.append(expand(values, size, np.float64))
        logp = Lookup(np.concatenate(codes), np.concatenate(logps))
        del codes, logps
        raw = lowered(texts["text"])
        n_tokens, n_known, base = [], [], []
        each = math.log10(train_tokens + train_types + 1)
        for t in raw:
            c = np.array([*map(count.__getitem__, t.split()), ends], dtype=float)
            n_tokens.append(len(c))
            n_known.append(int((c > 0).sum()))
            base.append(float(np.log10(c + 1).sum()) - len(c) * each)
        score = np.zeros(len(raw))
        for first, run_of in chunks(raw):
            code, starts = codes_of(run_of, order)
            score[first : first + len(run_of)] = np.add.reduceat(logp(code), starts)
        return pa.table(
            {
                "id": texts["id"], "held_out": texts["held_out"], "n_bytes": pa.array([len(t) for t in raw], pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array([train_tokens] * len(raw), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64()),
                "bits_per_byte": pa.array([-s / math.log10(2.0) / (len(t) + 1) for s, t in zip(score.tolist(), raw, strict=True)], pa.float64()),
            }
        )

    return run


def score(docs: DataFrame, held_out: Column, order: int = 5, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 1 << 24) -> DataFrame:
    """Score every text, learning from those for which ``held_out`` is false.

    Null texts count as empty; an empty text is just its end.  Repeated rows are scored, and learned from,
    like others.  A very long text is a block of its own, coded a megabyte at a time.  Without training texts every
    bit has probability 1/2.  An empty table gives no rows.  Only the id, the text and what ``held_out`` names are
    read, so extra columns don't matter, whatever their names.

    :param order: bytes of context, 2 to 7
    :param block_bytes: text that is scored at once; memory of a task is some ten times that
    :return: id, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score (add-one unigram), score, bits_per_byte;
        scores are log10 probabilities of the text, ``bits_per_byte`` the code length over the bytes and the end
    """
    if not 2 <= order <= 7:
        raise ValueError("order must be 2 to 7")
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    ident = docs.schema["id"].dataType.simpleString()
    sized = docs.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
    texts = materialize(sized.mapInArrow(_hold(block_bytes), f"block long, id {ident}, text string, held_out boolean"), "ctw-texts")
    blocks, n_train = texts.agg(F.count_distinct("block"), F.count_if(~F.col("held_out"))).first()
    shards = min(MOST_SHARDS, max(FEWEST_SHARDS, SHARDS * blocks))
    parts = materialize(texts.mapInArrow(_gather(order, shards), PARTS), "ctw-parts")

    # as many partitions as blocks, so that what a task reads doesn't grow with the input
    tasks, first = max(8, blocks), F.col("block").asc_nulls_first()
    words = parts.where("words").drop("words")
    totals = words.drop("block").repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(_merge_words, "shard long, size long, codes binary, counts binary, sum long, types long")
    totals = materialize(totals, "ctw-words")
    n_words, n_types = totals.agg(F.coalesce(F.sum("sum"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    asked = words.select("block", "shard", "size", "codes").unionByName(totals.select("shard", "size", "codes", "counts").withColumn("block", F.lit(None).cast("long")), allowMissingColumns=True)
    known = asked.repartition(tasks, "shard").sortWithinPartitions("shard", first).mapInArrow(_look_up_words, FACTS)

    packed = parts.where("not words").drop("words")
    by_shard = packed.drop("block").repartition(tasks, "shard").sortWithinPartitions("shard")
    merged = materialize(by_shard.mapInArrow(_merge, "shard long, size long, codes binary, counts binary"), "ctw-codes")
    levels = [materialize(merged.mapInArrow(_above_leaves, "shard long, " + NODE), "ctw-nodes")]
    for _ in range(order - 2):
        levels.append(materialize(level_up(levels[-1]), "ctw-nodes"))
    top = top_levels([tuple(r) for r in levels[-1].select("key", "total", "ones", "weighted").collect()])  # 65,280 nodes at most
    above = spark.createDataFrame(top, "key long, a double, b double, f double")
    if order == 2:
        above = levels[0].select("shard", "key").join(F.broadcast(above), "key")
    else:
        above = level_down(levels[-2], F.broadcast(above))
        for nodes in levels[-3::-1]:
            above = level_down(nodes, above.hint("merge"))
    model = materialize(merged.groupBy("shard").cogroup(above.groupBy("shard")).applyInArrow(_predict, "shard long, size long, codes binary, logp binary"), "ctw-model")

    wanted = packed.drop("counts").unionByName(model.withColumn("block", F.lit(None).cast("long")), allowMissingColumns=True)
    facts = wanted.repartition(tasks, "shard").sortWithinPartitions("shard", first).mapInArrow(_look_up, FACTS).unionByName(known)
    out = f"id {ident}, held_out boolean, n_bytes long, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    run = _score(order, n_words + n_train, n_types + (n_train > 0), n_train)
    texts, facts = texts.repartition(2 * tasks, "block"), facts.repartition(2 * tasks, "block")
    return texts.groupBy("block").cogroup(facts.groupBy("block")).applyInArrow(run, out).withColumnRenamed("id", id_col)


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """All of ``documents``, learning from those whose crc32 of the id is not 2 modulo 7."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    return score(docs, held_out)
