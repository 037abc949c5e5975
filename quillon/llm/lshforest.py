"""Near-duplicate documents by an LSH forest of MinHash signatures, confirmed on full shingle sets.

Each tree reads the signature's values in an order of its own.  All labels of all trees are range-sorted, so that a
subtree is a run of neighbours with a long enough common prefix; a run keeps the least depth at which it is thin
enough, so depth adapts to the region.  Where a run goes over the bounds of sorted partitions, only its counts at
the bounds are put together.  Neighbours in a region whose signatures agree well enough are joined into families;
each family's full shingle sets meet, and every link between them is found exactly.  A region or family too large
for a task is dealt out into parts, and each pair of parts is a task, so that nothing is capped.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_split, materialize, read_table, runs
from .components import components

#: Depths of the trees: values that a region's documents share at least.  At a similarity of exactly 0.8 all trees
#: miss a pair with a chance of 1e-10 at the first depth, 5e-8 at the second and 3e-6 at the third.
TREES, DEPTHS = 32, (3, 4, 5)
#: Documents that may share a prefix of the first and second depth before the next depth is asked for.
DENSE = (256, 2048)
#: Documents, and shingles, that meet in one task at most, about.
PART, PART_SHINGLES = 2048, 2_000_000
#: Values of a signature.  Each tree begins with five of its own choice; all are compared.
VALUES = 128
#: Part of the signatures' values that agree, below which neighbours aren't candidates.  At a similarity of 0.8
#: it is 5.7 standard deviations away.
AGREE = 0.6
FORGET = 100_000

_rng = np.random.default_rng(20240229)
FACTORS = _rng.integers(0, 2**63, size=VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The order in which each tree reads the values, down to the last depth; trees share values as little as can be.
ORDERS = np.concatenate([_rng.permutation(VALUES) for _ in range(-(-TREES * DEPTHS[-1] // VALUES))])[: TREES * DEPTHS[-1]].reshape(TREES, -1)


class Shingler:
    """64-bit hashes of a text's distinct word shingles, sorted."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def __call__(self, text: str | bytes | None) -> np.ndarray:
        raw = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text) or b""
        tokens, known = raw.lower().split(), self.known
        if not tokens:
            return np.zeros(0, dtype=np.uint64)
        if len(known) > FORGET:
            known.clear()
        for t in set(tokens).difference(known):
            known[t] = xxhash.xxh3_64_intdigest(t)
        h = np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
        size = min(self.words, len(h))
        out = np.full(len(h) - size + 1, np.uint64(size))
        for k in range(size):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : k + len(out)]
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return np.unique(out ^ (out >> np.uint64(31)))


def signature(shingles: np.ndarray) -> bytes:
    """16 bits of each of VALUES minimum hashes, big-endian so that byte order is value order."""
    low = np.full(VALUES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 1024):
        np.minimum(low, (shingles[i : i + 1024, None] * FACTORS[None, :]).min(axis=0), out=low)
    return ((low >> np.uint64(20)) & np.uint64(0xFFFF)).astype(">u2").tobytes()


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            sizes, digests, signatures = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                s = shingler(text)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                signatures.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())], names=["id", "n", "digest", "signature"])

    return run


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document and tree: the tree and its first three values, the next two, the id."""
    trees = np.arange(TREES, dtype=np.int64)
    for batch in batches:
        for start in range(0, batch.num_rows, 2048):
            part = batch.slice(start, 2048)
            v = np.frombuffer(b"".join(part.column("signature").to_pylist()), dtype=">u2").reshape(-1, VALUES).astype(np.int64)[:, ORDERS]
            head = (trees << 48) | (v[:, :, 0] << 32) | (v[:, :, 1] << 16) | v[:, :, 2]
            rest = (v[:, :, 3] << 16) | v[:, :, 4]
            yield pa.RecordBatch.from_arrays([pa.array(head.ravel()), pa.array(rest.ravel()), pa.array(np.repeat(part.column("id").to_numpy(), TREES))], names=["head", "rest", "id"])


def common_prefixes(head: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """How many of the five values each label but the first shares with the one before (0 if it shares fewer than three)."""
    same = rest[1:] ^ rest[:-1]
    return np.where(head[1:] != head[:-1], 0, np.where(same == 0, 5, np.where(same >> 16 == 0, 4, 3)))


def subtrees(head: np.ndarray, rest: np.ndarray, opens: bool, closes: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each depth, every label's subtree, its labels here, and whether it may go on outside.

    :param opens: whether the first label may have neighbours before it
    :param closes: whether the last one may have neighbours after it
    """
    lcp, out = common_prefixes(head, rest), []
    names = (_mixed(head.astype(np.uint64)), _mixed(_mixed(head.astype(np.uint64)) + (rest >> 16).astype(np.uint64) + np.uint64(1)), _mixed(_mixed(head.astype(np.uint64) + np.uint64(1 << 60)) + rest.astype(np.uint64)))
    for depth, name in zip(DEPTHS, names, strict=True):
        run = np.r_[0, np.cumsum(lcp < depth)]
        count = np.bincount(run)
        outside = np.zeros(len(count), dtype=bool)
        outside[0] |= opens
        outside[-1] |= closes
        out.append((name.view(np.int64), count[run], outside[run]))
    return out


LEAVES = pa.schema([("id", pa.int64()), ("task", pa.int64()), *((f"{c}{d}", t) for d in DEPTHS for c, t in (("key", pa.int64()), ("count", pa.int64()), ("outside", pa.bool_())))])


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted partition: the labels that have neighbours, or may have them in the next partition.

    Labels are taken up to where the first three values change last, so that no subtree is cut here.
    """
    task, first = random.SystemRandom().getrandbits(62), True
    held = [np.zeros(0, dtype=np.int64)] * 3

    def out(columns, opens, closes):
        levels = subtrees(*columns[:2], opens, closes)
        some = (levels[0][1] > 1) | levels[0][2]
        return pa.RecordBatch.from_arrays([pa.array(columns[2][some]), pa.array([task] * int(some.sum()), pa.int64()), *(pa.array(c[some]) for level in levels for c in level)], schema=LEAVES)

    for batch in batches:
        held = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("head", "rest", "id"), strict=True)]
        cut = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0
        if cut:
            yield out([h[:cut] for h in held], first, False)
            held, first = [h[cut:] for h in held], False
    if len(held[0]):
        yield out(held, first, True)


def forest_regions(classes: DataFrame) -> DataFrame:
    """``id``, ``key``, ``rows``: the region of each document in each tree, where the region has other documents."""
    order = ("head", "rest", "id")
    labels = classes.select("id", "signature").mapInArrow(_labels, "head long, rest long, id long")
    kind = "id long, task long, " + ", ".join(f"key{d} long, count{d} long, outside{d} boolean" for d in DEPTHS)
    rows = materialize(labels.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_subtrees, kind), "subtrees")
    for d in DEPTHS:  # the first and the last subtree of each partition: two rows a partition, so they can be broadcast
        pieces = rows.where(f"outside{d}").select("task", f"key{d}", f"count{d}").distinct()
        whole = pieces.groupBy(f"key{d}").agg(F.sum(f"count{d}").alias("whole"))
        rows = rows.join(F.broadcast(whole), f"key{d}", "left").withColumn(f"count{d}", F.coalesce("whole", f"count{d}")).drop("whole")
    level = F.when(F.col(f"count{DEPTHS[0]}") <= DENSE[0], 0).when(F.col(f"count{DEPTHS[1]}") <= DENSE[1], 1).otherwise(2)
    pick = lambda c: F.when(level == 0, F.col(f"{c}{DEPTHS[0]}")).when(level == 1, F.col(f"{c}{DEPTHS[1]}")).otherwise(F.col(f"{c}{DEPTHS[2]}"))
    return materialize(rows.select("id", pick("key").alias("key"), pick("count").alias("rows")).where("rows > 1"), "regions")


def spanning(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links that connect what the relation connects; ``linked(i, others)`` says which of the others i is linked with."""
    left = np.arange(n)
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = linked(i, left)
            new = left[hit]
            left = left[~hit]
            queue.extend(new)
            for j in new:
                yield i, j


def _edges(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _neighbours(least: int):
    """Within each region: a spanning forest of the pairs whose signatures agree in at least ``least`` values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for region in runs(batches, "region"):
            if region.num_rows < 2:
                continue
            ids = region["id"].to_numpy()
            s = np.frombuffer(b"".join(region["signature"].to_pylist()), dtype=np.uint16).reshape(len(ids), VALUES)
            for i, j in spanning(len(ids), lambda i, others, s=s: (s[others] == s[i]).sum(axis=1) >= least):
                a.append(ids[i])
                b.append(ids[j])
            if len(a) > 50_000:
                yield _edges(a, b)
                a, b = [], []
        yield _edges(a, b)

    return run


def _confirm(words: int, percent: int):
    """Within each part of a family: a spanning forest of the exact links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, a, b = Shingler(words), [], []
        for part in runs(batches, "unit"):
            if part.num_rows < 2:
                continue
            ids, sets = part["id"].to_numpy(), [shingler(t) for t in part["text"].cast(pa.binary()).to_pylist()]
            sizes = np.array([len(s) for s in sets])
            _, place = np.unique(np.concatenate(sets), return_inverse=True)
            starts = np.cumsum(sizes) - sizes
            mark = np.zeros(place.max() + 1, dtype=np.int32)

            def linked(i, others, place=place, sizes=sizes, starts=starts, mark=mark):
                mine = place[starts[i] : starts[i] + sizes[i]]
                close = 100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])
                out = np.zeros(len(others), dtype=bool)
                some = others[close]
                if len(some):
                    mark[mine] = 1
                    if len(some) == len(sizes) - 1 or len(some) * 2 > len(sizes):
                        both = np.add.reduceat(mark[place], starts)[some]
                    else:
                        both = np.array([mark[place[starts[j] : starts[j] + sizes[j]]].sum() for j in some])
                    mark[mine] = 0
                    out[close] = 100 * both >= percent * (sizes[some] + sizes[i] - both)
                return out

            for i, j in spanning(len(ids), linked):
                a.append(ids[i])
                b.append(ids[j])
        yield _edges(a, b)

    return run


def _pairs_of_parts(parts: str, part: str) -> F.Column:
    """Every pair of parts that a row of this part takes part in."""
    others = F.sequence(F.lit(0).cast("long"), F.col(parts) - 1)
    return F.transform(others, lambda o: F.struct(F.least(o, F.col(part)).alias("i"), F.greatest(o, F.col(part)).alias("j")))


def _by_run(df: DataFrame, key: str, run, out: str) -> DataFrame:
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, key).sortWithinPartitions(key, "id").mapInArrow(run, out)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents linked by similar shingle sets.

    A text's set are its distinct shingles of ``words`` words, A-Z in lower case; a text with fewer words is one
    shingle; without words, or null, it is empty and linked with nothing.  Two documents are linked if
    100 * intersection >= percent * union.  Rows with a null id stay alone (component null, kept).  Rows that
    repeat an id stand for one document: its links are those of all its texts, all its rows have one component, and each
    row has its own text's ``n_shingles``.  Texts of any length are read whole.  An empty table gives no rows.  Other
    columns are not read, whatever their names.

    :return: id, ``n_shingles`` long, ``component_id`` (smallest id reachable), ``kept`` (id is component_id)
    """
    some = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    base = materialize(some.mapInArrow(_sign(words), "id long, n long, digest binary, signature binary"), "signatures")
    named = base.where("digest is not null and id is not null")
    classes = named.groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.count(F.lit(1)).alias("rows"))
    classes = materialize(classes, "classes")
    nothing = F.lit(b"")
    several = base.where("id is not null").groupBy("id").agg(F.min(F.coalesce("digest", nothing)).alias("x"), F.max(F.coalesce("digest", nothing)).alias("y")).where("x <> y")
    several = materialize(several.select("id"), "several")  # ids with different texts

    rows = forest_regions(classes)
    rows = rows.withColumn("parts", F.ceil(F.col("rows") / PART).cast("long")).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    rows = rows.withColumn("p", F.explode(_pairs_of_parts("parts", "part"))).select("id", F.xxhash64("key", "p.i", "p.j").alias("region"))
    regions = rows.join(classes.select("id", "signature"), "id")
    candidates = _by_run(regions, "region", _neighbours(int(np.ceil(AGREE * VALUES))), "a long, b long")
    families = materialize(components(candidates, "candidates"), "families")

    weights = families.join(classes.select("id", "n"), "id").groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    parts = weights.select("component", F.greatest(F.ceil(F.col("m") / PART), F.ceil(F.col("s") / PART_SHINGLES)).cast("long").alias("parts"))
    units = families.join(parts, "component").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    units = units.withColumn("p", F.explode(_pairs_of_parts("parts", "part"))).select("id", F.xxhash64("component", "p.i", "p.j").alias("unit"))
    members = materialize(units, "units")
    # members grow with the input, so they are never broadcast, however small here: one plan at every size
    wanted = members.hint("merge").join(some.where(F.col("id").isNotNull()), "id").select("id", "unit", "text")
    links = _by_run(wanted, "unit", _confirm(words, percent), "a long, b long")
    texts = named.select("id", "digest").join(several, "id")
    own = texts.join(classes.select("digest", F.col("id").alias("b")), "digest").select(F.col("id").alias("a"), "b")
    found = materialize(components(links.unionByName(own), "links"), "components")

    group = materialize(classes.select("id", "digest", "rows").join(found, "id", "left").select("digest", "rows", F.coalesce("component", "id").alias("component")), "groups")
    out = join_split(named.select("id", "n", "digest"), group, "digest", "rows").select("id", "n", "component")
    out = out.unionByName(base.where("digest is null or id is null").select("id", "n", F.col("id").alias("component")))
    whole = found.join(several, "id").withColumnRenamed("component", "whole")
    return out.join(whole, "id", "left").withColumn("component", F.coalesce("whole", "component")).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept")
    )


def op10_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Near duplicates among all ``documents`` on two-word shingles."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=2)


#: DuckDB's form of the query: every pair that shares a shingle, and reachability along links.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
