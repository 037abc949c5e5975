"""The ten operators: edge cases, and brute force on small fixtures."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import covertree, ctw, fst, langid, lattice, lshforest, media, mixing, sharding, spm, tokencount, toxicity

MODEL = open(tokencount.VOCABULARY, "rb").read()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "erin thato " * 20_000
#: Nulls, empty and long texts, repeated rows, ties; extra columns whose names the operators use inside.
MESSY = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "one", None, None, 3), (4, LONG, "en", "b", len(LONG)), (5, "x y z é\n▁ 🙂", "fr", "b", 9), (5, "x y z é\n▁ 🙂", "fr", "b", 9),
    (None, "no id here", "de", None, 10), (7, "x y z é\n▁ 🙂", "fr", "c", 9), (8, "   \t\n", "en", "c", 5), (9, "The The the", "en", "a", 11),
]


@pytest.fixture(scope="module")
def messy(spark):
    rows = spark.createDataFrame(MESSY, SCHEMA)
    return rows.withColumns({c: F.lit("clash") for c in ("id", "size", "node", "shard", "words", "digest", "votes", "key", "at", "__at", "component")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def text_of(t):
    return (t or "").encode()


# --- sharding ---


def test_difference_is_near_even():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1000, 400).tolist()
    sums, place = sharding.difference([[s, 0, 0] for s in sizes], 3)
    made = [sum(s for s, p in zip(sizes, place, strict=True) if p[0] == k) for k in range(3)]
    assert sorted(made) == sorted(sums) and max(made) - min(made) <= 2
    assert sharding.difference([], 3)[0] == [0, 0, 0]


def test_sharding(spark, messy, empty):
    out = sharding.shard(messy, 3).collect()
    assert len(out) == len(MESSY)
    for k in range(3):
        slots = sorted(r["slot"] for r in out if r["shard"] == k)
        assert slots == list(range(len(slots)))
    by_id = {}
    for r in out:
        by_id.setdefault(r["doc_id"], set()).add(r["shard"])
    assert by_id[5] == by_id[7]
    sizes = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in out}
    assert sizes[1] == (1, 0) and sizes[5] == (len(text_of(MESSY[4][1])) + 1, zlib.crc32(text_of(MESSY[4][1])))
    assert sharding.shard(empty).count() == 0


def test_sharding_levels(spark):
    groups = spark.range(900).select(F.col("id").cast("string").alias("node"), (F.col("id") % 97 + 1).alias("bytes"))
    out = sharding.partition_groups(groups, 8, fan_in=20).join(groups, "node").groupBy("shard").sum("bytes").collect()
    sums = [r[1] for r in out]
    assert len(sums) == 8 and max(sums) - min(sums) <= 0.02 * sum(sums) / 8


# --- mixing ---


def water(sizes, weights, cap=3):
    target, rest, free = {}, sum(sizes.values()), set(sizes)
    while free:
        level = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if level[s] >= cap * sizes[s]}
        if not over:
            return target | level
        for s in over:
            target[s] = cap * sizes[s]
            rest -= target[s]
        free -= over
    return target


def test_mixing(spark, messy, empty):
    out = mixing.plan(messy).collect()
    sizes = Counter()
    for _, t, _, s, _ in MESSY:
        sizes[s] += len(text_of(t).split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = water(dict(sizes), {s: i % 3 + 1 for i, s in enumerate(order)})
    taken = Counter()
    for r in out:
        assert abs(r["target"] - goal[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"] * r["rows"]
        assert all(0 <= p["fraction"] <= 1 for p in r["passes"])
    assert all(abs(taken[s] - goal[s]) <= 2 for s in goal)
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    mixed = mixing.mix(messy)
    assert mixed.columns == messy.columns
    again = [r["doc_id"] for r in mixed.collect()]
    assert again == [r["doc_id"] for r in mixing.mix(messy).collect()]


# --- media ---


def test_media(spark, messy, empty):
    out = media.media(messy).collect()
    assert len(out) == len(MESSY)
    for r, (_, t, *_rest) in ((r, m) for r in out for m in MESSY if m[0] == r["doc_id"] and m[0] is not None):
        payload, n = media.padded(t)
        assert (r["n_bytes"], r["payload_bytes"]) == (n, len(payload)) and len(payload) % 192 == 0
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        png = media.encode_png(payload)
        assert r["media_bytes"] == len(png) and r["media_sha256"] == hashlib.sha256(png).hexdigest() and media.decode_png(png) == payload
    assert media.media(empty).count() == 0


def test_tar_headers(spark, messy, tmp_path):
    import tarfile

    rows = media.write_payloads(messy, str(tmp_path))
    headers = media.read_headers(media.catalogue(rows), str(tmp_path)).collect()
    assert len(headers) == rows.select("digest").distinct().count() and all(h["width"] == 192 for h in headers)
    names = {m.name[:-4] for f in tmp_path.glob("*.tar") for m in tarfile.open(f)}
    assert names == {r["digest"] for r in rows.collect()}


# --- context-tree weighting ---


def brute_ctw(train, text, order):
    """The tree as a dictionary of (bits so far, context) -> counts, weighted from the leaves up."""
    edge = 255
    stats = {}

    def steps(t):
        seq = [edge] * order + list(t) + [edge]
        for i in range(order, len(seq)):
            ctx = tuple(seq[i - 1 : i - order - 1 if i > order else None : -1])[:order]
            for j in range(8):
                yield seq[i] >> (8 - j) | 1 << j, ctx, (seq[i] >> (7 - j)) & 1

    for t in train:
        for z, ctx, bit in steps(t):
            for d in range(order + 1):
                stats.setdefault((z, ctx[:d]), [0, 0])[bit] += 1
    kt = lambda c: math.lgamma(c[0] + 0.5) + math.lgamma(c[1] + 0.5) - math.lgamma(sum(c) + 1) - math.log(math.pi)
    children = {}
    for z, c in stats:
        if c:
            children.setdefault((z, c[:-1]), []).append((z, c))
    weighted = {}

    def pw(node):
        if node not in weighted:
            own = kt(stats[node])
            weighted[node] = own if len(node[1]) == order else np.logaddexp(own, sum(pw(c) for c in children.get(node, []))) - math.log(2)
        return weighted[node]

    total = 0.0
    for z, ctx, bit in steps(text):
        p = None
        for d in range(order, -1, -1):
            c = stats.get((z, ctx[:d]))
            if c is None:
                continue
            k = (c[bit] + 0.5) / (sum(c) + 1)
            keep = 1.0 if p is None else math.exp(kt(c) - math.log(2) - pw((z, ctx[:d])))
            p = keep * k + (1 - keep) * (p or 0.0)
        total += math.log10(0.5 if p is None else p)
    return total


def test_ctw(spark, messy, empty):
    rows = [m for m in MESSY if m[1] is not LONG]
    docs = spark.createDataFrame(rows, SCHEMA)
    held = F.col("doc_id").isin(7, 9)
    out = ctw.score(docs, held, order=3).collect()
    cut = ctw.score(docs, held, order=3, block_bytes=20).collect()
    key = lambda r: (str(r["doc_id"]), round(r["score"], 6))
    assert sorted(map(key, cut)) == sorted(map(key, out))
    train = [text_of(m[1]).lower() for m in rows if m[0] not in (7, 9)]
    counts = Counter(w for t in train for w in t.split())
    counts["\0"] = len(train)
    n, v = sum(counts.values()), len(counts)
    for r in out:
        t = text_of(next(m[1] for m in rows if m[0] == r["doc_id"])).lower()
        c = [counts[w] for w in t.split()] + [len(train)]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(c), sum(x > 0 for x in c), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((x + 1) / (n + v + 1)) for x in c), abs=1e-9)
        assert r["score"] == pytest.approx(brute_ctw(train, t, 3), abs=1e-6)
        assert r["bits_per_byte"] == pytest.approx(-r["score"] / math.log10(2) / (len(t) + 1))
    assert ctw.score(messy, held).count() == len(MESSY) and ctw.score(empty, held).count() == 0
    for order in (2, 5):
        for r in ctw.score(docs.where("doc_id in (3, 5, 7, 9)"), held, order=order).collect():
            train = [text_of(m[1]).lower() for m in rows if m[0] in (3, 5)]
            t = text_of(next(m[1] for m in rows if m[0] == r["doc_id"])).lower()
            assert r["score"] == pytest.approx(brute_ctw(train, t, order), abs=1e-6)
    untrained = ctw.score(docs, F.lit(True), order=2).first()
    assert untrained["score"] == pytest.approx((untrained["n_bytes"] + 1) * 8 * math.log10(0.5))


# --- toxicity ---


def fitted(votes, rounds=20):
    pats, n = np.unique(votes, axis=0, return_counts=True)
    return toxicity.LabelModel(votes.shape[1]).fit(lambda m: m.statistics(pats, n.astype(float)), rounds)


def test_label_model_finds_good_voters_and_ties():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    votes = np.stack([np.where(rng.random(4000) < a, y, ~y) for a in (0.95, 0.9, 0.85, 0.6)], axis=1).astype(int)
    votes[rng.random(votes.shape) < 0.1] = 2
    m = fitted(votes)
    assert ((m.posterior(votes) > 0.5) == y).mean() > 0.93
    assert np.allclose(m.accuracies(), (0.95, 0.9, 0.85, 0.6), atol=0.03)
    double = np.column_stack([votes, votes[:, 3], votes[:, 3]])  # two copies of the worst voter
    tied = fitted(double)
    strongest = sorted(tied.correlations(), key=tied.correlations().get)[-2:]
    assert all(set(t) <= {3, 4, 5} for t in strongest)
    assert np.abs(tied.posterior(double) - m.posterior(votes)).mean() < 0.02 and ((tied.posterior(double) > 0.5) == y).mean() > 0.93


def test_label_model_is_a_distribution_and_its_posterior_is_brute_force():
    """Every pattern of votes, its chance worked out voter by voter along the forest."""
    rng = np.random.default_rng(4)
    votes = rng.integers(0, 3, (300, 5))
    votes[:, 3] = np.where(rng.random(300) < 0.9, votes[:, 0], votes[:, 3])
    m = fitted(votes, 9)
    assert (m.parent >= 0).any()
    total = 0.0
    for pattern in np.ndindex(*[3] * 5):
        chance = []
        for y in (0, 1):
            p = m.base[y]
            for j, v in enumerate(pattern):
                p *= m.table[y, j, pattern[m.parent[j]] if m.parent[j] >= 0 else 0, v]
            chance.append(p)
        assert m.posterior(np.array([pattern]))[0] == pytest.approx(chance[1] / sum(chance))
        total += sum(chance)
    assert total == pytest.approx(1.0)


def test_forest_is_the_heaviest():
    w = np.zeros((5, 5))
    for a, b, x in ((0, 1, 3.0), (1, 2, 2.0), (0, 2, 2.5), (3, 4, 0.5)):
        w[a, b] = w[b, a] = x
    assert toxicity.forest(w, 1.0).tolist() == [-1, 0, 0, -1, -1] and toxicity.forest(w, 0.1)[4] == 3


def test_votes():
    votes = lambda t, patterns=(): dict(zip(toxicity.VOTERS, toxicity.Voters(dict(patterns), frozenset({"rats"}))(toxicity.words_of(t), set(toxicity.words_of(t))), strict=True))
    assert {k for k, v in votes("You moron!! What scum").items() if v == 1} == {"insults", "disgust", "several", "addressed"}
    assert votes("a m0ron")["disguised"] == 1 and votes("rats")["nothing"] == 0 and votes("")["nothing"] == 0
    bit = 1 << toxicity.VOTERS.index("start_4_1")
    assert votes("blargo", [((4, "blar"), bit)])["stray"] == 0 and votes("blargo blarga", [((4, "blar"), bit)])["start_4_1"] == 1


def test_linear_classifier_starts_from_zero_and_learns(spark):
    rng = np.random.default_rng(6)
    texts = [{f"w{i}" for i in rng.integers(100, 400, 20)} for _ in range(2000)]
    target = (rng.random(2000) < 0.2).astype(float)
    rows = [sorted(toxicity.features_of(x | {"blargo"} if t else x)) for x, t in zip(texts, target, strict=True)]
    used = toxicity.telling(spark.createDataFrame([(r, float(t)) for r, t in zip(rows, target, strict=True)], "features array<string>, target double"))
    assert {"0blargo", "4blar"} <= set(used) and len(used) < 12
    short = [np.array([used.index(f) for f in r if f in used], dtype=np.int64) for r in rows]
    w, b = toxicity.fit_linear(np.concatenate(short), np.array([len(r) for r in short]), target, len(used))
    score = toxicity.Linear(used, w, b)
    assert b < -1 and score({"blargo", "w101"}) > 2 and score({"w101", "w102"}) < -1
    assert score({"blargo"}) == pytest.approx(b + sum(w[used.index(f)] for f in toxicity.features_of({"blargo"}) if f in used))
    none = np.zeros(0, dtype=np.int64)
    assert toxicity.fit_linear(none, none, np.zeros(0), 0)[1] == 0


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.score(docs, labels, toxicity.held_out_fifth()).join(labels, "doc_id").toPandas()
    test = out[out["held_out"]]
    assert ((test["score"] >= 0.5) == test["predicted"]).all()
    assert (test["predicted"] == test["toxic"]).mean() > 0.9
    assert test[test["toxic"] == 0]["predicted"].mean() < 0.03


def test_toxicity_edges(spark, messy, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (2, 1, None), (9, 1, 1), (9, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(messy, some, toxicity.held_out_fifth()).count() == len(MESSY)
    assert toxicity.score(messy, none, toxicity.held_out_fifth()).count() == len(MESSY)
    assert toxicity.score(empty, none, toxicity.held_out_fifth()).count() == 0


def test_toxicity_at_a_tenth(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    test = toxicity.score(docs, labels, toxicity.held_out_fifth()).where("held_out").join(labels, "doc_id").toPandas()
    hit = test[test["predicted"] == 1]
    assert hit["toxic"].mean() > 0.97 and test[test["toxic"] == 1]["predicted"].mean() > 0.88


# --- language identification ---


def test_language_id(spark, messy, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    odd = [(1, None, None, None, None), (2, "", "en", "h", "x"), (3, "$$$ 123 ###", None, None, None), (4, "qqqqzz xxjjw vvkkq zzxxw", None, None, None), (5, "the thing that was on the other", None, "h", "x"), (5, "the thing that was on the other", None, "h", "x")]
    rows = spark.createDataFrame(odd, "page_id long, t string, d string, h string, s string").withColumn("id", F.lit(1)).withColumn("scores", F.lit(2))
    out = {r["page_id"]: r for r in langid.identify(rows, model, "page_id", F.col("t"), F.col("d"), F.col("h"), F.col("s")).collect()}
    assert out[5]["lang"] == "en" and out[3]["evidence"] == 0 and out[4]["text_lang"] == "und" and all(0 < r["probability"] <= 1 for r in out.values())
    found = langid.identify_documents(docs).join(docs.select("doc_id", F.col("lang").alias("said")), "doc_id")
    assert found.where("lang <> said").count() <= 5 and found.where("lang = 'und'").count() == 0
    assert langid.identify_documents(messy).count() == len(MESSY) and langid.identify_documents(empty).count() == 0


# --- top-k ---


def test_topk(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 6)).astype(np.float32)
    x[100:300] = x[5]  # many copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0, None]), (902, [float("nan")] * 6), (903, []), (904, [1.0] * 9), (None, [1.0] * 6), (905, [float("inf")] * 6), (5, [0.5] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(0)).withColumn("v", F.lit(0))
    out = covertree.top_k(df, df.where("vec_id % 20 = 0"), 20, cell=150).toPandas()
    wide = [(i, np.pad(np.floor(64.0 * np.asarray(v, float)), (0, 9 - len(v)))) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    for q, x in [(i, w) for i, w in wide if i % 20 == 0]:
        want = sorted(((-int(x @ w), i) for i, w in wide if i != q))[:20]
        got = out[out["query_id"] == q].sort_values("rank")
        assert list(zip(-got["score"], got["vec_id"], strict=True)) == want and list(got["rank"]) == list(range(1, 21))
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert covertree.top_k(none, none, 20).count() == 0 and covertree.top_k(df, none, 20).count() == 0
    few = df.where("vec_id < 5")
    assert covertree.top_k(few, few.where("vec_id = 0"), 20).count() == 4


@pytest.mark.parametrize("width", [2, 8, 64])
def test_cover_tree_holds_its_promises(width):
    rng = np.random.default_rng(7)
    x = np.floor(64 * np.r_[rng.standard_normal((1500, width)), 0.1 * rng.standard_normal((300, width)) + 3, np.zeros((200, width))])
    seen = []

    def walk(node):
        if node.rows is not None:
            seen.extend(node.rows.tolist())
            return node.rows
        rows = [walk(c) for c in node.children]
        reach = node.radius / covertree.EXPANSION
        for c, r in zip(node.children, rows, strict=True):
            assert np.sqrt(((x[r] - c.centre) ** 2).sum(axis=1)).max() <= c.radius + 1e-9 and c.radius <= reach + 1e-9
        gaps = np.sqrt(((node.centres[:, None] - node.centres[None]) ** 2).sum(axis=2)) + np.where(np.eye(len(node.centres)) > 0, np.inf, 0.0)
        assert len(node.children) > 1 and gaps.min() > reach - 1e-6
        return np.concatenate(rows)

    walk(covertree.cover_tree(x, 20))
    assert sorted(seen) == list(range(len(x)))


def test_far_apart_vectors_are_scored_in_blocks():
    """In 64 dimensions nearly every vector is a centre of its own one level down; leaves stay large all the same."""
    x = np.floor(64 * np.random.default_rng(8).standard_normal((8192, 64)))

    def leaves(node):
        return [len(node.rows)] if node.rows is not None else [n for c in node.children for n in leaves(c)]

    found = leaves(covertree.cover_tree(x))
    assert sum(found) == len(x) and len(found) <= 64


def test_topk_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(covertree, "PASS_BYTES", 8 * 16 * 100)  # 100 queries
    monkeypatch.setattr(covertree, "SAMPLE", 64)
    rng = np.random.default_rng(9)
    x = np.floor(64 * np.r_[rng.standard_normal((1500, 16)), rng.standard_normal((300, 16)) * 0.05 + 4, 1000 * rng.standard_normal((200, 16))])
    df = spark.createDataFrame([(i, (v / 64).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = covertree.top_k(df, df.where("vec_id % 5 = 0"), 20, cell=300).toPandas().sort_values(["query_id", "rank"])
    scores = x[::5] @ x.T
    scores[np.arange(400), np.arange(400) * 5] = -np.inf
    want = np.lexsort((np.broadcast_to(np.arange(2000), scores.shape), -scores), axis=1)[:, :20]
    assert (out["vec_id"].to_numpy().reshape(400, 20) == want).all()
    assert (out["score"].to_numpy().reshape(400, 20) == np.take_along_axis(scores, want, 1)).all()


# --- tokens ---


def brute_viterbi(counter, text):
    """Every segmentation position by position, in exact numbers; ties to the earliest start."""
    t, v, s = counter.normalise(text), counter.match.vocabulary, counter.model.scores
    best, n = [0.0] + [-math.inf] * len(t), [0] * (len(t) + 1)
    for e in range(1, len(t) + 1):
        for b in range(max(0, e - 20), e):
            ident = v.get(t[b:e])
            if ident is not None:
                w, k = s[ident], 1
            elif e - b == 1:
                w, k = counter.unknown, len(t[b:e].encode())
            else:
                continue
            if best[b] + w > best[e]:
                best[e], n[e] = best[b] + w, n[b] + k
    return n[-1]


TEXTS = ["", " ", "Hello world", "  two  spaces\n\nand\tmore ", "é́ 字典鿿 🙂🙂", "▁", "a" * 200, "naïve café", "the theand thing", "1234567890 !!!???", "\x00\x01"]


def test_token_counts(spark, messy, empty):
    count = tokencount.Counter(MODEL)
    for t in [*TEXTS, *[m[1] for m in MESSY if m[1] and m[1] is not LONG]]:
        assert count(t) == brute_viterbi(count, t)
    out = {r["doc_id"]: r["n_tokens"] for r in tokencount.count_tokens(messy, MODEL).collect()}
    assert out[1] == out[2] == 0 and out[4] == count(LONG) and out[5] == count(MESSY[4][1])
    assert tokencount.count_tokens(empty, MODEL).count() == 0


def test_token_counts_agree_with_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor()
    lib.LoadFromSerializedProto(spm.as_unigram(MODEL))
    count = tokencount.Counter(MODEL)
    words = {w for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() for w in r[0].split()}
    words = [w for w in words if w.isascii() and w.isalpha()][:1500]
    best = lib.nbest_encode(words, nbest_size=2)
    assert all(count(w) == len(b[0]) for w, b in zip(words, best, strict=True))


def test_sentencepiece(spark, messy, empty):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    codec = fst.Codec(MODEL)
    docs = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for t in [*TEXTS, *docs, LONG[:5000]]:
        ids = codec.encode(t).tolist()
        assert ids == lib.encode(t) and codec.decode(ids) == lib.decode(ids)
    out = {r["doc_id"]: r for r in fst.encode(messy, MODEL).collect()}
    assert out[1]["ids"] == [] and out[4]["ids"] == lib.encode(LONG) and out[4]["round_trip"] and not out[5]["round_trip"]
    back = {r["doc_id"]: r["text"] for r in fst.decode(fst.encode(messy, MODEL), MODEL).collect()}
    assert back[9] == "The The the"
    assert fst.encode(empty, MODEL).count() == 0


def test_unigram_path(spark):
    import sentencepiece

    data = spm.as_unigram(MODEL)
    codec, lib = fst.Codec(data), sentencepiece.SentencePieceProcessor()
    lib.LoadFromSerializedProto(data)
    for w in ("hello", "theand", "abracadabra", "Zeitung"):
        assert codec.encode(w).tolist() == lib.nbest_encode(w, nbest_size=2)[0]


def character_map():
    """A public normaliser's compiled character map."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.NormalizerSpec()
    spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_normalizer_spec())
    return spec.precompiled_charsmap


def variants():
    """Model files of every kind that the library reads, made from one vocabulary."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.ParseFromString(MODEL)
    for p in m.pieces:
        p.score = max(-15.0, p.score / 4096) if p.type == spm.NORMAL else p.score
    unigram = spm.changed(m.SerializeToString(), model_type=spm.UNIGRAM)
    no_bytes = proto.ModelProto()
    no_bytes.ParseFromString(spm.changed(unigram, kinds={p: spm.UNUSED for p in spm.load(MODEL).of_kind(spm.BYTE)}))
    no_bytes.trainer_spec.byte_fallback = False
    no_bytes = no_bytes.SerializeToString()
    user, nfkc = {"<tag>": spm.USER_DEFINED, "<sep>": spm.USER_DEFINED}, character_map()
    out = {"merges": MODEL, "unigram": unigram, "no bytes": no_bytes, "words": spm.changed(no_bytes, model_type=spm.WORD), "characters": spm.changed(no_bytes, model_type=spm.CHAR)}
    for name, data in (("merges", MODEL), ("unigram", unigram)):
        out[f"{name}, map"] = spm.changed(data, charsmap=nfkc)
        out[f"{name}, squeeze"] = spm.changed(data, squeeze=True)
        out[f"{name}, user"] = spm.changed(data, kinds=user)
        out[f"{name}, all"] = spm.changed(data, kinds=user, charsmap=nfkc, squeeze=True)
    out["merges, unused"] = spm.changed(MODEL, kinds={p: spm.UNUSED for p in ("▁the", "ing", "and")})
    return out


ODD = ["ﬁne ① ｶﾞ ㌕ x y ​ ＡＢＣ Å ﷺ z", "<tag>hello<tag> wor<tag>ld <t", "a<sep>b <sep> c", "▁▁ ▁", " x  y "]


def test_every_kind_of_model_agrees_with_the_library(spark):
    import sentencepiece

    docs = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(150).collect()]
    for name, data in variants().items():
        lib, codec = sentencepiece.SentencePieceProcessor(), fst.Codec(data)
        lib.LoadFromSerializedProto(data)
        for t in [*TEXTS, *ODD, *docs]:
            ids = codec.encode(t).tolist()
            assert ids == lib.encode(t) and codec.decode(ids) == lib.decode(ids), (name, t[:80])


def test_merges_agree_with_the_library_on_many_documents(spark):
    import sentencepiece

    lib, codec = sentencepiece.SentencePieceProcessor(model_proto=MODEL), fst.Codec(MODEL)
    docs = [r[0] or "" for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").limit(4000).collect()]
    assert len(docs) == 4000
    for t, want in zip(docs, lib.encode(docs), strict=True):
        assert codec.encode(t).tolist() == want


def test_character_map_is_read_whole():
    rules = spm.read_charsmap(character_map())
    assert len(rules) > 200_000 and (rules["ﬁ"], rules["Ａ"], rules["\t"], rules["①"]) == ("fi", "A", " ", "1")


def test_stability_is_what_merging_says():
    codec = fst.Codec(MODEL)
    m, rng, ids = codec.merges, np.random.default_rng(5), list(codec.vocabulary.values())
    for a, b in rng.choice(ids, (3000, 2)).tolist():
        if m.reachable(a) and m.reachable(b):
            pieces = codec.model.pieces
            assert m.stable(a, b) == (m.merge(pieces[a] + pieces[b])[0] == [pieces[a], pieces[b]])


def test_units_cut_where_no_piece_reaches():
    match = lattice.Matcher(spm.load(MODEL))
    assert "".join(match.units("▁a▁▁b\n▁c▁")) == "▁a▁▁b\n▁c▁" and match.units("▁a▁▁b\n▁c▁") == ["▁a", "▁▁b", "\n", "▁c", "▁"]


# --- near duplicates ---


def brute_components(rows, words, percent):
    def shingles(t):
        w = text_of(t).lower().split()
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_rows():
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(40):
        base = rng.choice(words, int(rng.integers(1, 120))).tolist()
        for _ in range(int(rng.integers(1, 9))):
            t = list(base)
            for _ in range(int(rng.integers(0, 8))):
                t[int(rng.integers(len(t)))] = str(rng.choice(words))
            rows.append((len(rows), " ".join(t)))
    return rows + [(len(rows) + k, t) for k, t in enumerate(["", None, "One", "one", " ONE ", "two words", "Two  Words"])]


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, words, monkeypatch):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, words, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in lshforest.near_duplicates(docs, words).collect()}
    assert got == want


def test_near_duplicates_in_parts(spark, monkeypatch):
    """Regions and families far larger than a part give the same components."""
    monkeypatch.setattr(lshforest, "PART", 5)
    monkeypatch.setattr(lshforest, "DENSE", (3, 6))
    rows = [(i, " ".join(["a b c d e f g h i j k l m n o p q r s t u v w x y z"] + [f"k{i % 3}"] * (i % 2))) for i in range(60)] + near_rows()[:0]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in lshforest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == brute_components(rows, 2, 80)


def test_near_duplicates_edges(spark, messy, empty):
    out = lshforest.near_duplicates(messy, 2).collect()
    assert len(out) == len(MESSY)
    by = {r["doc_id"]: r for r in out}
    assert by[None]["component_id"] is None and by[None]["kept"] and by[7]["component_id"] == 5 and not by[7]["kept"] and by[1]["n_shingles"] == 0
    assert lshforest.near_duplicates(empty).count() == 0


def test_repeated_ids_have_one_answer(spark):
    x, y, z = ("a b c d e f g h i j", "k l m n o p q r s t", "u v w x y z")
    rows = [(3, x), (5, x), (5, y), (9, y), (9, ""), (11, z), (12, z), (12, None), (2, "q"), (None, x)]
    out = lshforest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out}
    assert len(out) == len(rows)
    assert got == {(3, 9, 3, True), (5, 9, 3, False), (9, 9, 3, False), (9, 0, 3, False), (11, 5, 11, True), (12, 5, 11, False), (12, 0, 11, False), (2, 1, 2, True), (None, 9, None, True)}


def test_subtrees_are_runs_of_common_prefixes():
    rng = np.random.default_rng(2)
    labels = sorted((int(h), int(a << 16 | b)) for h, a, b in zip(rng.integers(0, 4, 60), rng.integers(0, 3, 60), rng.integers(0, 3, 60), strict=True))
    head, rest = (np.array(c, dtype=np.int64) for c in zip(*labels, strict=True))
    prefix = {3: lambda x: x[0], 4: lambda x: (x[0], x[1] >> 16), 5: lambda x: x}
    for depth, (key, count, outside) in zip(lshforest.DEPTHS, lshforest.subtrees(head, rest, True, False), strict=True):
        names = [prefix[depth](x) for x in labels]
        sizes = Counter(names)
        assert count.tolist() == [sizes[n] for n in names] and len(set(zip(key.tolist(), names, strict=True))) == len(sizes) == len(set(key.tolist()))
        assert outside.tolist() == [n == names[0] for n in names]


def exact_links(sets, percent=80):
    """All links, by prefix filtering: in one order of shingles by rarity, linked sets share one of their first ones."""
    df = Counter(x for s in sets.values() for x in s)
    index, out = {}, []
    for i, s in sorted(sets.items(), key=lambda x: len(x[1])):
        first = sorted(s, key=lambda x: (df[x], x))[: len(s) - -(-percent * len(s) // 100) + 1]
        for j in {j for x in first for j in index.get(x, ())}:
            if 100 * len(sets[j]) >= percent * len(s):
                both = len(s & sets[j])
                if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                    out.append((i, j))
        for x in first:
            index.setdefault(x, []).append(i)
    return out


@pytest.mark.parametrize("words", [2, 5])
def test_no_link_is_lost(spark, words):
    """All documents at sf0.1 against all exact links."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    shingler = lshforest.Shingler(words)
    sets = {r["doc_id"]: set(shingler(r["text"]).tolist()) for r in docs.select("doc_id", "text").toLocalIterator()}
    links = exact_links({i: s for i, s in sets.items() if s})
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["component_id"] for r in lshforest.near_duplicates(docs, words).collect()}
    assert len(links) > 1000 and got == {i: find(i) for i in sets}
