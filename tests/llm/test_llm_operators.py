"""The operators against brute force, on the smallest tables with edge cases added, and on edge cases alone."""

import collections
import hashlib
import math
import os
import re
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumensift.llm import ann, bpe, common, entries, graph, langid, lm, mixing, neardup, quality, substring, topk, urls

DIR = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
EDGES = [
    (100_000, None, "en", "edge", None),
    (100_001, "", None, None, 0),
    (100_002, " \t\n", "en", None, 3),
    (100_003, "one two", "en", "edge", 7),
    (100_004, "ONE\x0btwo", "en", "edge", 7),
    (100_005, LONG, "en", "edge", len(LONG)),
    (100_005, LONG, "en", "edge", len(LONG)),
    (None, "no id here at all, none", "fr", "edge", None),
    (None, None, None, None, None),
    (100_007, "日本語 🙂 été   Ünïcode 123 \x00", "de", "edge", 1),
    (100_008, "!!! 123 ...", "en", "edge", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    return spark.createDataFrame(rows + EDGES, DOC).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def clash(docs):
    """Extra columns named as the operators name theirs."""
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in ("score", "size", "cls", "label", "th", "words", "ids", "held_out", "block", "mins", "neardup", "_h", "_size", "target", "predicted")])


def words(text):
    return (text or "").encode().lower().split()


def ascii_lower(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def held(doc_id, folds):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % folds == 0


def test_hashes_are_those_of_words():
    import pyarrow as pa

    texts = ["a bb  CCC", None, "", "\x0bx\r\n", LONG]
    data, starts, ends, hashes, counts = common.words_of(pa.array(texts))
    own = [w for t in texts for w in words(t)]
    assert [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == own
    assert counts.tolist() == [len(words(t)) for t in texts]
    assert len(set(zip(own, hashes.tolist(), strict=True))) == len(set(own)) == len(set(hashes.tolist()))


# --- 1 ---


def test_quality(spark, docs, empty):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    net = quality.train(docs, labels)
    got = quality.score(docs, net).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 for r in got)
    alone = {r.text: net.score(np.frombuffer((r.text or "").encode(), np.uint8), np.array([0]), np.array([len((r.text or "").encode())]))[0] for r in got[:20]}
    assert all(r.score == pytest.approx(alone[r.text], abs=1e-5) for r in got[:20])  # no text sees its neighbours
    assert quality.digest(empty, labels).count() == 0
    assert quality.digest(docs, labels.limit(0)).count() == docs.count()


def plain_quality(net, text):
    """The network as loops over blocks, places, filters and chunks."""
    p, size = net.p, quality.BLOCK
    width, _, filters = p["table"].shape
    top = []
    for at in range(0, max(1, len(text)), size):
        best = [-1e4] * filters
        for i in range(at, min(len(text), at + size)):
            for f in range(filters):
                best[f] = max(best[f], sum(float(p["table"][j][text[i + j]][f]) for j in range(width) if i + j < len(text)))
        top.append(best)
    full = min(len(text), 2 * size) / (2 * size)
    hidden = []
    for i in range(max(1, len(top) - 1)):
        m = [max(0.0, max(a, b) + float(c)) for a, b, c in zip(top[i], top[min(i + 1, len(top) - 1)], p["bias"], strict=True)] + [full, math.sqrt(full)]
        hidden.append([max(0.0, sum(x * float(w) for x, w in zip(m, p["w2"][:, h], strict=True)) + float(p["b2"][h])) for h in range(len(p["b2"]))])
    z = sum(max(h[i] for h in hidden) * float(p["w3"][i]) for i in range(len(p["w3"]))) + float(p["b3"][0])
    return 1 / (1 + math.exp(-z))


@pytest.mark.parametrize("part", [512, 1 << 18])
def test_quality_is_the_plain_network(part):
    r = np.random.default_rng(5)
    net = quality.Network(filters=5, hidden=4, seed=2)
    texts = [bytes(r.integers(97, 123, n).astype(np.uint8)) for n in (0, 1, 255, 256, 257, 512, 1024, 2200, 3, 512, 1536, 30)]
    size = np.array([len(t) for t in texts])
    got = net.score(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, np.cumsum(size), part)
    assert got == pytest.approx([plain_quality(net, t) for t in texts], abs=1e-5)


def test_quality_keeps_columns_of_any_name(spark, docs):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    own = docs.withColumn("quality_score", F.lit("own"))
    got = quality.kept(own, labels)
    assert got.columns == own.columns
    assert {r.quality_score for r in got.collect()} == {"own"}


def test_quality_learns(spark):
    r = np.random.default_rng(1)
    good = [" ".join(r.choice(["sun", "moon", "river", "stone", "cloud"], 30)).encode() for _ in range(150)]
    bad = [w.upper().replace(b" ", b"!! ") for w in good]
    net = quality.Network().fit(good[:100] + bad[:100], np.repeat([1, 0], 100), epochs=6)
    for texts, label in ((good[100:], 1), (bad[100:], 0)):
        size = np.array([len(t) for t in texts])
        s = net.score(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, np.cumsum(size))
        assert ((s > 0.5) == label).mean() > 0.95


def test_quality_gradient():
    net, texts = quality.Network(filters=4, hidden=3, seed=3), [b"abcabcabd" * 80, b"zz", b"hello world " * 30]
    size = np.array([len(t) for t in texts])
    args = (np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, np.cumsum(size))
    y, w = np.array([1, 0, 1]), np.ones(3)
    g = net.gradient(*args, y, w)

    def loss():
        p = net.score(*args)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, at in (("w3", 0), ("b2", 1), ("bias", 2), ("w2", (1, 2)), ("table", (0, ord("a"), 1))):
        old = net.p[name][at]
        values = []
        for d in (1e-3, -1e-3):
            net.p[name][at] = old + d
            values.append(loss())
        net.p[name][at] = old
        assert (values[0] - values[1]) / 2e-3 == pytest.approx(float(g[name][at]), abs=2e-3)


# --- 2 ---


def test_langid(docs, empty, clash):
    got = langid.digest(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == docs.count()
    assert {by[i].lang_pred for i in (100_000, 100_001, 100_002, 100_008)} == {"und"}
    known = [(r.lang, by[r.doc_id]) for r in docs.filter("lang is not null and doc_id < 100000").collect()]
    assert np.mean([a == b.lang_pred for a, b in known if b.held_out]) > 0.9
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.digest(empty).count() == 0
    assert langid.fit(docs.withColumn("lang", F.lit(None).cast("string"))).languages == []
    assert "label" in langid.identify(clash, langid.fit(docs)).columns


def test_langid_counts_are_those_of_sets():
    import pyarrow as pa

    texts = pa.array(["the cat sat", "le chat noir"])
    gram, first = langid.grams(texts)
    tables = [np.zeros(1 << 16, np.uint8)]
    for i in range(2):
        for p in langid.places(gram[first[i] : first[i + 1]], 16):
            np.bitwise_or.at(tables[0], p, np.uint8(1 << i))
    f = langid.Filters(["en", "fr"], tables, 16)
    assert f.decide(texts)[0] == ["en", "fr"]
    many = np.diff(first)
    assert f.counts(gram, first)[0, 0] == pytest.approx(many[0], abs=0.01 * many[0])


def plain_grams(text):
    """Five bytes each of the lower-cased text, in which runs of other characters than letters are one space."""
    import regex

    t = (" " + regex.sub(r"[^\p{L}]+", " ", " " + (text or "").lower() + " ") + " ").encode()
    return [int.from_bytes(t[i : i + 5], "little") for i in range(len(t) - 4)]


def test_langid_fit_and_decisions_are_those_of_plain_sets(docs):
    """Sets of n-grams for each language in place of filters: every entry of theirs is in the filters, and whole texts are decided alike."""
    rows = docs.select("doc_id", "text", "lang").collect()
    train = [r for r in rows if r.lang is not None and r.text is not None and not held(r.doc_id, 5)]
    texts, n = collections.Counter(r.lang for r in train), collections.defaultdict(collections.Counter)
    for r in train:
        for g in set(plain_grams(r.text)):
            n[g][r.lang] += 1
    own = {g: {x for x, k in c.items() if k / texts[x] >= langid.RATIO * max(k / texts[y] for y, k in c.items())} for g, c in n.items()}
    f = langid.fit(docs)
    assert f.languages == sorted(texts)
    gram = np.array(list(own), np.uint64)
    mask = f.tables[0][langid.places(gram, f.bits)[0]]
    for p in langid.places(gram, f.bits)[1:]:
        mask = mask & f.tables[0][p]
    extra = 0
    for m, langs in zip(mask.tolist(), own.values(), strict=True):
        has = {x for i, x in enumerate(f.languages) if m >> i & 1}
        assert langs <= has
        extra += len(has - langs)
    assert extra < 0.02 * len(own) * len(f.languages)
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in langid.identify(docs.select("doc_id", "text"), f).collect()}
    for r in rows:
        grams = plain_grams(r.text)
        count = {x: sum(x in own.get(g, ()) for g in grams) for x in f.languages}
        best = max(f.languages, key=lambda x: count[x])
        said, score = got[r.doc_id, r.text]
        if said != langid.NONE:
            assert count[said] >= count[best] - 0.02 * len(grams) - 1
            assert score == pytest.approx(min(1, count[said] / len(grams)), abs=0.03)


# --- 3 ---


def test_bpe_equals_the_library(docs, empty, clash):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(lines), special_tokens={})
    for r in bpe.encode(docs, path, P.PATTERN).collect():
        ids = enc.encode_ordinary(r.text or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.digest(empty, path, P.PATTERN).count() == 0
    assert bpe.encode(clash, path, P.PATTERN).filter("n_tokens > 0").first()["label"] == "own label"


@pytest.mark.parametrize("seed", range(5))
def test_replay_equals_plain_merging(seed):
    r = np.random.default_rng(seed)
    tokens = [bytes([b]) for b in range(256)]
    while len(tokens) < 330:  # vocabularies in which a long token may come before its parts
        new = b"".join(r.choice([b"a", b"b", b"c"], r.integers(2, 5)).tolist())
        if new not in tokens:
            tokens.append(new)
    ranks = {t: i for i, t in enumerate(tokens)}

    def plain(piece):
        if piece in ranks:
            return [ranks[piece]]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            found = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
            if not found:
                return [ranks[p] for p in parts]
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    pieces = list({b"".join(r.choice([b"a", b"b", b"c"], r.integers(1, 30)).tolist()) for _ in range(200)}) + [b"a" * 50]
    codec = bpe.Codec(ranks)
    ids, begins = codec.replay(pieces)
    assert [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:], strict=True)] == [plain(p) for p in pieces]
    assert codec.decode(ids.tolist()) == b"".join(pieces)


# --- 4 ---


def test_lm(docs, empty, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 50_000)
    monkeypatch.setattr(lm, "RANGE_WORDS", 5000)
    rows = docs.select("doc_id", "text").collect()
    tokens = [(r.doc_id, [*words(r.text), None]) for r in rows]
    c = collections.Counter(x for d, w in tokens if not held(d, 10) for x in w)
    pairs = collections.Counter(p for d, w in tokens if not held(d, 10) for p in zip([0, *w], w, strict=False))
    n, v = sum(c.values()), len(c)
    trained = sum(not held(d, 10) for d, _ in tokens)
    want = []
    for d, w in tokens:
        base = [(c[x] + 0.1) / (n + 0.1 * (v + 1)) for x in w]
        exact = [(pairs[p] + lm.KAPPA * b) / ((trained if p[0] == 0 else c[p[0]]) + lm.KAPPA) for p, b in zip(zip([0, *w], w, strict=False), base, strict=True)]
        want.append((str(d), held(d, 10), len(w), sum(c[x] > 0 for x in w), n, sum(map(math.log10, base)), sum(map(math.log10, exact))))
    got = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score(docs).collect()), key=str)
    for a, b in zip(got, sorted(want, key=str), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], abs=1e-6)
        assert a[6] == pytest.approx(b[6], abs=1 + 0.031 * a[2])  # a level spans a seventh, and the filter errs now and then
    assert lm.score(empty).count() == 0
    assert [r.score for r in lm.score(docs.filter("doc_id is null and text is null")).collect()] == [0.0]


def test_filter_never_loses_a_count():
    pair = np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64)
    times = np.random.default_rng(1).integers(1, 100, 5000)
    segment = np.zeros(200_000, np.uint8)
    for j in range(1, int(np.searchsorted(lm.BOUNDS, 100)) + 1):
        for s in lm.spots(pair[times >= lm.BOUNDS[j - 1]], j, 8 * len(segment)):
            np.bitwise_or.at(segment, s >> 3, np.uint8(1) << (s & 7).astype(np.uint8))
    got = lm.LogFrequencyFilter([segment]).counts(pair)
    assert (got >= times * 0.85).all()
    assert (got <= times * 1.15 + 1).mean() > 0.9


def test_segments_grow_with_their_pairs():
    pair = np.random.default_rng(0).integers(0, 2**63, 400_000, dtype=np.uint64)
    segment = lm.segment_of(pair[:200_000], np.full(200_000, 2))
    f = lm.LogFrequencyFilter([segment])
    assert (f.levels(pair[:200_000]) >= 2).all()
    assert (f.levels(pair[200_000:]) > 0).mean() < 0.02


def test_lm_gathers_no_filter(docs, monkeypatch):
    def refuse(*args, **kwargs):
        raise AssertionError("a table as large as the corpus would go through the driver")

    monkeypatch.setattr(type(docs.sparkSession.sparkContext), "broadcast", refuse)
    monkeypatch.setattr(type(docs), "toArrow", refuse)
    assert lm.score(docs).count() == docs.count()


# --- 5 and 10 ---

VEC = "vec_id long, embedding array<float>, label int, score string"


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(r.vec_id, r.embedding, 1, "x") for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()]
    size = len(rows[0][1])
    odd = [(100_050, None), (100_051, [0.0] * size), (100_100, [float("nan")] * size), (100_150, [None] * size), (100_052, [float("inf")] * size), (100_053, []), (None, rows[7][1]), (rows[3][0] + 1000, rows[3][1]), (rows[0][0], rows[0][1]), (100_200, rows[0][1]), (100_250, [1e30] * size)]
    return spark.createDataFrame(rows + [(i, e, 1, "x") for i, e in odd], VEC).repartition(3).cache()


def fit_rows(vectors, zero):
    ok = lambda e: e and all(x is not None and math.isfinite(x) for x in e) and (zero or any(e))
    return [(r.vec_id, np.array(r.embedding, np.float64)) for r in vectors.collect() if ok(r.embedding)]


def last(i):
    return (i is None, i or 0)


def test_topk_is_exact(vectors):
    rows = [(i, [math.floor(256 * x) for x in e.tolist()]) for i, e in fit_rows(vectors, True)]
    m = {i: v for i, v in rows if i is not None and i % 50 == 0}
    want = set()
    for q, e in m.items():
        if max(map(abs, e)) > 2**40:
            continue
        s = sorted(((-sum(map(int.__mul__, e, x)), last(i), i) for i, x in rows if i != q and max(map(abs, x)) < 2**40))[:5]
        want |= {(q, n + 1, i, -v) for n, (v, _, i) in enumerate(s)}
    small = vectors.filter("vec_id is null or vec_id <> 100250")
    assert {tuple(r) for r in topk.search(small).collect()} == want
    assert topk.search(vectors).filter("query_id = 0").count() == 5
    assert topk.search(vectors.limit(0)).count() == 0
    assert topk.search(vectors.filter("vec_id in (0, 3)")).filter("query_id = 0").count() <= 2


def test_topk_leaves_far_blocks_out(spark, monkeypatch):
    """Vectors in clusters: most blocks never meet, and the result is exact; so it is with many copies of one vector."""
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "Q_BLOCK", 8)
    r = np.random.default_rng(7)
    centres = r.normal(0, 4, (12, 8))
    x = [(i, (centres[i % 12] + r.normal(0, 0.1, 8)).tolist()) for i in range(1500)] + [(2000 + i, centres[3].tolist()) for i in range(400)] + [(5000, [1.0, 2.0])]
    v = spark.createDataFrame(x, "vec_id long, embedding array<double>").repartition(5)
    kept, real = [], topk.meetings
    monkeypatch.setattr(topk, "meetings", lambda *a: kept.append((real(*a), a[0].count() * a[2])) or real(*a))
    got = {(q.query_id, q["rank"]): (q.vec_id, q.score) for q in topk.search(v, every=10).collect()}
    whole = {i: np.floor(256 * np.array(e)) for i, e in x}
    for q, e in whole.items():
        if q % 10 == 0 and q < 5000:
            score = sorted((-int(e @ y), i) for i, y in whole.items() if i != q and len(y) == len(e))[:5]
            assert [got[q, n + 1] for n in range(5)] == [(i, -s) for s, i in score]
    assert not any(q == 5000 for q, _ in got)
    pairs, every = kept[0]
    assert pairs.count() < 0.5 * every


def test_ann_searches_every_length_with_many_lists(spark, monkeypatch):
    """Hundreds of lists, cut into parts for rows and queries, and vectors of three lengths, one of them rare."""
    for name, value in (("LIST_ROWS", 4), ("PART_ROWS", 3), ("PART_QUERIES", 2)):
        monkeypatch.setattr(ann, name, value)
    r = np.random.default_rng(8)
    centres = r.normal(size=(60, 24))
    rows = [(i, [float(x) for x in (centres[i % 60] + r.normal(size=24))[: 24 if i % 3 else 16]]) for i in range(2400)]
    rows += [(10_000 + 50 * i, [float(x) for x in r.normal(size=5)]) for i in range(7)] + [(50, [float(x) for x in r.normal(size=24)])]
    got = collections.defaultdict(dict)
    for x in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect():
        got[x.query_id][x.rank] = (x.vec_id, x.score)
    assert set(got) == {i for i, _ in rows if i % 50 == 0}
    hits = total = 0
    for q in got:
        own = [np.array(v) for i, v in rows if i == q]
        score = {}
        for i, v in rows:
            if i != q and (near := [float(e @ v / np.linalg.norm(e) / np.linalg.norm(v)) for e in own if len(e) == len(v)]):
                score[i] = max(near)
        best = sorted(score, key=lambda i: (-score[i], i))[:5]
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        assert all(s == pytest.approx(score[i], abs=1e-12) for i, s in got[q].values() if 50 not in (q, i))  # two vectors have that id
        hits, total = hits + sum(i in best for i, _ in got[q].values()), total + 5
    assert hits / total >= 0.95


def test_ann_recall(vectors, spark):
    rows = fit_rows(vectors, False)
    got = collections.defaultdict(dict)
    for r in ann.nearest(vectors).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    hits = total = 0
    for q, e in {i: v for i, v in rows if i is not None and i % 50 == 0}.items():
        s = sorted((-float(e @ x / np.linalg.norm(e) / np.linalg.norm(x)), last(i), i) for i, x in rows if i != q)[:5]
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        exact = {i: -v for v, _, i in s}
        hits += sum(i in exact for i, _ in got[q].values())
        total += 5
        assert all(v == pytest.approx(exact[i], abs=1e-12) for i, v in got[q].values() if i in exact)
    assert hits / total >= 0.9
    assert got[0][1][0] == 100_200  # an equal vector
    assert ann.nearest(vectors.limit(0)).count() == 0
    few = vectors.filter("vec_id in (0, 3, 5)")
    assert {r.vec_id for r in ann.nearest(few).filter("query_id = 0").collect()} == {3, 5}


# --- 6 ---


def test_mixing(docs, empty, clash):
    got = mixing.digest(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.digest(docs.repartition(5)).collect()))
    text = collections.defaultdict(set)
    source = {}
    for r in docs.collect():
        text[r.doc_id].add(len(words(r.text)))
        source[r.doc_id] = r.source
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.source] += len(words(r.text))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, target, left = sum(sizes.values()), {}, dict(sizes)
    while True:  # share, stop those above, share the rest again
        rest, w = total - sum(target.values()), sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] / w > 3 * sizes[s]]
        if not over:
            target.update({s: rest * weight[s] / w for s in left})
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            del left[s]
    taken = collections.Counter()
    for r in got:
        assert r.size in text[r.doc_id]
        assert r.taken <= 3 * r.size
        if r.doc_id is not None:
            assert r.source_size == sizes[source[r.doc_id]]
            assert r.target == pytest.approx(target[source[r.doc_id]])
            taken[source[r.doc_id]] += r.taken
    for s in names[:-1]:
        if s != "edge":
            assert abs(taken[s] - target[s]) <= 2 * max(x for d, v in text.items() if source[d] == s for x in v)
    assert mixing.digest(empty).count() == 0
    m = mixing.mix(clash)
    out = mixing.emit(m)
    assert out.columns == clash.columns
    assert out.count() == sum(r.mix_copies for r in m.collect())


def test_mixing_keeps_columns_of_any_name(docs):
    own = docs.select("*", F.lit("a").alias("mix_size"), F.lit("b").alias("MIX_key"), F.lit("c").alias("own_mix_size"))
    got = mixing.sampled(own)
    assert got.columns == own.columns
    rows = got.collect()
    assert {(r.mix_size, r["MIX_key"], r.own_mix_size) for r in rows} == {("a", "b", "c")}
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r.doc_id for r in mixing.sampled(docs).collect())


# --- 7 ---


def passage(seed, n):
    return " ".join(f"p{seed}q{x}" for x in np.random.default_rng(seed).integers(0, 10**6, n))


def test_substring(spark, empty):
    shared, fuzzy = passage(1, 60), passage(2, 80).split()
    changed = list(fuzzy)
    changed[30], changed[55] = "other", "words"
    rows = [
        (1, passage(11, 40) + " " + shared + " " + passage(12, 40)),
        (2, passage(13, 10) + " " + shared.upper() + " " + passage(14, 30)),
        (3, shared + "\n" + passage(15, 200)),
        (4, " ".join(fuzzy)),
        (5, passage(16, 100) + " " + " ".join(changed)),
        (6, passage(17, 300)),
        (7, passage(18, 45) + " " + passage(19, 45)),
        (8, passage(18, 45) + " " + passage(20, 45)),
        (9, None),
        (10, ""),
        (None, shared),
        (6, passage(17, 300)),
        (11, "du " * 400),
        (12, passage(21, 20) + " du" * 300),
    ]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    got = {(r.doc_id, r.other_doc_id, r.start_word, r.end_word) for r in substring.digest(docs).collect()}
    assert {(2, 1, 10, 70), (3, 1, 0, 60)} <= got
    assert {(a, b) for a, b, *_ in got} <= {(2, 1), (3, 1), (3, 2), (5, 4), (12, 11)}
    assert (5, 4, 100, 180) in got
    assert (12, 11) in {(a, b) for a, b, *_ in got}
    left = {(r.doc_id, r.text): r for r in substring.without_repeats(docs).collect()}
    assert len(left) == len(set(rows))
    by = {r.doc_id: r for r in left.values() if r.doc_id is not None}
    assert by[1].text == rows[0][1]
    assert by[2].text == passage(13, 10) + " " + passage(14, 30)
    assert by[2].n_chars == len(by[2].text)
    assert by[3].text == passage(15, 200)
    assert by[5].text.strip() == passage(16, 100)
    assert by[7].text == rows[6][1]
    assert substring.without_repeats(empty).count() == 0


def test_substring_between_first_and_last(spark):
    """Parts of the passage have first and last documents of their own, so that no seed ties those in between."""
    one, two = passage(31, 30), passage(32, 30)
    whole = one + " " + two
    texts = [one, two, whole, one + " " + passage(33, 9), two + " " + passage(34, 9), passage(35, 9) + " " + whole, one + " " + passage(36, 9), two + " " + passage(37, 9), whole]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    left = {r.doc_id: r.text.strip() for r in substring.without_repeats(docs).collect()}
    assert left == {**dict(enumerate(texts)), 5: passage(35, 9), 8: ""}


def test_substring_twice_in_a_later_document(spark):
    x, y, shared = passage(41, 30), passage(42, 30), passage(43, 60)
    texts = [
        x + " " + passage(44, 20) + " " + y + " " + passage(45, 20) + " " + x + " " + y + " " + shared,
        passage(46, 15) + " " + shared + " " + passage(47, 15) + " " + shared + " " + passage(48, 15),
        passage(49, 15) + " " + x + " " + y,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    left = {r.doc_id: r.text.split() for r in substring.without_repeats(docs).collect()}
    assert left == {0: texts[0].split(), 1: (passage(46, 15) + " " + passage(47, 15) + " " + passage(48, 15)).split(), 2: passage(49, 15).split()}


def test_substring_between_two_others(spark):
    """A passage whose pieces also occur in one earlier and one later document each; the document in between must not be lost."""
    rows = []
    for i in range(20):
        one, two = passage(1000 + i, 30), passage(2000 + i, 30)
        own = lambda j, n=12: passage(3000 + 10 * i + j, n)  # noqa: E731, B023
        texts = [own(0) + " " + one, own(1) + " " + two, own(2) + " " + one + " " + two + " " + own(3), own(4) + " " + one + " " + two, one + " " + own(5), two + " " + own(6)]
        rows += [(100 * i + j, t) for j, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.other_doc_id, r.start_word, r.end_word) for r in substring.digest(docs).collect()}
    assert {(100 * i + 3, 100 * i + 2, 12, 72) for i in range(20)} <= got


@pytest.mark.parametrize(("same", "least", "evenly"), [(0.95, 0.97, False), (0.9, 0.95, False), (0.85, 0.93, False), (0.82, 0.8, False), (0.88, 0.9, True)])
def test_substring_recall_of_fuzzy_passages(spark, same, least, evenly):
    """Passages of 100 words in which some words, spread by chance or evenly, are others: the share of them found, at least to nine tenths of their length."""
    r = np.random.default_rng(int(100 * same))
    rows, n = [], 80
    for i in range(n):
        words_ = passage(5000 + i, 100).split()
        other = list(words_)
        many = round(100 * (1 - same))
        for j in (np.arange(many) * 100 / many + r.integers(6)).astype(int) % 100 if evenly else r.choice(100, many, replace=False):
            other[j] = f"x{j}y{i}"
        rows += [(2 * i, passage(6000 + i, 60) + " " + " ".join(words_) + " " + passage(7000 + i, 60)), (2 * i + 1, passage(8000 + i, 40) + " " + " ".join(other) + " " + passage(9000 + i, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {}
    for x in substring.digest(docs).collect():
        assert x.doc_id == x.other_doc_id + 1
        got[x.doc_id] = got.get(x.doc_id, 0) + min(140, x.end_word) - max(40, x.start_word)
    share = sum(got.get(2 * i + 1, 0) >= 90 for i in range(n)) / n
    assert share >= least, share


def test_substring_extends_as_far_as_words_agree(spark, monkeypatch):
    monkeypatch.setattr(substring, "REACH", 4)
    a, shared = passage(61, 30), passage(62, 900).split()
    other = [w if j % 9 else f"z{j}" for j, w in enumerate(shared)]  # few seeds, so that extensions are long
    docs = spark.createDataFrame([(1, a + " " + " ".join(shared)), (2, " ".join(other) + " " + passage(63, 30))], "doc_id long, text string")
    got = [(r.start_word, r.end_word) for r in substring.digest(docs).collect()]
    assert min(a for a, _ in got) <= 1
    assert max(b for _, b in got) >= 890


def test_substring_pieces_of_a_long_text(monkeypatch):
    r = np.random.default_rng(3)
    hashes, counts = r.integers(0, 2**63, 700).astype(np.uint64), np.array([3, 400, 0, 297])
    whole = set(zip(*(x.tolist() for x in substring.seeds_of(hashes, counts)), strict=True))
    shared = np.ones(700, np.int64)
    windows = substring.repeated_windows(hashes, counts, shared, 50)
    monkeypatch.setattr(substring, "PIECE", 64)
    assert whole <= set(zip(*(x.tolist() for x in substring.seeds_of(hashes, counts)), strict=True))
    for x, y in zip(windows, substring.repeated_windows(hashes, counts, shared, 50), strict=True):
        assert (x == y).all()


def test_substring_names_may_clash(spark):
    shared = passage(71, 60)
    rows = [(1, shared, 1, "a", "b"), (2, passage(72, 9) + " " + shared, 2, "c", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cut_id long, CUT_TH string, cut_spans string")
    got = {tuple(r) for r in substring.without_repeats(docs).collect()}
    assert got == {rows[0], (2, passage(72, 9) + " ", 2, "c", "d")}


def test_substring_finds_all_exact_passages(docs):
    cut = collections.defaultdict(list)
    for r in substring.digest(docs).collect():
        cut[r.doc_id].append((r.start_word, r.end_word))
    seen, missed, total = {}, 0, 0
    for d, t in sorted({(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None and r.text}):
        w = words(t)
        for i in range(len(w) - 49):
            own = tuple(w[i : i + 50])
            if len(set(own)) > 5 and seen.setdefault(own, d) != d:
                total += 1
                missed += not any(a <= i and i + 50 <= b for a, b in cut[d])
    assert total > 100
    assert missed == 0


@pytest.mark.parametrize("seed", range(4))
def test_chain_is_the_best_one(seed):
    r = np.random.default_rng(seed)
    n = 9
    low, high, size = r.integers(0, 60, n), np.sort(r.integers(0, 60, n)), r.integers(3, 8, n)

    def best(j):
        return size[j] + max([0.0] + [best(i) - (low[j] - low[i] - size[i]) - (high[j] - high[i] - size[i]) for i in range(n) if low[i] + size[i] <= low[j] and high[i] + size[i] <= high[j]])

    top = substring.chain(low, high, size)[0]
    value = sum(int(size[j]) for j in top) - sum(int(low[b] - low[a] - size[a] + high[b] - high[a] - size[a]) for a, b in zip(top, top[1:], strict=False))
    assert value == max(best(j) for j in range(n))


# --- 8 ---


def brute_groups(rows, percent):
    sets = [(d, shingles(t)) for d, t in rows]
    label = list(range(len(sets)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i))) for i, (d, s) in enumerate(sets)), key=str)


def test_neardup(spark, docs, empty, clash, monkeypatch):
    base = passage(31, 120).split()
    r = np.random.default_rng(5)
    near = []
    for i in range(40):  # a group that the trees can't split, some of it linked
        own = list(base)
        for j in r.choice(120, int(r.integers(0, 9)), replace=False):
            own[j] = f"edit{i}x{j}"
        near.append((200_000 + i, " ".join(own), "en", "near", 1))
    both = docs.unionByName(spark.createDataFrame(near, DOC)).cache()
    rows = [(x.doc_id, x.text) for x in both.collect()]
    for percent, block in ((85, 1024), (80, 8)):
        monkeypatch.setattr(neardup, "BLOCK", block)
        got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in neardup.groups(both, percent).collect()), key=str)
        assert got == brute_groups(rows, percent)
    assert neardup.groups(empty).count() == 0
    kept = neardup.one_of_each(clash)
    assert kept.columns == clash.columns
    assert kept.filter("doc_id = 100005").count() == 1
    assert kept.filter("doc_id in (100003, 100004)").count() == 1
    assert kept.filter("doc_id in (100000, 100001, 100002)").count() == 3


def test_linked_by_columns():
    r = np.random.default_rng(2)
    items = [np.unique(r.integers(0, 60, 50).astype(np.uint64)) for _ in range(30)]
    want = [[i == j or 100 * len(set(a) & set(b)) >= 40 * len(set(a) | set(b)) for j, b in enumerate(items)] for i, a in enumerate(items)]
    assert neardup.linked(items, 40, columns=7).tolist() == want


def test_components(spark):
    r = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in r.integers(0, 400, (230, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    label = {x: x for link in links for x in link}
    for _ in range(200):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {x.id: x.component for x in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    alone = {a for a, b in links if a == b}
    assert got == {k: v for k, v in label.items() if k in got}
    assert set(label) - set(got) <= alone


# --- 9 ---

URLS = {
    "http://a.example.org/es/1": ("a.example.org", "/es/1", "example.org/es/", "block"),
    "HTTP://Example.ORG/en/12?x": ("example.org", "/en/12", "example.org/en/1", "block"),
    "x://example.org/en/2#y": ("example.org", "/en/2", "org/", "allow"),
    "x://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
    "https://b.com/fr/x": ("b.com", "/fr/x", "com/fr/", "allow"),
    "https://b.com/de/": ("b.com", "/de/", "com/de/", "block"),
    "https://org": ("org", "", None, "allow"),
    "https://xorg/": ("xorg", "/", None, "allow"),
    "https://c.net?q/de/": ("c.net", "", None, "allow"),
    "no scheme": ("", "", None, "allow"),
    "://": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
}


def test_urls(spark):
    rows = [(i, u, "<p>cheap flights</p>" if i % 2 else None) for i, u in enumerate([*URLS, "https://b.com/de/"])] + [(None, "https://b.com/de/", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit("own")).withColumn("token", F.lit("own"))
    got = urls.judge(pages).collect()
    assert len(got) == len(rows)
    want = {i: URLS[u] for i, u, _ in rows}
    for r in got:
        assert (r.host, r.path, r.rule) == want[r.page_id][:3]
        if r.rule or not r.host:
            assert r.verdict == want[r.page_id][3]
    assert urls.judge(pages.limit(0)).count() == 0


def test_urls_learn(spark):
    rows = [(i, f"http://h{i}.com/de/casinobonus{i}", "casino bonus flower garden") for i in range(60)] + [(100 + i, f"http://h{i}.org/flowergarden{i}", None) for i in range(60)]
    rows += [(1000, "http://bonuscasino.net/casino/bonus", None), (1001, "http://gardenflower.net/flower", None)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1000].verdict, got[1001].verdict) == ("block", "allow")


def test_urls_are_those_of_the_plain_model(spark):
    """Plain word counts, Viterbi over all substrings and naive Bayes, on all pages and URLs of odd forms."""
    pages = spark.read.parquet(f"{DIR}/pages.parquet").select("page_id", "url", "html")
    odd = [(10_000 + i, u, None) for i, u in enumerate(["http://b.com/de/" + "theand" * 9, "https://ñandu.net/Thingof-2x/THE%20and?x", "ftp://the.and.net/", "x", None, "://", "http://a.com/de/x//y#z", "https://" + "ingthe" * 12 + ".io/and"])]
    pages = pages.unionByName(spark.createDataFrame(odd, "page_id long, url string, html string"))
    rows = pages.collect()
    count = collections.Counter(w for r in rows for w in re.findall("[a-z]+", ascii_lower(re.sub("<[^>]*>", " ", r.html or ""))))
    total = sum(count.values())

    def cut(name):
        best = {0: (0.0, [])}
        for end in range(1, len(name) + 1):
            options = []
            for start in range(end):
                word = name[start:end]
                if len(word) <= urls.LONGEST_WORD or word == name:
                    p = math.log10(count[word] / total) if count[word] else 1 - math.log10(total) - 1.2 * len(word)
                    options.append((best[start][0] + p, -start, [*best[start][1], word]))
            p, _, words_ = max(options)
            best[end] = (p, words_)
        return best[len(name)][1]

    def parts(url):
        at = (url or "").find("://")
        rest = url[at + 3 :] if at >= 0 else ""
        host = re.match("[^/?#]*", rest)[0]
        return ascii_lower(host), re.match("[^?#]*", rest[len(host) :])[0]

    def rule(host, path):
        fits = [(len(h + p), h + p, act) for act, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    tokens = {}
    for r in rows:
        host, path = parts(r.url)
        names = re.findall("[a-z]+|#", host + " " + ascii_lower(re.sub("[0-9]+", "#", path)))
        tokens[r.page_id] = [t for n in names for t in ([n] if n == "#" else cut(n))]
    seen, docs_ = {"allow": collections.Counter(), "block": collections.Counter()}, collections.Counter()
    for r in rows:
        act = rule(*parts(r.url))[1]
        if act:
            docs_[act] += 1
            seen[act].update(tokens[r.page_id])
    v, na, nb = len({*seen["allow"], *seen["block"]}), seen["allow"].total(), seen["block"].total()
    sure = math.log(urls.SURE / (1 - urls.SURE))
    decided = collections.Counter()
    for r in urls.judge(pages).collect():
        url = next(x.url for x in rows if x.page_id == r.page_id)
        assert (r.host, r.path) == parts(url)
        name, act = rule(r.host, r.path)
        assert r.rule == name
        x = math.log((docs_["block"] + 1) / (docs_["allow"] + 1)) + sum(math.log((seen["block"][t] + 1) / (nb + v + 1)) - math.log((seen["allow"][t] + 1) / (na + v + 1)) for t in tokens[r.page_id])
        if act or abs(x - sure) > 1e-9:
            assert r.verdict == (act or ("block" if x > sure else "allow"))
        decided[act is None] += 1
    assert min(decided.values()) > 5


def test_best_cut():
    count = {"cheap": 50, "flights": 30, "heap": 5, "c": 1, "flight": 20, "s": 3}
    name = "cheapflights"
    known = {(i, j): count[name[i:j]] for i in range(12) for j in range(i + 1, 13) if name[i:j] in count}
    assert urls.best_cut(name, known, 200) == ["cheap", "flights"]
    assert urls.best_cut("qqq", {}, 200) == ["qqq"]
    assert urls.best_cut("", {}, 0) == []


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in entries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", list(entries.SQL))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    result = con.execute(entries.SQL[name])
    names = [c[0] for c in result.description]
    plain = lambda rows: sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    got = entries.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(names)
    assert plain(got.select(*names).collect()) == plain(result.fetchall())


ELSEWHERE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
from lumensift.llm import entries
for name, query in entries.QUERIES.items():
    print(name, query(spark, {data!r}).count())
"""


def test_executors_need_no_copy_of_the_package(tmp_path):
    """All queries from a driver that alone can import the package."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = ELSEWHERE.format(repo=repo, shared=f"file://{tmp_path}/shared", data=DIR)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(done.stdout.split("\n")) == len(entries.QUERIES) + 1
