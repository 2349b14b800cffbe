"""Lexical search, decontamination and alignment against brute force, on the smallest tables with edge cases added, and on edge cases alone."""

import collections
import hashlib
import json
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from test_llm_operators import DIR, DOC, LONG, ascii_lower, clash, docs, empty  # noqa: F401

from lumensift.llm import align, common, decontam, lexical

ITEM = "item_id long, text string, doc_id long, window string, term long, score long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [ascii_lower(t) for t in TERM.findall(text or "")]


@pytest.fixture(scope="module")
def items(spark):
    """Items of the given table, with edge cases, and columns named as the operators name theirs."""
    rows = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    rows += [(9001, None), (9002, ""), (9003, "..."), (9004, "One"), (9005, "TWO one"), (9006, " ".join(LONG.split()[100:700])), (9007, "w1x1 w2x2"), (9007, "w1x1 w2x2 w3x3"), (None, "w5x5 w6x6")]
    rows += [(9008, "nothing of this kind occurs in any of the documents here"), rows[0], (9009, "Ünïcode 123"), (9010, rows[1][1]), (9011, "No ID here")]
    return spark.createDataFrame([(i, t, 1, "w", 2, 3) for i, t in rows], ITEM).repartition(2).cache()


def plain_ranking(docs, items, k):
    docs = [(i, collections.Counter(terms(t))) for i, t in docs]
    of = collections.defaultdict(set)
    for i, t in items:
        of[i] |= set(terms(t))
    n_docs, n_terms = sum(bool(c) for _, c in docs), sum(c.total() for _, c in docs)
    df = collections.Counter(t for _, c in docs for t in c)
    out = {}
    for item, own in of.items():
        found = []
        for doc_id, c in docs:
            m = 50 + 50 * c.total() * n_docs // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if score > 0:
                found.append((-score, doc_id is None, doc_id))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        for rank, (score, _, doc_id) in enumerate(found[:k], 1):
            out[item, rank] = (doc_id, -score)
    return out


@pytest.mark.parametrize("block, round_terms, places", [(8 << 20, 1 << 20, 1 << 22), (20_000, 300, 200)])
def test_lexical(docs, items, clash, monkeypatch, block, round_terms, places):  # noqa: F811
    monkeypatch.setattr(lexical, "ROUND_TERMS", round_terms)
    monkeypatch.setattr(lexical, "PLACES", places)
    want = plain_ranking([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 12)
    got = lexical.search(lexical.index(clash, block), items, 12)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in got.collect()} == want
    assert any(i is None for i, _ in want) and any(d is None for d, _ in want.values())


def test_lexical_takes_the_smallest_ids_of_equal_documents(spark):
    rows = [(i, "one text in many copies", None, None, 0) for i in range(500, 0, -1)] + [(1000, "other words", None, None, 0)]
    d = spark.createDataFrame(rows, DOC).repartition(4)
    got = lexical.search(lexical.index(d, 300), spark.createDataFrame([(1, "many COPIES")], "item_id int, text string"), 7)
    assert [(r["rank"], r.doc_id) for r in got.orderBy("rank").collect()] == [(i, i) for i in range(1, 8)]
    assert got.schema["item_id"].dataType.simpleString() == "int"


def test_lexical_without_rows(spark, docs, empty, items):  # noqa: F811
    assert lexical.search(lexical.index(empty), items).count() == 0
    assert lexical.search(lexical.index(docs), items.limit(0)).count() == 0
    assert lexical.search(lexical.index(docs), items.filter("item_id in (9001, 9002, 9003, 9008) and text <> ''")).filter("score <= 0").count() == 0


def test_range_maximum():
    rng = np.random.default_rng(1)
    lists = [np.sort(rng.choice(300, n, False)).astype(np.int64) for n in (1, 2, 7, 64, 65, 200)]
    impacts = [rng.integers(1, 50, len(x)) for x in lists]
    p = lexical.Postings(lists, impacts)
    for _ in range(300):
        t = int(rng.integers(len(lists)))
        a, b = np.sort(rng.integers(0, len(lists[t]) + 1, 2))
        top = p.top(np.array([p.begin[t] + a]), np.array([p.begin[t] + b]))
        assert p.impact[top[0]] == max(impacts[t][a:b].tolist(), default=0)
        assert a == b or p.begin[t] + a <= top[0] < p.begin[t] + b


@pytest.mark.parametrize("seed", range(4))
def test_exploring_is_exact_and_leaves_documents_out(seed):
    rng = np.random.default_rng(seed)
    n, lists, impacts = 2000, [], []
    for share in (0.02, 0.1, 0.3, 0.6):
        own = np.flatnonzero(rng.random(n) < share)
        lists.append(own)
        impacts.append((rng.pareto(1.2, len(own)) * 10 / share).astype(np.int64) + 1)
    score = np.zeros(n, np.int64)
    for own, x in zip(lists, impacts, strict=True):
        score[own] += x
    ids = np.sort(rng.choice(10**6, n, False))
    best = lexical.Best(10)
    scored = lexical.explore(best, np.arange(4), lexical.Postings(lists, impacts), ids, 4)
    order = np.lexsort((ids, -score))[:10]
    assert best.ids.tolist() == ids[order].tolist() and best.scores.tolist() == score[order].tolist()
    assert scored < n / 4


def plain_hits(texts, items, window=10):
    """For each text: its words, the places that are hit, the ids of items that occur."""
    wins = collections.defaultdict(set)
    for i, t in items:
        w = terms(t)
        size = min(len(w), window)
        for s in range(len(w) - size + 1 if w else 0):
            wins[tuple(w[s : s + size])].add(i)
    sizes = {len(w) for w in wins}
    out = []
    for t in texts:
        w, hit, found = terms(t), set(), set()
        for size in sizes:
            for s in range(len(w) - size + 1):
                own = wins.get(tuple(w[s : s + size]))
                if own:
                    hit |= set(range(s, s + size))
                    found |= own
        out.append((len(w), hit, sorted(str(i) for i in found if i is not None)))
    return out


LEAKS = [
    (200_001, "nothing of this kind occurs in any of the documents here"),
    (200_002, "of this kind occurs in any of the documents"),
    (200_003, "before. Nothing-of THIS kind\noccurs in any: of the documents, here after"),
    (200_004, "in any of the documents here"),
    (200_005, "a a a a a a a a a a a a a a a"),
    (None, "one, two"),
    (200_006, "Two one two"),
]


@pytest.mark.parametrize("bits, rows", [(decontam.BITS, decontam.ROWS), (6, 700)])
def test_decontam(spark, docs, items, clash, monkeypatch, bits, rows):  # noqa: F811
    monkeypatch.setattr(decontam, "ROWS", rows)
    monkeypatch.setattr(decontam.bits_of, "__defaults__", (bits,))
    more = spark.createDataFrame(LEAKS + LEAKS[:1], "doc_id long, text string")
    d = clash.unionByName(more, allowMissingColumns=True)
    own = items.unionByName(spark.createDataFrame([(9100, "a a a a a a a a a a a"), (9101, "a a a")], "item_id long, text string"), allowMissingColumns=True)
    given = d.select("doc_id", "text").collect()
    want = plain_hits([r.text for r in given], [(r.item_id, r.text) for r in own.collect()])
    got = decontam.contaminated(d, own)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    rows_ = [(r.doc_id, n, len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)) for r, (n, hit, found) in zip(given, want, strict=True)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rows_))
    assert sum(r[2] > 0 for r in rows_) > 5 and any(r[2] and not r[3] for r in rows_) is False
    stay = decontam.clean(d, own, 0.5)
    assert stay.columns == d.columns
    assert sorted(repr((r.doc_id, r.text)) for r in stay.collect()) == sorted(repr((r.doc_id, r.text)) for r, (n, hit, _) in zip(given, want, strict=True) if not n or len(hit) <= 0.5 * n)


def test_decontam_without_rows(docs, empty, items):  # noqa: F811
    assert decontam.contaminated(empty, items).count() == 0
    got = decontam.contaminated(docs, items.filter("item_id in (9001, 9002, 9003)"))
    assert got.count() == docs.count() and got.filter("contaminated or n_hit <> 0 or n_items <> 0").count() == 0
    assert decontam.contaminated(docs, items.limit(0)).filter("contaminated").count() == 0


def test_decontam_names_passages_and_windows(spark):
    d = spark.createDataFrame([(1, "x y " + "a b c d e f g h i j k" + " z " + "b c d e f g h i j k")], "doc_id long, text string")
    own = spark.createDataFrame([("i", "a b c d e f g h i j k l"), ("j", "b c d e f g h i j k")], "item_id string, text string")
    found = decontam.search(d, own)
    assert sorted((r.start, r.end, r.n_windows) for r in decontam.passages(found).collect()) == [(2, 13, 2), (14, 24, 1)]
    assert sorted((r.item_id, r.window) for r in found.members.collect()) == [("i", "a b c d e f g h i j"), ("i", "b c d e f g h i j k"), ("j", "b c d e f g h i j k")]


def test_prefix_is_the_rarest_shingle(spark):
    """Of a window of common words and one rare run, only the places of the rare run leave the documents."""
    common_words = " ".join("abcdefgh")
    d = spark.createDataFrame([(i, common_words + " filler") for i in range(30)] + [(99, common_words + " rare words")], "doc_id long, text string")
    own = spark.createDataFrame([(1, common_words + " rare words")], "item_id long, text string")
    found = decontam.search(d, own)
    assert [(r.doc_id, r.start) for r in found.hits.collect()] == [(99, 0)]
    _, places = found.docs, decontam.places(d, spark.createDataFrame([(1,)], "shingle long"), [5], 10)
    assert places.filter("shingle is not null").count() == 0


@pytest.fixture(scope="module")
def files():
    import public_tokenizers as p

    with open(p.path("byte_bpe_50k.json")) as a, open(p.path("piece_bpe_32k.model"), "rb") as b:
        return a.read(), b.read(), p.PATTERN


def plain_groups(text, a, b, a_table, b_table):
    """(A ids, B ids) of each group, by offsets in a set."""
    if not text:
        return []
    ids, raw = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)), (" " + text).encode()
    own = [[t[0][t[1][i] : t[1][i] + t[2][i]].tobytes() for i in x] for x, t in zip(ids, (a_table, b_table), strict=True)]
    if any(b"".join(x) != raw for x in own):
        return []
    ends = [np.cumsum([len(t) for t in x]).tolist() for x in own]
    shared, groups = sorted(set(ends[0]) & set(ends[1])), []
    for at, end in zip([0, *shared], shared, strict=False):
        groups.append(tuple([i for i, e in zip(x, y, strict=True) if at < e <= end] for x, y in zip(ids, ends, strict=True)))
    return groups


def plain_alignment(rows, files):
    from tokenizers import Tokenizer
    from sentencepiece import SentencePieceProcessor

    a, b = Tokenizer.from_str(files[0]), SentencePieceProcessor(model_proto=files[1])
    a.encode_special_tokens = True
    tables = align.Pair(files[0], None, files[1], files[2])
    groups = [plain_groups(t, a, b, tables.a_bytes, tables.b_bytes) for _, t in rows]
    links = [collections.Counter((x, y) for g, h in own for x in g for y in h) for own in groups]
    count = collections.Counter(p for own in links for p in own)
    most = collections.defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return [
        (i, sum(len(g) for g, _ in own), sum(len(h) for _, h in own), len(own), n.total(), sum(c for p, c in n.items() if count[p] == most[p[0]]), sum(c * count[p] for p, c in n.items()),
         hashlib.sha256(";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in own).encode()).hexdigest() if own else "")
        for (i, _), own, n in zip(rows, groups, links, strict=True)
    ]


ODD = ["a" * 3000, " " * 2500 + "x", "\x00", "<|endoftext|> <s> <0x41>", "▁x", "﻿x​ 　y", "՘ab ֋", "\U0001f642\U0001f642 é", "\n\n\t ", "it's we'LL 12345 ½"]


def test_alignment(spark, docs, clash, files, monkeypatch):  # noqa: F811
    monkeypatch.setattr(align, "BLOCK_BYTES", 30_000)
    short = clash.filter("text is null or length(text) < 20000")
    d = short.unionByName(spark.createDataFrame([(300_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"), allowMissingColumns=True)
    want = plain_alignment([(r.doc_id, r.text) for r in d.collect()], files)
    got = align.align(d, *files)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert sum(w[1] == 0 for w in want) > 3 and max(w[4] for w in want) > 3000


def test_alignment_without_rows(empty, files):  # noqa: F811
    assert align.align(empty, *files).count() == 0


def test_tokens_are_those_of_the_library(files, docs):  # noqa: F811
    """By ranks, which holds for these files, or by the library, whichever a text goes to."""
    from tokenizers import Tokenizer

    ranks = align.ranks_of(files[0])
    assert ranks is not None
    pair, own = align.Pair(files[0], ranks, *files[1:]), Tokenizer.from_str(files[0])
    own.encode_special_tokens = True
    texts = [r.text or "" for r in docs.collect()] + ODD
    assert [pair.usual(t) for t in ODD] == [False, False, True, True, False, False, False, False, True, True]
    assert [x.tolist() for x in pair.encode_a(texts)] == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


def test_ranks_are_refused_where_merges_differ(files):
    x = json.loads(files[0])
    swapped = x["model"]["merges"][:]
    swapped[10], swapped[11] = swapped[11], swapped[10]
    assert align.ranks_of(json.dumps(x | {"model": x["model"] | {"merges": swapped}})) is None
    assert align.ranks_of(json.dumps(x | {"normalizer": {"type": "NFC"}})) is None
    assert align.ranks_of(json.dumps(x | {"pre_tokenizer": x["pre_tokenizer"] | {"add_prefix_space": True}})) is None


@pytest.mark.parametrize("lane", [1, 2, 7, 1000])
def test_cuts_of_lanes_are_those_of_documents(lane):
    rng = np.random.default_rng(lane)
    size = rng.integers(0, 60, 40)
    ends = [[np.unique(np.append(rng.integers(1, n + 1, int(rng.integers(1, n + 1))), n)) if n else np.zeros(0, int) for n in size] for _ in range(2)]
    at = common.row_starts(size)
    a, b = (np.concatenate([x + s for x, s in zip(e, at[:-1], strict=True)]) for e in ends)
    docs_at = [common.row_starts(np.array([len(x) for x in e])) for e in ends]
    got_a, got_b = align.cuts(a, b, *docs_at, lane)
    assert a[got_a - 1].tolist() == b[got_b - 1].tolist() == np.intersect1d(a, b).tolist()


def test_links_of_long_groups_are_taken_together(monkeypatch):
    monkeypatch.setattr(align, "LINKS", 4)
    a, b = np.array([5] * 1000 + [6, 7, 9]), np.array([3, 4] * 700 + [8])
    found = collections.Counter()
    parts = list(align.pairs(a, b, np.array([1002, 1003]), np.array([1400, 1401]), np.array([0, 1])))
    for doc, key, times in parts:
        for d, k, t in zip(doc.tolist(), key.tolist(), times.tolist(), strict=True):
            found[d, k >> 32, k & 0xFFFFFFFF] += t
    assert found == {(0, x, y): n * 700 for x, n in ((5, 1000), (6, 1), (7, 1)) for y in (3, 4)} | {(1, 9, 8): 1}
    assert max(len(p[0]) for p in parts) <= 4


def test_empty_batches():
    none = pa.record_batch([pa.array([], pa.int64()), pa.array([], pa.string())], names=["doc_id", "text"])
    assert list(common.text_slices(iter([none]))) == []
