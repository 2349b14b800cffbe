"""Odd inputs of the sources, and the fuzzy rules against plain Python."""

import difflib
import re

import numpy as np
from pyspark.sql import functions as F

from lumensift.functions import lexicons
from lumensift.operators import analytics, blocks, retrieve, understand
from lumensift.sources import files

DIR = "/root/testdata/sf0.001"


def test_unreadable_texts_are_rows(spark):
    long = "x" * 200_000
    rows = [(1, f"a,b\n{long},2\n"), (2, "[" * 100_000), (3, '{"k": ["v"]}'), (4, None), (5, "a\n\x00"), (6, "")]
    got = {r.i: (r.c, r.j) for r in spark.createDataFrame(rows, "i int, t string").select("i", files.csv_text(F.col("t")).alias("c"), files.json_text(F.col("t")).alias("j")).collect()}
    assert got[1] == (f"Row 1: a: {long} | b: 2", None)
    assert got[2][1] is None
    assert got[3][1] == '{\n "k": [\n "v"\n ]\n}'
    assert got[4] == (None, None)
    assert got[6][1] is None


def test_html_page(spark):
    html = "<p>a &eacute; &#233; &#xe9; &amp;lt; <!-- x > y --> b</p><script>no</script>"
    assert spark.createDataFrame([(html,)], "h string").select(files.html_page(F.col("h")).alias("t")).first()["t"] == "\na é é é &lt;  b\n "


def test_entity_that_was_cut(spark, tmp_path):
    from lumensift.plans import registry

    spark.createDataFrame([(1, "<p>R&D&amp</p>&amp;lt; &notin; &notit; &#39;")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert registry.QUERIES["s6_page"](spark, str(tmp_path)).first()["text"] == "\nR&D&amp\n&lt; ∉ &notit; '"
    assert spark.createDataFrame([("R&D&amp",)], "h string").select(files.html_page(F.col("h")).alias("t")).first()["t"] == "R&D&"


def test_logs_keep_columns_of_their_own(spark):
    got = analytics.complete(spark.createDataFrame([(1, "u", "x")], "id long, user_id string, own string"))
    assert set(got.columns) == {c.split()[0] for c in analytics.LOG.split(", ")} | {"own"}
    assert got.select(analytics.answered()).count() == 1


def normal(text):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", text.lower().strip())).strip()


def nearest(word, keys, cutoff=understand.CUTOFF):
    best = max((difflib.SequenceMatcher(None, k, word).ratio(), k) for k in keys)
    return best[1] if best[0] >= cutoff else None


SAID = ["Helo", "gud morning", "thankss", "wat about fee", "admision", "hostell room please tell me now ok", "the hostal", "elaborat", "sumarize", "plain words", "", "THIS", "tell me mor", "eligiblity of a programm", "pg"]


def test_fuzzy_small_talk(spark):
    q = spark.createDataFrame(list(enumerate(SAID)), "query_id int, text string")
    pairs = dict(lexicons.SMALL_TALK)
    for r in understand.small_talk(q).collect():
        n = normal(r.text)
        assert r.casual == (pairs.get(n) or (pairs.get(nearest(n, list(pairs))) if n else None))


def test_fuzzy_follow_ups(spark):
    m = spark.createDataFrame(list(enumerate(SAID)), "turn int, content string")
    for r in understand.follow_ups(m).collect():
        n = normal(r.content)
        assert r.is_followup == (any(p in n for p in lexicons.FOLLOW_UPS) or bool(n and len(n.split()) <= 4 and nearest(n, lexicons.FOLLOW_UPS)))


def test_fuzzy_expansions(spark):
    q = spark.createDataFrame(list(enumerate(SAID)), "query_id int, text string")
    pairs = dict(lexicons.EXPANSIONS)
    for r in understand.expanded(q).collect():
        n = normal(r.text)
        want = None
        if len(n.split()) <= 7:
            want = next((v for k, v in pairs.items() if k in n), None)
            want = want or next((pairs[k] for w in n.split() if (k := nearest(w, list(pairs)))), None)
        assert r.expanded == (want or r.text)


def test_dense_search_in_blocks(spark, monkeypatch):
    """Both ways to meet, small blocks, vectors of two lengths, nulls, zeros and ties, against all pairs."""
    r = np.random.default_rng(4)
    vector = lambda i: None if i == 5 else [0.0] * 4 if i == 6 else [float(x) for x in r.integers(-2, 3, 4 if i % 4 else 3)]
    chunks = [(f"c{i:03d}", vector(i), "personal" if i % 5 == 4 else "official", f"u{i % 3}", "law" if i % 2 else "general", i % 7 == 6) for i in range(120)]
    asked = [(i, vector(i), i % 4 == 3, f"u{i % 3}" if i % 8 else None, "law" if i % 3 == 0 else None) for i in range(30)]
    c = spark.createDataFrame(chunks, "chunk_id string, embedding array<double>, scope string, user_id string, department string, deleted boolean").repartition(3)
    q = spark.createDataFrame(asked, "query_id int, query_embedding array<double>, use_personal boolean, user_id string, department string")
    want = {}
    for i, e, own, user, department in asked:
        near = []
        for key, v, scope, holder, of, gone in chunks:
            fits = (scope == "personal" and holder == user) if own and user else scope == "official" and (department is None or of in (department, "general"))
            if not gone and fits and e is not None and v is not None and len(e) == len(v):
                n = np.linalg.norm(e) * np.linalg.norm(v)
                near.append((round(max(0.0, 1 - float(np.dot(e, v)) / n), 9) if n else 1.0, key))
        want |= {(i, k, n + 1): d for n, (d, k) in enumerate(sorted(near)[:5])}
    monkeypatch.setattr(blocks, "ROWS", 7)
    for most in (1 << 20, 1):
        monkeypatch.setattr(blocks, "BROADCAST_BYTES", most)
        hits = retrieve.dense_hits(q, c, 5).withColumn("distance", F.round("distance", 9))
        got = {(x.query_id, x.chunk_id, x["rank"]): x.distance for x in retrieve.ranked(hits).collect()}
        assert got == want
    near = retrieve.dense_hits(q, c, farthest=0.5).count()
    assert near == retrieve.dense_hits(q, c).filter("distance <= 0.5").count() > 0
