"""The pipeline's stages against plain versions of them, each on its own input."""

import collections

import numpy as np
from pyspark.sql import functions as F
from test_llm_operators import DOC, EDGES

import corpus_pipeline
from lumensift.llm import bpe, quality

DIR = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().lower().split()


def test_pipeline(spark, tmp_path):
    import public_tokenizers as P
    import tiktoken

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, before, out = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, DIR).write.parquet(str(tmp_path / name))
        before = spark.read.parquet(str(tmp_path / name))
        out[name] = before.collect()
        if name != "bpe":
            assert before.columns == columns
    rows = {r.doc_id: r for r in docs.collect()}

    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    score = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert {r.doc_id for r in out["quality"]} == {d for d, s in score.items() if s >= quality.THRESHOLD}
    assert all(r == rows[r.doc_id] for r in out["quality"])

    sets = {r.doc_id: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for r in out["quality"] if (w := words(r.text))}
    label = {d: d for d in sets}
    for _ in range(10):  # links of links
        for a, x in sets.items():
            for b, y in sets.items():
                if a < b and 100 * len(x & y) >= 80 * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
    assert {r.doc_id for r in out["neardup"]} == {r.doc_id for r in out["quality"] if label.get(r.doc_id, r.doc_id) == r.doc_id}

    assert {r.doc_id for r in out["substring"]} == {r.doc_id for r in out["neardup"]}
    seen = collections.defaultdict(set)
    for r in out["substring"]:
        assert r.n_chars == len(r.text)
        w = words(r.text)
        for i in range(len(w) - 49):
            if len(set(w[i : i + 50])) > 5:
                seen[tuple(w[i : i + 50])].add(r.doc_id)
    assert max(map(len, seen.values()), default=1) == 1
    for r in out["substring"]:  # what is left is the old text without some words
        rest = iter(words(rows[r.doc_id].text))
        assert all(w in rest for w in words(r.text))

    source, size = {r.doc_id: r.source for r in out["substring"]}, {r.doc_id: len(words(r.text)) for r in out["substring"]}
    copies = collections.Counter(r.doc_id for r in out["mixing"])
    assert set(copies) <= set(size)
    assert max(copies.values()) <= 3
    total = sum(size.values())
    assert abs(sum(copies[d] * n for d, n in size.items()) - total) < total / 2

    assert len(out["bpe"]) == len(out["mixing"])
    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(lines), special_tokens={})
    text = {r.doc_id: r.text for r in out["mixing"]}
    for r in out["bpe"]:
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(text[r.doc_id])
    assert source


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, DIR)
    assert {"doc_id", "ids", "n_tokens"} <= set(got.columns)
    assert got.count() > 0


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DIR).count() == 0


def test_stages_on_edges(spark, tmp_path):
    """Nulls, empties, repeats, ties and clashing columns through every stage, each on what the one before has kept."""
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()][:80]
    docs = spark.createDataFrame(rows + rows[:5] + [(100_000 + i, r[1], None, None, None) for i, r in enumerate(rows[5:10])] + EDGES, DOC).repartition(3)
    names = ("score", "size", "cls", "label", "th", "words", "mix_size", "own_mix_size", "neardup_kept", "held_out", "kept", "component_id")
    before = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in names])
    before.write.parquet(str(tmp_path / "docs"))
    before = spark.read.parquet(str(tmp_path / "docs"))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, DIR).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        old, new = (collections.Counter(map(tuple, df.collect())) for df in (before, after))
        assert new
        if name != "bpe":
            assert after.columns == before.columns
        if name == "quality":
            assert all(new[r] in (0, n) for r, n in old.items()) and new <= old
            of_text = collections.defaultdict(set)
            for r in old:
                of_text[r[1]].add(r in new)
            assert all(len(x) == 1 for k, x in of_text.items() if k)
        if name == "neardup":
            assert set(new) <= set(old) and max(new.values()) == 1
            assert all(new[r] for r in old if not words(r[1]))
        if name == "substring":
            assert new.total() == old.total()
            own = lambda rows: collections.Counter(r[:4] + r[5:] for r, n in rows.items() for _ in range(n) if r[0] is None or r[1] is None)
            assert own(new) == own(old)  # but for n_chars, which is counted anew wherever there is a text
        if name == "mixing":
            assert set(new) <= set(old) and all(n <= 3 * old[r] for r, n in new.items())
            again = stage(spark, before, DIR)
            assert collections.Counter(map(tuple, again.collect())) == new
        if name == "bpe":
            assert new.total() == old.total() and {"lang", "source", *names} <= set(after.columns)
        before = after
