"""Cleaning, chunking and labels: the branches that the tables don't reach."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumensift.functions import text as T
from lumensift.operators import chunking


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("impor-\ntant", "important"),
        ("a-\nb-\nc", "ab-\nc"),
        ("one\n12\ntwo", "one\n\ntwo"),
        ("one\n- 3 -\ntwo", "one\n\ntwo"),
        ("one\n–4–\ntwo", "one\n\ntwo"),
        ("one\npAGE 3 of 9\ntwo", "one\n\ntwo"),
        ("17", ""),
        ("a\t \tb", "a b"),
        ("a\n\n\n\nb", "a\n\nb"),
        ("a\x00b", "a b"),
        (" a\x1f", "a"),
        (None, ""),
    ],
)
def test_clean_loaded(spark, raw, clean):
    assert one(spark, T.clean_loaded(F.col("t")), t=raw) == clean


def test_cleaning_goes_over_a_text_once(spark):
    # the number of words is computed once for the count of chunks, and no step of cleaning takes a text apart by characters
    pages = spark.createDataFrame([("f", 1, "a b")], "filename string, total_pages int, text string")
    plan = chunking.ingest_report(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert "translate(" not in plan


@pytest.mark.parametrize("text", ["", "a", "a b c d e", "a b c d e f", "a\u2003b\u3000c\x85d\x1fe\nf g", "a\u200bb c d e f"])
def test_has_words(spark, text):
    assert one(spark, T.has_words(F.col("t"), 6).cast("string"), t=text) == str(len(text.split()) >= 6).lower()


def reference_chunks(words, size, overlap, least=8):
    out, start = [], 0
    if len(words) < least:
        return out
    while start < len(words):
        part = words[start : start + size]
        if len(part) >= least:
            out.append(" ".join(part))
        if start + size >= len(words):
            break
        start += max(size - overlap, 1)
    return out


@pytest.mark.parametrize("n", [0, 7, 8, 450, 451, 820, 821, 1000])
def test_windows(spark, n):
    words = [f"w{i}" for i in range(n)]
    got = one(spark, chunking.windows(T.words(F.col("t"))), t=" ".join(words))
    assert got == reference_chunks(words, 450, 80)


@settings(max_examples=15, deadline=None)
@given(n=st.integers(0, 120), size=st.integers(1, 40), overlap=st.integers(0, 45))
def test_windows_property(spark, n, size, overlap):
    words = [f"w{i}" for i in range(n)]
    want = reference_chunks(words, size, overlap)
    assert one(spark, chunking.windows(T.words(F.col("t")), size, overlap), t=" ".join(words)) == want
    assert one(spark, chunking.window_count(F.size(T.words(F.col("t"))), size, overlap), t=" ".join(words)) == len(want)


def test_chunk_numbers_run_over_pages(spark):
    page = " ".join(f"w{i}" for i in range(10))
    rows = spark.createDataFrame([("a b.pdf", 1, page), ("a b.pdf", 2, ""), ("a b.pdf", 3, page), ("", 1, page)], "filename string, page int, text string")
    got = [(r.chunk_id, r.page) for r in chunking.chunks(rows).orderBy("chunk_id").collect()]
    assert got == [("official_a_b.pdf_chunk_0", 1), ("official_a_b.pdf_chunk_1", 3), ("official_unknown_chunk_0", 1)]


def test_chunk_numbers_of_many_pages(spark, monkeypatch):
    """Blocks of a prefix sum, repeated pages, empty ones, parts, and a file without a name."""
    monkeypatch.setattr(chunking, "PAGES", 3)
    text = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    rows = [("a", p, 0, text(p, 900 if p % 4 == 0 else 0 if p % 4 == 1 else 20)) for p in range(1, 20)] + [("a", 4, 0, text(4, 900)), ("b", 1, 1, text(1, 10)), ("b", 1, 0, text(2, 10)), (None, 1, 0, text(3, 10))]
    pages = spark.createDataFrame(rows, "filename string, page int, part int, text string").repartition(3)
    got = chunking.chunks(pages)
    assert "part" in got.columns and "part" not in chunking.chunks(pages.drop("part")).columns
    want, at = [], 0
    for name, p, _, t in rows[:19]:
        for c in reference_chunks(t.split(), chunking.SIZE, chunking.OVERLAP):
            want.append((f"official_a_chunk_{at}", p, c))
            at += 1
    found = [(r.chunk_id, r.page, r.text) for r in got.filter("filename = 'a'").collect()]
    assert sorted(set(found)) == sorted(want) and len(found) == len(want) + 3
    assert sorted((r.chunk_id, r.part) for r in got.filter("filename = 'b'").collect()) == [("official_b_chunk_0", 0), ("official_b_chunk_1", 1)]
    assert got.filter("filename = ''").first()["chunk_id"] == "official_unknown_chunk_0"


def test_no_text_is_put_in_order(spark):
    pages = spark.createDataFrame([("a", p, "some text " * 30) for p in range(5)], "filename string, page int, text string")
    plan = chunking.chunks(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert all("text" not in line.split("],")[-1] for line in plan.splitlines() if "Window" in line)
    below, depth = [], None
    for line in plan.splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        if "Window" in line and depth is None:
            depth = at
        elif depth is not None and at <= depth:
            depth = None
        if depth is not None and "Aggregate" in line:
            below.append(line)
    assert below and "Window" not in chunking.chunks(pages.filter("page = 1"))._jdf.queryExecution().optimizedPlan().toString()


def test_owner_of_uploads(spark):
    page = " ".join(f"w{i}" for i in range(10))
    rows = spark.createDataFrame([("a.txt", page, "Personal", None, ""), ("b.txt", page, "personal", "u 1", "s"), ("c.txt", page, None, None, None)], "filename string, text string, scope string, user_id string, session_id string").withColumn("page", F.lit(1))
    got = [(r.chunk_id, r.user_id, r.session_id, r.uploaded_by) for r in chunking.chunks(rows).orderBy("filename").collect()]
    assert got == [("personal_personal_personal_a.txt_chunk_0", "personal", "personal", "user"), ("personal_u_1_s_b.txt_chunk_0", "u 1", "s", "user"), ("official_c.txt_chunk_0", "admin", "admin", "admin")]


def test_labels(spark):
    assert one(spark, T.safe_id(F.col("t")), t="Zürich plan.pdf") == "Z_rich_plan.pdf"
    assert one(spark, T.safe_id(F.col("t")), t="") == "unknown"
    assert one(spark, T.suggestion_label(F.col("a"), F.col("b")), a=" ", b="Fees") == "Did you mean Fees?"
    assert one(spark, T.suggestion_label(F.col("a"), F.col("b")), a=None, b=None) == "Did you mean one of these?"
    assert one(spark, T.request_text(F.col("a"), F.col("b")), a="", b=" x ") == "x"
    assert one(spark, T.normal(F.col("t")), t="  Où est-ce,  ici? ") == "où estce ici"
    assert one(spark, T.normal_ascii(F.col("t")), t="  Où est-ce,  ici? ") == "o estce ici"
    assert one(spark, T.parsed_suggestions(F.col("t")), t='```json\n["a", " b ", "", "c", "d"]\n```') == ["a", "b", "c"]
    assert one(spark, T.parsed_suggestions(F.col("t")), t="no json")[0] == "What courses are available?"
    assert one(spark, T.suggestions(F.col("t")), t="PG")[1] == "What academic programs are available?"
    assert one(spark, T.html_text(F.col("t")), t="<style>x</style><p>a&amp;b</p>") == " \na&b\n"


def test_age(spark):
    now = dt.datetime(2024, 1, 30, 12)
    rows = spark.createDataFrame([(i, now - dt.timedelta(minutes=m)) for i, m in enumerate((0, 59, 60, 60 * 24, -30, 90, 60 * 36, 59.5))], "i int, t timestamp")
    value, unit = T.age(F.col("t"), F.lit("2024-01-30 12:00:00").cast("timestamp"))
    assert [(r.v, r.u) for r in rows.orderBy("i").select(value.alias("v"), unit.alias("u")).collect()] == [(0, "minute"), (59, "minute"), (1, "hour"), (1, "day"), (-30, "minute"), (1, "hour"), (1, "day"), (59, "minute")]
