"""Files and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lumensift.operators import analytics, answering, chunking, retrieve, store
from lumensift.operators.snapshots import Snapshots
from lumensift.plans import inputs, registry
from lumensift.sources import files
from lumensift.streaming import jobs


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {"a.TXT": b"one\r\ntwo", "b.md": b"\xff bad", "c.csv": b"x,y\n1,\n ,\n2,z\n", "d.json": b'{"k": 1}', "e.json": b"{", "f.html": b"<p>hi</p>", "g.exe": b"MZ", "h.sql": b"a\xffb", "i.pdf": b"%PDF", "sub/a.TXT": b"other"}.items():
        (tmp_path / name).write_bytes(data)
    found = files.folder(spark, str(tmp_path))
    got = {(r.source.split(str(tmp_path))[1], r.text, r.error) for r in files.pages_text(found).collect()}
    assert ("/a.TXT", "one\ntwo", None) in got
    assert ("/b.md", None, "unreadable") in got
    assert ("/c.csv", "Row 1: x: 1\nRow 3: x: 2 | y: z", None) in got
    assert {r.filename: r.file_type for r in files.pages_text(found).collect()} == {"a.TXT": "txt", "b.md": "markdown", "c.csv": "csv", "d.json": "json", "e.json": "json", "f.html": "html", "g.exe": "exe", "h.sql": "db_dump", "i.pdf": "pdf"}
    assert ("/d.json", json.dumps({"k": 1}, indent=2).replace("  ", " "), None) in got
    assert ("/e.json", None, "unreadable") in got
    assert ("/f.html", "hi", None) in got
    assert ("/g.exe", None, "unsupported") in got
    assert ("/h.sql", "ab", None) in got
    assert ("/i.pdf", None, "unreadable") in got
    assert files.last_of_name(found).filter("filename = 'a.TXT'").first()["path"].endswith("sub/a.TXT")


def test_files_are_read_once(spark, tmp_path):
    for name in ("a.txt", "b.html", "c.csv", "d.json", "e.sql"):
        (tmp_path / name).write_text("x")
    plan = files.pages_text(files.folder(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan binaryFile") == 1 and plan.count("ArrowEvalPython") == 1 and "Union" not in plan


def test_small_files_of_scan_are_written_by_several_tasks(spark, monkeypatch):
    roots, real = [], inputs.sources.folder
    monkeypatch.setattr(inputs.sources, "folder", lambda s, root: roots.append(root) or real(s, root))
    registry.QUERIES["s1_scan"](spark, "/root/testdata/sf0.01")
    for kind in ("one", "many"):
        written = spark.read.format("binaryFile").load(f"{roots[0]}/{kind}").select(F.regexp_extract("path", "/part-([0-9]+)", 1)).distinct()
        assert written.count() > 1


def test_rows_of_csv(spark):
    rows = [("a,b\n1,2\n\n3,NA\n",), ("a,,a\nnull,x,y\n",), ("\n\nh\n \nv\n",), ("",)]
    got = spark.createDataFrame(rows, "t string").select(files.csv_text(F.col("t")).alias("t"))
    assert [r.t for r in got.collect()] == ["Row 1: a: 1 | b: 2\nRow 2: a: 3", "Row 1: Unnamed: 1: x | a.1: y", "Row 2: h: v", ""]


def test_sheets_of_tables(spark):
    rows = [("t.XLS", 1, "one", i, "x" if i != 3 else " ", None if i % 2 else str(i)) for i in (1, 2, 3, 9, 12)] + [("t.XLS", 2, "two", 1, None, " "), ("t.XLS", 3, "three", 1, "y", "z")]
    df = spark.createDataFrame(rows, "filename string, sheet int, sheet_name string, row_no long, a string, b string").repartition(3)
    got = [(r.page, r.total_pages, r.file_type, r.sheet_name, r.part, r.text) for r in files.sheet_pages(df, ["a", "b"], 5).orderBy("page", "part").collect()]
    assert got == [(1, 3, "xlsx", "one", 0, "Row 1: a: x\nRow 2: a: x | b: 2"), (1, 3, "xlsx", "one", 1, "Row 9: a: x"), (1, 3, "xlsx", "one", 2, "Row 12: a: x | b: 12"), (3, 3, "xlsx", "three", 0, "Row 1: a: y | b: z")]
    cut = chunking.chunks(files.sheet_pages(df.withColumn("a", F.lit("one two three four five six seven eight")), ["a"], 5))
    assert sorted((r.chunk_index, r.page, r.part, r.sheet_name) for r in cut.collect()) == [(0, 1, 0, "one"), (1, 1, 1, "one"), (2, 1, 2, "one"), (3, 2, 0, "two"), (4, 3, 0, "three")]


def test_tables_and_pages(spark):
    rows = [("f.pdf", 1, "prose", [[["h", ""], ["1", "2"], ["x"], [None, " "]]]), ("f.pdf", 2, " ", None), ("f.pdf", 3, "end", [])]
    df = spark.createDataFrame(rows, "filename string, page int, text string, tables array<array<array<string>>>")
    got = files.extracted(df).orderBy("page").collect()
    assert [(r.page, r.total_pages, r.text) for r in got] == [(1, 3, "prose\n\nh\nh: 1\nx"), (3, 3, "end")]


def logs_of(spark, hours):
    at = dt.datetime(2024, 1, 28, 9)
    rows = [(i, f"u{i % 3}" if i % 5 else "", None, "fee?" if i % 2 else "room?", "a" if i % 3 else "", None, None, None, float(i) if i % 4 else None, at + dt.timedelta(hours=h)) for i, h in enumerate(hours)]
    return spark.createDataFrame(rows, analytics.LOG)


def streamed(spark, folder, schema, at_once=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", at_once).parquet(str(folder))


def run(writer, state):
    q = writer.option("checkpointLocation", str(state)).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return q


def come_again(state):
    """Takes the mark off the last batch, as if the process had died before it set it."""
    last = max(int(f.name) for f in (state / "commits").iterdir() if f.name.isdigit())
    (state / "commits" / str(last)).unlink()
    (state / "commits" / f".{last}.crc").unlink(missing_ok=True)
    return last


def test_live_figures_equal_the_batch(spark, tmp_path):
    logs = logs_of(spark, range(40))
    logs.repartition(3).write.parquet(str(tmp_path / "in"))
    days, actors = Snapshots(spark, f"file://{tmp_path}/days", "day", 4), Snapshots(spark, f"file://{tmp_path}/actors", "actor", 4)
    for again in (False, True):
        for name, start in (("d", lambda s: jobs.keep(jobs.live_days(s), days, "days")), ("f", lambda s: jobs.live_figures(s, actors))):
            if again:
                come_again(tmp_path / name)
            run(start(streamed(spark, tmp_path / "in", logs.schema)), tmp_path / name)
    q = jobs.live_categories(streamed(spark, tmp_path / "in", logs.schema)).writeStream.outputMode("complete").format("memory").queryName("kinds").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = analytics.daily(logs, dt.datetime(2024, 1, 30)).filter("queries > 0")
    assert sorted(map(tuple, days.load().select("day", "queries", "unanswered").collect())) == sorted(map(tuple, batch.collect()))
    assert sorted(map(tuple, spark.table("kinds").collect())) == sorted(map(tuple, analytics.categories(logs).collect()))
    assert tuple(jobs.figures(actors.load()).first()) == tuple(analytics.figures(logs).first())
    assert len(days.versions()) == 3  # a batch that came again made none


def test_state_of_old_days_goes_and_late_rows_are_left_out(spark, tmp_path):
    """Days come in order, then one row of the first day: its state is gone, and the table keeps its count."""
    table, state = Snapshots(spark, f"file://{tmp_path}/days", "day", 4), tmp_path / "state"
    schema = logs_of(spark, [0]).schema
    totals = []
    for i, hours in enumerate([range(0, 10), range(24 * 10, 24 * 10 + 5), range(24 * 20, 24 * 20 + 5), [1], range(24 * 21, 24 * 21 + 2)]):
        logs_of(spark, hours).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        q = run(jobs.keep(jobs.live_days(streamed(spark, tmp_path / "in" / "*", schema), "8 days"), table, "days"), state)
        totals.append(max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress[-1:]))
        late = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in q.recentProgress)
        assert (late > 0) == (i == 3)
    assert max(totals) <= 3 and totals[-1] == 2  # five days, two of them still open
    got = {str(r.day): r.queries for r in table.load().collect()}
    assert got == {"2024-01-28": 10, "2024-02-07": 5, "2024-02-17": 5, "2024-02-18": 2}


def test_guest_counts(spark, tmp_path):
    rows = spark.createDataFrame([("s", "user")] * 5 + [("t", "user"), ("t", "assistant")], "session_id string, role string")
    rows.write.parquet(str(tmp_path / "in"))
    q = jobs.guest_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("guests").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("guests").collect())) == [("s", 5, True), ("t", 1, False)]


def test_ingest_stream_replaces_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    words = " ".join(f"w{i}" for i in range(20))
    (source / "a.txt").write_text(words)
    (source / "b.txt").write_text("short")
    (source / "c.md").write_bytes(b"\xff" + words.encode())
    table = Snapshots(spark, f"file://{tmp_path}/chunks", buckets=8)
    old = spark.createDataFrame([("official_a.txt_chunk_0", "a.txt", "official", "old"), ("official_a.txt_chunk_1", "a.txt", "official", "old"), ("p", "a.txt", "personal", "own"), ("y", "b.txt", "official", "old"), ("x", "c.md", "official", "stay"), ("z", "z.txt", "official", "stay")], "chunk_id string, filename string, scope string, text string")
    assert table.commit("load", 0, old, lambda _: old)
    schema = spark.read.format("binaryFile").load(str(source)).schema

    def go():
        run(jobs.ingest(spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", 1).load(str(source)), table), tmp_path / "state")

    go()
    want = [("official_a.txt_chunk_0", "w0 w"), ("p", "own"), ("x", "stay"), ("z", "stay")]
    got = lambda: sorted((r.chunk_id, r.text[:4]) for r in table.load().collect())
    assert got() == want and len(table.versions()) == 4
    last = come_again(tmp_path / "state")
    go()
    assert got() == want and len(table.versions()) == 4 and table.pointer()["batches"] == {"load": 0, "files": last}
    (source / "d").mkdir()
    (source / "d" / "e.txt").write_text(words)
    assert got() == want


def test_snapshots(spark, tmp_path):
    table = Snapshots(spark, f"file://{tmp_path}/t", "k", 4)
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int")
    assert table.load().columns == [] and table.versions() == []
    first = rows(*[(f"k{i}", 0) for i in range(40)])
    assert table.commit("s", 0, first, lambda old: first)
    before, now = table.pointer(), table.load()
    new = rows(("k1", 1))
    assert table.commit("s", 1, new, lambda old: store.upsert(old, new, "k"))
    after = table.pointer()
    assert sum(before["parts"][b] != after["parts"][b] for b in before["parts"]) == 1  # the other buckets stay where they are
    assert now.filter("v = 1").count() == 0 and table.load().filter("v = 1").count() == 1 and table.load().count() == 40
    assert table.load(1).filter("v = 1").count() == 0
    assert not table.commit("s", 1, new, lambda old: old.limit(0)) and not table.commit("s", 0, new, lambda old: old.limit(0))
    assert table.commit("other", 0, new, lambda old: old.filter("k <> 'k1'")) and table.load().count() == 39
    with pytest.raises(ValueError, match="gave rows of"):
        table.commit("s", 9, new, lambda old: first)
    with pytest.raises(ValueError, match="doesn't have"):
        table.commit("s", 9, new, lambda old: old.withColumn("w", F.lit(1)))
    assert table.versions() == [1, 2, 3]
    every = rows(*[(f"k{i}", 2) for i in range(40)])
    assert table.commit("s", 10, every, lambda old: every.select("k")) and table.load().filter("v is null").count() == 40
    assert table.vacuum(1) and table.versions() == [4] and table.load().count() == 40


def test_of_two_writers_one_starts_again(spark, tmp_path):
    a, b = (Snapshots(spark, f"file://{tmp_path}/t", "k", 2) for _ in range(2))
    rows = lambda *x: spark.createDataFrame([(k,) for k in x], "k string")
    a.commit("a", 0, rows("x"), lambda old: rows("x"))
    calls = []

    def slow(old):
        calls.append(old.count())
        if len(calls) == 1:  # another one publishes the next version meanwhile
            assert b.commit("b", 0, rows("x"), lambda o: o.unionByName(rows("x")))
        return old.unionByName(rows("x"))

    assert a.commit("a", 1, rows("x"), slow)
    assert calls == [1, 2] and a.load().count() == 3 and a.pointer()["batches"] == {"a": 1, "b": 0}


def test_question_stream_equals_the_batch(spark, tmp_path):
    text = "one two three four five six"
    chunks = spark.createDataFrame([(str(i), "f", 1, text, "official", "admin", "general", False, [1.0, float(i)]) for i in range(4)], "chunk_id string, filename string, page int, text string, scope string, user_id string, department string, deleted boolean, embedding array<double>")
    q = spark.createDataFrame([(i, f"question {i}" if i else "hello", [1.0, i / 2], False, None) for i in range(3)], "query_id int, text string, query_embedding array<double>, use_personal boolean, user_id string")
    q.repartition(3).write.parquet(str(tmp_path / "in"))
    for again in (False, True):
        if again:
            come_again(tmp_path / "state")
        run(jobs.answer(streamed(spark, tmp_path / "in", q.schema), lambda: chunks, f"file://{tmp_path}/out", 2), tmp_path / "state")
    batch = answering.routed(q, chunks, 2)
    got = jobs.answered(spark, f"file://{tmp_path}/out")
    assert sorted(map(str, got.select(*batch.columns).collect())) == sorted(map(str, batch.collect()))
    assert sorted(r.route for r in got.collect()) == ["ask_model", "ask_model", "casual"] and got.select("batch").distinct().count() > 1
    assert retrieve.nearest(q, chunks, 2).filter(F.col("rank") == 1).count() == 3
