"""Store, retrieval, questions, conversations, accounts: literal cases."""

import datetime as dt
import hashlib
import random
from difflib import get_close_matches

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumensift.functions import lexicons
from lumensift.operators import accounts, analytics, answering, blocks, conversations, embed, retrieve, store, understand

CHUNK = "chunk_id string, filename string, scope string, user_id string, department string, deleted boolean, embedding array<double>"


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "query_id int, text string")


def column(df, name, key="query_id"):
    return [r[name] for r in df.orderBy(key).collect()]


def test_upsert_is_idempotent_and_restore_undoes_delete(spark):
    old = spark.createDataFrame([("a", "f", 1), ("b", "f", 1)], "chunk_id string, filename string, v int")
    new = spark.createDataFrame([("b", "f", 2), ("c", "g", 2)], "chunk_id string, filename string, v int")
    once = store.upsert(old, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, store.upsert(once, new).collect())) == [("a", "f", 1), ("b", "f", 2), ("c", "g", 2)]
    rows = old.withColumn("deleted", F.lit(False))
    assert sorted(map(tuple, store.set_deleted(store.set_deleted(rows, "f", True), "f", False).collect())) == sorted(map(tuple, rows.collect()))
    assert store.affected(rows, "nothing").first()["affected"] == 0


def test_replace_removes_stale_and_unreadable(spark):
    old = spark.createDataFrame([("o1", "f", "official"), ("o2", "f", "official"), ("p1", "f", "personal")], "chunk_id string, filename string, scope string")
    none = old.limit(0)
    files = old.select("filename").distinct()
    assert {r.chunk_id for r in store.replace_official(old, none, files).collect()} == {"p1"}
    assert {r.chunk_id for r in store.replace_official(old, none, files, keep_on_empty=True).collect()} == {"o1", "o2", "p1"}


def test_append_checks_lengths(spark):
    base = spark.createDataFrame([], "chunk_id string, filename string, page int, text string, deleted boolean, embedding array<double>")
    rows = spark.createDataFrame([(["x", "y"], [[1.0], [2.0]])], "c array<string>, e array<array<double>>")
    got = store.append(base, F.col("c"), F.lit("f"), F.col("e"), F.lit(None).cast("array<int>"), rows, deleted=F.lit(True))
    assert [(r.text, r.page, r.deleted) for r in got.orderBy("text").collect()] == [("x", 0, True), ("y", 0, True)]
    with pytest.raises(Exception, match="differ in length"):
        store.append(base, F.col("c"), F.lit("f"), F.slice("e", 1, 1), F.lit(None).cast("array<int>"), rows).collect()


def test_snapshot(spark, tmp_path):
    rows = spark.createDataFrame([("a", "official"), ("b", "personal")], "chunk_id string, scope string")
    path = store.save(rows, f"file://{tmp_path}")
    assert store.load(spark, path).filter("scope = 'official'").count() == 1


@pytest.mark.parametrize(
    ("request_", "ids"),
    [
        ({}, {"1", "2", "3"}),
        ({"department": "general"}, {"1", "2", "3"}),
        ({"department": "law"}, {"1", "2"}),
        ({"use_personal": True, "user_id": "u"}, {"4"}),
        ({"use_personal": True}, {"1", "2", "3"}),
        ({"include_deleted": True, "department": "law"}, {"1", "2", "5"}),
    ],
)
def test_chunk_filter(spark, request_, ids):
    rows = [("1", "f", "official", "admin", "law", False, []), ("2", "f", "official", "admin", "general", None, []), ("3", "f", "official", "admin", "art", False, []), ("4", "f", "personal", "u", "law", False, []), ("5", "f", "official", "admin", "law", True, [])]
    assert {r.chunk_id for r in spark.createDataFrame(rows, CHUNK).filter(retrieve.chunk_filter(**request_)).collect()} == ids


@pytest.mark.parametrize("most", [1 << 20, 1])
def test_nearest(spark, monkeypatch, most):
    monkeypatch.setattr(retrieve.blocks, "BROADCAST_BYTES", most)
    rows = [(str(i), "f", "official", "admin", "general", False, v) for i, v in enumerate([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0], [-1.0, 0.0]])]
    q = spark.createDataFrame([(1, [2.0, 0.0], False, None), (2, [0.0, 1.0], True, "nobody")], "query_id int, query_embedding array<double>, use_personal boolean, user_id string")
    c = spark.createDataFrame(rows, CHUNK)
    got = [(r.query_id, r.chunk_id, r.distance) for r in retrieve.nearest(q, c, 0).orderBy("query_id", "rank").collect()]
    assert got == [(1, "0", 0.0), (1, "1", 0.0), (1, "2", 1.0), (1, "3", 1.0), (1, "4", 2.0)]
    again = retrieve.nearest(q, c, 1, fallback="unfiltered").orderBy("query_id").collect()
    assert [(r.query_id, r.chunk_id, r.used_fallback) for r in again] == [(1, "0", False), (2, "2", True)]


def test_budget_stops_and_distance_is_inclusive(spark):
    six = "a b c d e f"
    head = len("[Source 1 | File: f | Page: 1]\n")
    rows = [(1, 1, 0.75, six), (1, 2, 0.1, "x " * 40 + "y"), (1, 3, 0.1, six), (2, 1, 0.76, six), (3, 1, 0.1, "too few words")]
    df = spark.createDataFrame([(q, r, d, t, "f", 1) for q, r, d, t in rows], "query_id int, rank int, distance double, text string, filename string, page int")
    fits = head + len(six)
    assert [(r.query_id, r.rank) for r in retrieve.packed(df, budget=fits).collect()] == [(1, 1)]
    assert retrieve.packed(df, budget=fits - 1).count() == 0
    assert sorted((r.query_id, r.rank) for r in retrieve.packed(df).collect()) == [(1, 1), (1, 2), (1, 3)]
    got = retrieve.contexts(retrieve.packed(df)).first()
    assert got["context"].count("\n\n---\n\n") == 2
    assert [s["id"] for s in got["sources"]] == [1, 2, 3]


def test_routes(spark):
    rows = [(" ", None, None, None, None), ("q", "hi", None, None, None), ("q", None, None, None, None), ("q", None, True, "", None), ("q", None, True, "c", lexicons.NOT_FOUND.upper()), ("q", None, True, "c", ""), ("q", None, True, "c", "yes")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "query_id int, q string, casual string, found boolean, context string, answer string")
    got = df.withColumn("r", retrieve.route(F.col("q"), F.col("casual"), F.col("found"), F.col("context"), F.col("answer")))
    assert column(got, "r") == ["empty", "casual", "no_chunks", "nothing_passed", "refused", "refused", "answered"]


def test_sparse_distance(spark):
    c = spark.createDataFrame([("a", "red green blue"), ("b", "red red"), ("c", None)], "chunk_id string, text string")
    got = {r.chunk_id: r.distance for r in retrieve.sparse_nearest(texts(spark, "Red"), c).collect()}
    assert got == {"a": pytest.approx(1 - 3**-0.5), "b": pytest.approx(0)}
    assert embed.sparse(c, "chunk_id", "text").filter("chunk_id = 'c'").count() == 0


def test_small_talk(spark):
    got = understand.small_talk(texts(spark, "Hello!", "thnak you", "what is the fee", "", "okayy"))
    talk = dict(lexicons.SMALL_TALK)
    assert column(got, "casual") == [talk["hello"], talk["thank you"], None, None, talk["okay"]]


def test_expansions(spark):
    table = dict(lexicons.EXPANSIONS)
    long = "one two three four five six seven fee"
    got = understand.expanded(texts(spark, "hostel fee", "scholrship please", long, "nothing here", "admisssion"))
    assert column(got, "expanded") == [table["fee"], table["scholarship"], long, "nothing here", table["admission"]]


def test_topics(spark):
    got = texts(spark, "PG", "about ug and pg", "p g", "law").select("query_id", understand.topic(F.col("text")).alias("t"), understand.topic(F.col("text"), whole_only=True).alias("w"))
    assert column(got, "t") == ["Post Graduate", "Under Graduate", "Post Graduate", None]
    assert column(got, "w") == ["Post Graduate", None, "Post Graduate", None]


def test_follow_ups_and_history(spark):
    said = ["What is the fee?", "shrt answer", "the facilities for all of us", "Where can people park?", "make it short", "ok what now about it"]
    m = spark.createDataFrame([(1, i, "user", s) for i, s in enumerate(said)], "conv_id int, turn int, role string, content string")
    got = understand.follow_ups(m)
    assert column(got, "is_followup", "turn") == [False, True, True, False, True, True]
    assert column(understand.smart_queries(got), "retrieval_query", "turn") == [said[0], said[0], said[0], said[3], said[3], said[3]]
    h = spark.createDataFrame([(1, "User: Where is room one?\nmore\nAssistant: there\nuser: Who teaches law?\nUser: shrt answer\n User:  "), (2, ""), (3, None), (4, "User: tell me mor")], "query_id int, history string")
    assert [tuple(r) for r in understand.last_questions(h).collect()] == [(1, "Who teaches law?")]
    assert sorted(tuple(r) for r in understand.last_questions(h, use_fuzzy=False).collect()) == [(1, "shrt answer"), (4, "tell me mor")]


def chunk_table(spark):
    text = "the hostel has rooms for three hundred students each year"
    rows = [("a", "f.txt", 1, text, "official", "admin", False), ("b", "g.txt", 1, text + " and more", "personal", "u1", False), ("c", "h.txt", 1, "library opens early in the morning every day", "official", "admin", True), ("d", None, None, "too few words here", "official", "admin", False)]
    return spark.createDataFrame(rows, "chunk_id string, filename string, page int, text string, scope string, user_id string, deleted boolean")


def test_question_path(spark):
    said = [(1, 0, "user", "hi"), (1, 1, "assistant", "Hello"), (1, 2, "user", "how many rooms for students are there in the hostel"), (1, 3, "user", "shrt answer"), (2, 0, "user", " "), (2, 1, "user", "zzzz"), (3, 0, "user", "library opens"), (3, 1, "user", "few words"), (4, 0, "user", "thnak you")]
    m = spark.createDataFrame(said, "conv_id int, turn int, role string, content string").withColumns({"use_personal": F.col("conv_id") == 9, "user_id": F.lit(None).cast("string")})
    got = {r.query_id: r for r in answering.routed(answering.of_conversations(m), chunk_table(spark)).collect()}
    assert {i: r.route for i, r in got.items()} == {"1-0": "casual", "1-2": "ask_model", "1-3": "ask_model", "2-0": "empty", "2-1": "no_chunks", "3-0": "ask_model", "3-1": "nothing_passed", "4-0": "casual"}
    assert (got["1-3"].retrieval_query, got["1-3"].context) == (said[2][3], got["1-2"].context)
    assert [s.file for s in got["1-2"].sources] == ["f.txt"]
    assert [got[i].used_fallback for i in ("1-2", "3-0", "2-0")] == [False, True, None]  # what is deleted is found only where nothing else is
    answers = spark.createDataFrame([("1-2", "Many."), ("1-3", lexicons.NOT_FOUND.upper()), ("3-0", " ")], "query_id string, answer string")
    done = {r.query_id: (r.final_route, r.answer) for r in answering.finished(answering.routed(answering.of_conversations(m), chunk_table(spark)), answers).collect()}
    assert done["1-2"] == ("answered", "Many.") and done["1-3"] == ("refused", lexicons.NOT_FOUND) == done["3-0"] and done["2-1"] == ("no_chunks", lexicons.NOT_FOUND)
    assert done["1-0"] == ("casual", dict(lexicons.SMALL_TALK)["hi"]) and done["2-0"] == ("empty", None)


def test_question_path_of_histories_and_users(spark):
    q = spark.createDataFrame([("x", "make it short", "User: rooms in the hostel for students of the first year\nAssistant: many", True, "u1"), ("y", "hostal", None, False, None), ("z", None, None, None, None)], "query_id string, text string, history string, use_personal boolean, user_id string")
    own = answering.of_histories(q)
    got = {r.query_id: r for r in answering.routed(own, chunk_table(spark)).collect()}
    assert (got["x"].route, got["x"].sources[0].file, got["x"].used_fallback) == ("ask_model", "g.txt", False)
    assert (got["y"].search_text, got["z"].route) == (dict(lexicons.EXPANSIONS)["hostel"], "empty")
    prompts = {r.query_id: r.prompt for r in answering.asked(answering.routed(own, chunk_table(spark)), q.select("query_id", F.col("history").alias("text"))).collect()}
    assert prompts["x"].startswith("Context:\n[Source 1 | File: g.txt | Page: 1]") and "Conversation history:\nUser: rooms" in prompts["x"]


def test_fuzzy_candidates_lose_nothing(spark):
    """The bound is above the ratio: what it leaves out has no match."""
    keys = [k for k, _ in lexicons.EXPANSIONS]
    letters = "abcdefghijklmnoprstu "
    rng = random.Random(5)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(500)}
    for k in keys:
        for _ in range(20):
            w = list(k)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(letters)
            words.add("".join(w))
    t = spark.createDataFrame([(w,) for w in sorted(words)], "text string")
    may = {r.text for r in understand.candidates(t, keys).collect()}
    want = {w: m[0] for w in words if (m := get_close_matches(w, keys, 1, understand.CUTOFF))}
    assert want.keys() <= may and len(may) < len(words) / 2
    assert {r.text: r.match for r in understand.fuzzy(t, keys).collect()} == want


def test_questions_in_rounds(spark, monkeypatch):
    """Questions beyond the bound travel in rounds, with the same results."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    text = lambda: " ".join(rng.choice(words) for _ in range(12))
    c = spark.createDataFrame([(f"c{i:03}", text(), [rng.random() for _ in range(4)], False, "official", "admin", "general") for i in range(200)], "chunk_id string, text string, embedding array<double>, deleted boolean, scope string, user_id string, department string").repartition(3)
    q = spark.createDataFrame([(i, text(), [rng.random() for _ in range(4)], False, None) for i in range(30)], "query_id int, text string, query_embedding array<double>, use_personal boolean, user_id string")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "rank", "chunk_id", F.round("distance", 9)).collect()))
    want = rows(retrieve.sparse_nearest(q, c)), rows(retrieve.nearest(q, c))
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", 1000)
    monkeypatch.setattr(blocks, "ROWS", 7)
    assert (rows(retrieve.sparse_nearest(q, c)), rows(retrieve.nearest(q, c))) == want
    plan = retrieve.sparse_nearest(q, c)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_fuzzy_ties_take_the_greater_key(spark):
    got = understand.fuzzy(texts(spark, "abcd"), ["abce", "abcf"], cutoff=0.7).collect()
    assert [(r.text, r.match) for r in got] == [("abcd", "abcf")]


def test_titles_edits_limits(spark):
    m = spark.createDataFrame([(1, 0, "user", " " + "x" * 41), (1, 1, "assistant", "a"), (2, 0, "assistant", "hello"), (3, 0, "user", "y" * 40)], "conv_id int, turn int, role string, content string")
    assert {r.conv_id: r.title for r in conversations.titles(m).collect()} == {1: "x" * 40 + "...", 2: "New Chat", 3: "y" * 40}
    edit = spark.createDataFrame([(1, 0, "new")], "conv_id int, edit_turn int, new_content string")
    assert sorted(tuple(r) for r in conversations.edited(m, edit).filter("conv_id = 1").collect()) == [(1, 0, "user", "new")]
    many = spark.createDataFrame([(c, t, "user", "q") for c, n in ((1, 4), (2, 5), (3, 6)) for t in range(n)], "conv_id int, turn int, role string, content string")
    assert {r.conv_id: r.at_limit for r in conversations.guests_at_limit(many).collect()} == {1: False, 2: True, 3: True}
    assert spark.range(1).select(conversations.no_answer(F.lit("Well: " + lexicons.NOT_FOUND.upper()))).first()[0]


def test_stored_chats(spark):
    good = '{"activeConversationId":"c1","conversations":[{"id":"c1","title":"t","updatedAt":"2024-01-01T00:00:00Z","messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a","sources":[{"file":"f","page":"1"}]}]},{"id":7,"messages":[{"role":"user","content":"no"}]},{"id":"c2"}]}'
    rows = spark.createDataFrame([("u", good), ("v", "{bad"), ("w", None)], "user_id string, blob string")
    got = conversations.stored(rows).orderBy("turn").collect()
    assert [(r.user_id, r.conv_id, r.turn, r.content) for r in got] == [("u", "c1", 0, "q"), ("u", "c1", 1, "a")]
    assert got[1].sources[0].file == "f"


def test_transcripts_with_sources(spark):
    m = spark.createDataFrame([(1, 0, "user", "q", "10:01"), (1, 1, "assistant", "a", "10:02")], "conv_id int, turn int, role string, content string, time string")
    s = spark.createDataFrame([(1, 1, 1, "g", "?"), (1, 1, 0, "f", "3"), (1, 1, 2, None, None)], "conv_id int, turn int, pos int, file string, page string")
    rule = "\n\n----------------------\n\n"
    assert conversations.transcripts(m, s, assistant="Helper").first()["text"] == f"You (10:01)\nq{rule}Helper (10:02)\na\nSources:\n1. f (Page 3)\n2. g\n3. Unknown source"


def test_paired_history_begins_with_a_new_line(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "lost"), (1, 3, "user", "r"), (1, 4, "assistant", "b")]
    m = spark.createDataFrame(rows, "conv_id int, turn int, role string, content string")
    assert conversations.paired_history(m).first()["text"] == "\nUser: q\nAssistant: a\nUser: r\nAssistant: b"


def test_newest_version_of_a_tie(spark):
    v = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 4, "0"), (2, 9, "c")], "id int, updated_at int, title string")
    assert [tuple(r) for r in conversations.newest(v).collect()] == [(2, 9, "c"), (1, 5, "a")]


def test_topics_are_categories(spark):
    at = dt.datetime(2024, 1, 24)
    asked = ["What is the fee?", "And tuition?", "Which course?", None, "Sports?"]
    rows = [(i, "u", None, q, "a", None, "Games" if q == "Sports?" else " ", None, 1.0, at + dt.timedelta(hours=i)) for i, q in enumerate(asked)]
    logs = spark.createDataFrame(rows, analytics.LOG)
    want = [("Fees", 2), ("Games", 1), ("Others", 1), ("Courses", 1)]  # ties: the newest row first
    assert [tuple(r) for r in analytics.topics(logs).collect()] == want == [tuple(r) for r in analytics.categories(logs).collect()]
    assert analytics.topics(logs, 2).count() == 2


def test_sources_of_contexts(spark):
    c = spark.createDataFrame([("a", None, None, "one two three four five six", 0.1, 1, None, "law")], "query_id string, filename string, page int, text string, distance double, rank int, scope string, department string")
    row = retrieve.contexts(retrieve.packed(c)).first()
    assert row.context == "[Source 1 | File: Unknown document | Page: ?]\none two three four five six"
    assert row.sources[0].asDict() == {"id": 1, "file": "Unknown document", "page": "?", "text": "one two three four five six", "distance": 0.1, "scope": "unknown", "department": "law", "year": "general", "document_type": "general"}


def test_figures_on_few_rows(spark):
    at = dt.datetime(2024, 1, 24)
    rows = [(1, "", "e@x", "q", "a", None, None, None, 1.0, at), (2, "u", None, "q", " ", None, None, None, 2.0, None), (3, "u", None, "q", "", None, None, True, None, at - dt.timedelta(seconds=1))]
    logs = spark.createDataFrame(rows, analytics.LOG)
    assert tuple(analytics.figures(logs).first()) == (3, 2, 1, 2, 2)
    days = analytics.daily(logs, dt.datetime(2024, 1, 30, 23)).orderBy("day").collect()
    assert [(d.queries, d.unanswered) for d in days] == [(1, 0)] + [(0, 0)] * 6
    assert tuple(analytics.figures(logs.limit(0)).first()) == (0, 0, 0, 0, 0)
    assert set(analytics.complete(logs.drop("category", "is_answered")).columns) == set(logs.columns)


def test_invites(spark):
    p = spark.createDataFrame([("a@x", "admin"), ("s@x", "super_admin"), ("t@x", "student")], "email string, role string")
    i = spark.createDataFrame([("p@x", "pending"), ("q@x", "cancelled")], "email string, status string")
    asked = [("A@X ", "admin", "already_admin"), ("s@x", "admin", "already_super_admin"), ("t@x", None, "promote"), ("p@x", "admin", "duplicate_pending"), ("q@x", "admin", "invite"), (" ", "admin", "rejected"), ("z@x", "student", "rejected"), ("y@x", " Admin ", "invite"), ("x@x", "", "invite"), ("w@x", " ", "rejected")]
    got = accounts.resolve_invites(spark.createDataFrame([(n, e, r) for n, (e, r, _) in enumerate(asked)], "n int, email string, role string"), p, i)
    assert column(got, "action", "n") == [a for *_, a in asked]
    assert accounts.activity(got, F.lit("me"), F.current_timestamp()).count() == 4


def test_profiles(spark):
    p = spark.createDataFrame([("1", None, "student"), (None, "2", "admin")], "id string, uuid string, role string")
    who = spark.createDataFrame([("1",), ("2",), ("3",)], "user_id string")
    assert column(accounts.roles(who, p), "allowed", "user_id") == [False, True, False]
    old = spark.createDataFrame([(1, "n", "r")], "id int, full_name string, role string")
    new = spark.createDataFrame([(1, "m"), (2, "k")], "id int, full_name string")
    assert sorted(map(tuple, accounts.upsert_profiles(old, new).collect())) == [(1, "m", "r"), (2, "k", None)]
    names = spark.createDataFrame([(" ", None, "me@x"), (None, None, None)], "a string, b string, c string")
    assert [r[0] for r in names.select(accounts.display_name(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["me", "Guest"]


def test_options_of_histories_and_answers(spark):
    said = [(1, 0, "user", "where is the library"), (1, 1, "assistant", "there"), (1, 2, "user", "who teaches law"), (1, 3, "assistant", lexicons.ERRORS[0] + " Network Error"), (1, 4, "user", "when are the exams"), (1, 5, "user", "make it short"), (1, 6, "assistant", "ok")]
    m = spark.createDataFrame(said, "conv_id int, turn int, role string, content string")
    last = lambda rows, **options: {r.query_id: r.retrieval_query for r in answering.of_conversations(rows, **options).collect()}["1-5"]
    assert last(m) == "when are the exams"
    assert last(m, paired_only=True) == "who teaches law"
    assert last(conversations.without_errors(m), paired_only=True) == "where is the library"
    assert conversations.without_errors(m).count() == 6
    rows = [(1, "u", None, "q", lexicons.NOT_FOUND, None, None, True, 1.0, None), (2, "u", None, "q", "yes", None, None, None, 2.0, None), (3, "u", None, "q", None, None, None, True, 2.0, None)]
    logs = spark.createDataFrame(rows, analytics.LOG)
    assert analytics.figures(logs).first()["answered"] == 3
    assert analytics.figures(logs, lexicons.NOT_FOUND).first()["answered"] == 2


def test_blocks_after_the_first_lose_nothing(spark):
    # one partition of three blocks, the nearest chunks in the last one, copies that tie, personal and deleted ones
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choice(words, n))
    made = [(f"c{i:04}", say(int(rng.integers(1, 60))), "personal" if i % 3 == 0 else "official", f"u{i % 2}", i % 7 == 0) for i in range(2500)]
    asked = [(i, say(8), i % 2 == 0, "u1" if i % 4 else "") for i in range(40)]
    made += [(f"z{i:04}{j}", asked[i][1] + " " + say(2), ("official", "personal")[i % 2 == 0], "u1", False) for i in range(40) for j in range(3)]
    c = spark.createDataFrame(made, "chunk_id string, text string, scope string, user_id string, deleted boolean").coalesce(1)
    q = spark.createDataFrame(asked, "query_id int, text string, use_personal boolean, user_id string")
    vector = lambda t: np.bincount([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 1024 for w in t.split()], minlength=1024)
    x, y = (np.array([vector(r[1]) / np.linalg.norm(vector(r[1])) for r in t]) for t in (made, asked))
    far = np.round(np.maximum(0, 1 - y @ x.T), 9)
    want = set()
    for i, (name, _, own, user) in enumerate(asked):
        fits = [j for j, m in enumerate(made) if not m[4] and (m[2] == "personal" and m[3] == user if own and user else m[2] == "official") and x[j] @ y[i] > 0]
        want |= {(name, made[j][0]) for j in sorted(fits, key=lambda j: (far[i, j], made[j][0]))[:5]}
    for rows in (c, embed.with_counts(c)):
        assert {(r.query_id, r.chunk_id) for r in retrieve.sparse_nearest(q, rows, fallback="none").collect()} == want


def test_counting_is_bounded_by_words():
    import pyarrow as pa

    lists = pa.array([["a"] * 700_000, ["b"] * 700_000, None, ["c"], ["d"] * 2_000_000, []] + [["e"]] * 2000)
    cut = [p.num_rows for p in embed.parts(pa.RecordBatch.from_arrays([lists], names=["t"]), lists)]
    assert cut == [1, 3, 1, 1024, 977]
    known = {}
    embed.buckets(pa.array([str(i) for i in range(embed.KNOWN_WORDS + 10)]), 1024, known)
    embed.buckets(pa.array([f"x{i}" for i in range(1000)]), 1024, known)
    assert len(known) == embed.KNOWN_WORDS <= 1 << 17


def test_a_long_text_is_counted_in_slices(monkeypatch):
    import tracemalloc
    from collections import Counter

    import pyarrow as pa

    def hashed(w):
        return int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64

    texts = [["a", "b"], [], [f"w{i % 13}" for i in range(50)], ["b"], [f"w{i}" for i in range(7)], []]
    monkeypatch.setattr(embed, "HASHED", 4)
    got = list(zip(*(x.tolist() for x in embed.counted(pa.array(texts), 64, {})), strict=True))
    assert got == [(i, b, n) for i, words in enumerate(texts) for b, n in sorted(Counter(map(hashed, words)).items())]
    assert [len(x) for x in embed.counted(pa.array([[], []], pa.list_(pa.string())), 64, {})] == [0, 0, 0]
    monkeypatch.undo()

    words = 3_000_000  # of one text
    lists = pa.ListArray.from_arrays(pa.array([0, words], pa.int32()), pa.array([f"w{i}" for i in range(1000)]).take(pa.array(np.arange(words) % 1000)))
    tracemalloc.start()
    _, _, n = embed.counted(lists, 1024, {})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n.sum() == words and peak < 32 << 20


def test_equal_questions_are_searched_once(spark, monkeypatch):
    made = [(f"c{i}", f"w{i} w{i % 3} common", "personal" if i % 4 == 0 else "official", f"u{i % 2}", i % 7 == 6) for i in range(40)]
    c = spark.createDataFrame(made, "chunk_id string, text string, scope string, user_id string, deleted boolean")
    asked = [(i, ("w1 common", "w2", None, "w4")[i % 4], (True, None)[i % 8 // 4], "u0" if i % 8 < 4 else None) for i in range(32)]
    asked += [(100 + i, "w5", True, f"u{i % 2 + 8}") for i in range(6)]  # without chunks of their own
    asked.append(asked[1])  # a row that comes again
    q = spark.createDataFrame(asked, "query_id int, text string, use_personal boolean, user_id string")
    seen, real = [], retrieve.sparse_hits
    monkeypatch.setattr(retrieve, "sparse_hits", lambda q, c, *a: seen.append((q.count(), c.columns)) or real(q, c, *a))
    got = retrieve.sparse_nearest(q, c, fallback="unfiltered").collect()
    assert seen[0][0] == 10 and seen[1][0] < 10
    assert all("buckets" in columns for _, columns in seen)  # both searches read what was counted once
    monkeypatch.undo()
    rows = lambda found: {(r.chunk_id, r.distance, r["rank"], r.used_fallback) for r in found}
    for i in (0, 1, 2, 3, 5, 7, 29, 101, 104):
        alone = retrieve.sparse_nearest(q.filter(F.col("query_id") == i), c, fallback="unfiltered").collect()
        assert rows(r for r in got if r.query_id == i) == rows(alone) and len(alone) == len(rows(alone)) == sum(r.query_id == i for r in got)
