"""One query for each operator over the given tables, and the same in SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumensift.functions import lexicons
from lumensift.functions import text as T
from lumensift.operators import accounts, analytics, chunking, conversations, embed, retrieve, store, understand
from lumensift.sources import files as sources
from lumensift.storage import written

from .views import NOW, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CLOCK = dt.datetime.fromisoformat(NOW)


def query(name: str, sql: str | None, *tables: str):
    """Registers a function of the named views as a query."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*[view(spark, sf_dir, t) for t in tables])
        if sql:
            SQL[name] = with_views(sql)
        return f

    return add


def in_order(rows: DataFrame) -> DataFrame:
    """A short sorted list with each row's place, so that its order is held against SQL too."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))


W = r"[^\p{L}\p{N}_\s]"  # neither of a word nor white space, in both dialects
NORMAL = rf"trim(regexp_replace(regexp_replace(lower(trim(content)), '{W}', '', 'g'), '\s+', ' ', 'g'))"

# --- text ---


@query("p2_clean_chunk", r"SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '\n{3,}', E'\n\n', 'g'), '[ \t]+', ' ', 'g'), E' \n\t\r') AS text FROM documents", "documents")
def _(d):
    return d.select("doc_id", T.clean_chunk(F.col("text")).alias("text"))


@query("p1_clean_loaded", r"SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g'), E' \n\t\r') AS text FROM documents", "documents")
def _(d):
    return d.select("doc_id", T.clean_loaded(F.col("text")).alias("text"))


@query("p3_chunks", "SELECT chunk_id, filename, page, chunk_index, scope, user_id, session_id, uploaded_by, department, document_type, year, deleted, text FROM chunks_v", "files_v")
def _(f):
    return chunking.chunks(f).select("chunk_id", "filename", "page", F.col("chunk_index").cast("long"), "scope", "user_id", "session_id", "uploaded_by", "department", "document_type", "year", "deleted", "text")


#: Pages of books, a third of all pages in one; some come again, some are empty.
BOOKS = "SELECT CASE WHEN doc_id % 3 = 0 THEN 'book_0.pdf' ELSE 'book_' || CAST(CAST(floor(doc_id / 7) AS BIGINT) AS VARCHAR(20)) || '.pdf' END AS filename, CAST(doc_id + 1 AS INT) AS page, CASE WHEN doc_id % 11 = 4 THEN '' ELSE text END AS text, doc_id FROM {documents}"


@query("p4_numbering", f"""
WITH b AS ({BOOKS.format(documents="documents")}), w AS (SELECT *, string_split_regex(trim(text), '\\s+') AS w FROM b WHERE trim(coalesce(text, '')) <> ''),
n AS (SELECT *, CASE WHEN len(w) <= 450 THEN 0 ELSE CAST(ceil((len(w) - 450) / 370.0) AS BIGINT) END AS last FROM w WHERE len(w) >= 8),
c AS (SELECT filename, page, w, unnest(range(last + 1)) AS i FROM n),
r AS (SELECT filename, page, array_to_string(w[i * 370 + 1 : i * 370 + 450], ' ') AS text, row_number() OVER (PARTITION BY filename ORDER BY page, i) - 1 AS chunk_index FROM c WHERE len(w[i * 370 + 1 : i * 370 + 450]) >= 8)
SELECT 'official_' || filename || '_chunk_' || chunk_index AS chunk_id, filename, page, chunk_index, text FROM r""", "documents")
def _(d):
    books = d.sparkSession.sql(BOOKS, documents=d).drop("doc_id")
    again = books.filter("page % 13 = 5")
    made = chunking.chunks(books.unionByName(again)).select("chunk_id", "filename", "page", F.col("chunk_index").cast("long").alias("chunk_index"), "text")
    return made.dropDuplicates(["chunk_id"])


@query("p5_safe_id", r"SELECT doc_id, regexp_replace(replace(text, ' ', '_'), '[^A-Za-z0-9_.-]', '_', 'g') AS safe FROM documents WHERE text <> ''", "documents")
def _(d):
    return d.filter("text <> ''").select("doc_id", T.safe_id(F.col("text")).alias("safe"))


@query("p8_row_text", "SELECT p_partkey, 'Row ' || p_partkey || ': p_name: ' || p_name || ' | p_brand: ' || p_brand || ' | p_type: ' || p_type || ' | p_size: ' || p_size AS text FROM part", "part")
def _(p):
    return p.select("p_partkey", sources.row_text(["p_name", "p_brand", "p_type", "p_size"], F.col("p_partkey")).alias("text"))


@query("p10_embed", r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM documents),
b AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % 1024 AS INTEGER) AS bucket, CAST(count(*) AS DOUBLE) AS n FROM t GROUP BY ALL)
SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM b""", "documents")
def _(d):
    return embed.sparse(d, "doc_id", "text").select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


@query("p11_normal", f"SELECT conv_id, turn, {NORMAL} AS text FROM messages_v", "messages_v")
def _(m):
    return m.select("conv_id", "turn", T.normal(F.col("content")).alias("text"))


@query("p12_normal_ascii", r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(content), '[^A-Za-z0-9_\s]', '', 'g'), '\s+', ' ', 'g')) AS text FROM messages_v", "messages_v")
def _(m):
    return m.select("conv_id", "turn", T.normal_ascii(F.col("content")).alias("text"))


@query("p14_context_part", "SELECT * FROM (SELECT chunk_id, '[Source 1 | File: ' || CASE WHEN chunk_index % 2 = 0 THEN filename ELSE 'Unknown document' END || ' | Page: ' || CASE WHEN chunk_index % 3 > 0 THEN '?' ELSE CAST(page AS VARCHAR) END || ']' || chr(10) || text AS part FROM chunks_v WHERE len(string_split_regex(text, '\\s+')) >= 6) WHERE length(part) <= 8000", "files_v")
def _(f):
    i = F.col("chunk_index")
    c = chunking.chunks(f).withColumn("filename", F.when(i % 2 == 0, F.col("filename"))).withColumn("page", F.when(i % 3 == 0, F.col("page")))
    return retrieve.packed(c.withColumns({"query_id": F.col("chunk_id"), "rank": F.lit(1), "distance": F.lit(0.0)})).select("chunk_id", "part")


@query("p16_temperature", "SELECT event_id, CASE WHEN value IS NULL THEN 0.1 ELSE greatest(0.0, least(1.0, value / 60)) END AS temperature FROM events", "events")
def _(e):
    return e.select("event_id", retrieve.clamped(F.col("value") / 60).alias("temperature"))


@query("p17_display", "SELECT id, CASE WHEN length(full_name) > 12 THEN left(full_name, 12) || '...' ELSE full_name END AS short, split_part(full_name, ' ', 1) AS first, split_part(email, '@', 1) AS local FROM profiles_v", "profiles_v")
def _(p):
    return p.select("id", T.shortened(F.col("full_name"), 12).alias("short"), T.first_name(F.col("full_name")).alias("first"), T.local_part(F.col("email")).alias("local"))


@query("p18_age", f"""
WITH m AS (SELECT id, CAST(floor((epoch_us(created_at) - epoch_us(TIMESTAMP '{NOW}')) / 60e6 + 0.5) AS BIGINT) AS m FROM logs_v),
h AS (SELECT *, CAST(floor(m / 60.0 + 0.5) AS BIGINT) AS h FROM m), d AS (SELECT *, CAST(floor(h / 24.0 + 0.5) AS BIGINT) AS d FROM h)
SELECT id, -CASE WHEN abs(m) < 60 THEN m WHEN abs(h) < 24 THEN h ELSE d END AS age, CASE WHEN abs(m) < 60 THEN 'minute' WHEN abs(h) < 24 THEN 'hour' ELSE 'day' END AS unit FROM d""", "logs_v")
def _(logs):
    value, unit = T.age(F.col("created_at"), F.lit(NOW).cast("timestamp"))
    return logs.select("id", value.cast("long").alias("age"), unit.alias("unit"))


@query("p19_type_label", "SELECT doc_id, CASE split_part(filename, '.', -1) WHEN 'pdf' THEN 'PDF' WHEN 'txt' THEN 'TXT' WHEN 'html' THEN 'WEB' WHEN 'csv' THEN 'DATA' ELSE 'DOC' END AS label FROM files_v", "files_v")
def _(f):
    return f.select("doc_id", T.type_label(F.col("filename")).alias("label"))


@query("p20_email", "SELECT id, lower(trim(email)) AS email, trim(regexp_replace(full_name, '\\s+', ' ', 'g')) AS name FROM profiles_v", "profiles_v")
def _(p):
    return p.select("id", T.email(F.col("email")).alias("email"), T.person_name(F.col("full_name")).alias("name"))


@query("p24_labels", "SELECT id, CASE WHEN coalesce(category, '') = '' THEN 'General' ELSE category END AS category, CASE WHEN id % 5 = 0 THEN '0' ELSE format('{:,}', id * 1000) END AS number FROM logs_v", "logs_v")
def _(logs):
    return logs.select("id", T.category_label(F.col("category")).alias("category"), T.number_label(F.when(F.col("id") % 5 > 0, F.col("id") * 1000)).alias("number"))


HTML = "coalesce(html, '')"
for _tag in ("script", "style", "head"):
    HTML = f"regexp_replace({HTML}, '(?is)<{_tag}\\b.*?</{_tag}>', ' ', 'g')"
HTML = f"regexp_replace(regexp_replace({HTML}, '(?i)</?(p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|nav)\\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')"
for _e, _s in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    HTML = f"replace({HTML}, '{_e}', '{_s}')"


@query("s6_html_text", f"SELECT page_id, {HTML} AS text FROM pages", "pages")
def _(p):
    return p.select("page_id", T.html_text(F.col("html")).alias("text"))


@query("s8_json_text", None, "events")
def _(e):
    return e.select("event_id", sources.json_text(F.col("props")).alias("text"))


# --- store ---


@query("s10_upsert", "SELECT chunk_id, filename, label FROM (SELECT chunk_id, filename, 'old' AS label FROM vec_chunks_v WHERE vec_id % 3 <> 0 UNION ALL SELECT chunk_id, filename, 'new' FROM vec_chunks_v WHERE vec_id % 3 = 0)", "vec_chunks_v")
def _(c):
    old = c.select("chunk_id", "filename", F.lit("old").alias("label"))
    return store.upsert(old, c.filter("vec_id % 3 = 0").select("chunk_id", "filename", F.lit("new").alias("label")))


@query("m2_replace_official", "SELECT chunk_id, filename, scope FROM vec_chunks_v WHERE NOT (scope = 'official' AND filename IN ('file_1.txt', 'file_2.txt')) UNION ALL SELECT chunk_id || '_new', filename, 'official' FROM vec_chunks_v WHERE filename = 'file_1.txt' AND vec_id % 2 = 0", "vec_chunks_v")
def _(c):
    new = c.filter("filename = 'file_1.txt' and vec_id % 2 = 0").select(F.concat("chunk_id", F.lit("_new")).alias("chunk_id"), "filename", F.lit("official").alias("scope"))
    return store.replace_official(c.select("chunk_id", "filename", "scope"), new, c.filter("filename in ('file_1.txt', 'file_2.txt')"))


@query("m4_soft_delete", "SELECT chunk_id, deleted OR filename = 'file_3.txt' AS deleted FROM vec_chunks_v", "vec_chunks_v")
def _(c):
    return store.set_deleted(c, "file_3.txt", True).select("chunk_id", "deleted")


@query("m5_restore", "SELECT chunk_id, deleted AND filename <> 'file_3.txt' AS deleted FROM vec_chunks_v", "vec_chunks_v")
def _(c):
    return store.set_deleted(c, "file_3.txt", False).select("chunk_id", "deleted")


@query("m6_hard_delete", "SELECT chunk_id FROM vec_chunks_v WHERE filename <> 'file_4.txt'", "vec_chunks_v")
def _(c):
    return store.hard_delete(c, "file_4.txt").select("chunk_id")


@query("f2_delete_official", "SELECT chunk_id FROM vec_chunks_v WHERE NOT (filename = 'file_4.txt' AND scope = 'official')", "vec_chunks_v")
def _(c):
    return store.hard_delete(c, "file_4.txt", "official").select("chunk_id")


@query("m4_affected", "SELECT count(*) AS affected FROM vec_chunks_v WHERE filename = 'file_3.txt'", "vec_chunks_v")
def _(c):
    return store.affected(c, "file_3.txt")


@query("a2_statistics", "SELECT count(*) AS total, count_if(deleted) AS deleted, count(DISTINCT filename) AS files, count_if(NOT deleted) AS active FROM chunks_v", "files_v")
def _(f):
    return store.statistics(chunking.chunks(f))


@query("a2_files", "SELECT DISTINCT filename FROM chunks_v", "files_v")
def _(f):
    return store.files(chunking.chunks(f))


@query("a3_files", "SELECT DISTINCT filename FROM files_v WHERE NOT deleted", "files_v")
def _(f):
    return store.files(f, only_active=True)


@query("m1_all_files", "SELECT filename FROM vec_chunks_v UNION SELECT filename FROM files_v", "vec_chunks_v", "files_v")
def _(c, f):
    return store.all_files(c, f)


@query("a1_ingest_report", r"""
WITH p AS (SELECT filename, max(total_pages) AS pages_processed, sum(length(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g'), E' \n\t\r'))) AS chars FROM files_v GROUP BY 1),
c AS (SELECT filename, count(*) AS chunks FROM chunks_v GROUP BY 1)
SELECT p.filename, CAST(pages_processed AS BIGINT) AS pages_processed, CAST(chars AS BIGINT) AS text_extracted_chars, coalesce(chunks, 0) AS chunks, upper(split_part(p.filename, '.', -1)) AS file_type, CASE WHEN chunks > 0 THEN 'Success' ELSE 'Failed' END AS status
FROM p LEFT JOIN c ON p.filename = c.filename""", "files_v")
def _(f):
    return chunking.ingest_report(f)


# --- retrieval ---

ADMISSIBLE = """NOT c.deleted AND CASE WHEN q.use_personal AND q.user_id <> '' THEN c.scope = 'personal' AND c.user_id = q.user_id
  ELSE c.scope = 'official' AND (q.department IS NULL OR q.department IN ('', 'general') OR c.department IN (q.department, 'general')) END"""
DIST = "greatest(0.0, 1 - list_cosine_similarity(CAST(q.query_embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])))"


@query("f1_filter", f"SELECT q.query_id, count(*) AS admissible FROM vec_questions_v q JOIN vec_chunks_v c ON {ADMISSIBLE} GROUP BY 1", "vec_questions_v", "vec_chunks_v")
def _(q, c):
    # counts of chunks by whom they are open to, met by equality
    kinds = c.filter(~F.coalesce(F.col("deleted"), F.lit(False))).groupBy("scope", "user_id", "department").agg(F.count(F.lit(1)).alias("n"))
    key = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("of"))
    every, general = key("all", F.lit("")), key("department", F.lit("general"))
    open_to = F.when(F.col("scope") == "personal", F.array(key("user", F.col("user_id")))).when(F.col("scope") == "official", F.array(every, key("department", F.col("department"))))
    counts = kinds.select(F.explode_outer(open_to).alias("key"), "n").groupBy("key.kind", "key.of").agg(F.sum("n").alias("n"))
    own, want = F.coalesce(F.col("use_personal"), F.lit(False)) & F.coalesce(F.col("user_id") != "", F.lit(False)), F.col("department")
    asks = F.when(own, F.array(key("user", F.col("user_id")))).when(want.isNull() | want.isin("", "general"), F.array(every)).otherwise(F.array(key("department", want), general))
    asked = q.select("query_id", F.explode_outer(asks).alias("key")).select("query_id", "key.kind", "key.of")
    return asked.join(counts, ["kind", "of"]).groupBy("query_id").agg(F.sum("n").alias("admissible"))


@query("j1_nearest", f"""
WITH h AS (SELECT q.query_id, c.chunk_id, {DIST} AS d FROM vec_questions_v q JOIN vec_chunks_v c ON {ADMISSIBLE}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS rank FROM h)
SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(d, 6) + 0.0 AS distance FROM r WHERE rank <= 5""", "vec_questions_v", "vec_chunks_v")
def _(q, c):
    return retrieve.nearest(q, c).select("query_id", "chunk_id", "rank", (F.round("distance", 6) + 0.0).alias("distance"))


@query("j2_fallback", f"""
WITH h AS (SELECT q.query_id, c.chunk_id, {DIST} AS d FROM vec_questions_v q JOIN vec_chunks_v c ON {ADMISSIBLE}),
g AS (SELECT q.query_id, c.chunk_id, {DIST} AS d FROM vec_questions_v q JOIN vec_chunks_v c ON q.query_id NOT IN (SELECT query_id FROM h)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS rank FROM (SELECT *, false AS used_fallback FROM h UNION ALL SELECT *, true FROM g))
SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, used_fallback FROM r WHERE rank <= 5""", "vec_questions_v", "vec_chunks_v")
def _(q, c):
    return retrieve.nearest(q, c, fallback="unfiltered").select("query_id", "chunk_id", "rank", "used_fallback")


@query("f4_distance_cut", f"SELECT q.query_id, count(*) AS near FROM vec_questions_v q JOIN vec_chunks_v c ON {ADMISSIBLE} WHERE {DIST} <= 0.75 GROUP BY 1", "vec_questions_v", "vec_chunks_v")
def _(q, c):
    return retrieve.dense_hits(q, c, farthest=retrieve.FARTHEST).groupBy("query_id").agg(F.count(F.lit(1)).alias("near"))


SPARSE = r"""
tok AS (SELECT 'q' AS kind, CAST(item_id AS VARCHAR) AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM benchmark
  UNION ALL SELECT 'c', chunk_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) FROM chunks_v),
buc AS (SELECT kind, id, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % 1024 AS bucket, CAST(count(*) AS DOUBLE) AS n FROM tok GROUP BY ALL),
wei AS (SELECT kind, id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY kind, id)) AS w FROM buc),
hit AS (SELECT CAST(q.id AS BIGINT) AS query_id, c.id AS chunk_id, round(greatest(0.0, 1 - sum(q.w * c.w)), 9) AS distance FROM wei q JOIN wei c ON q.bucket = c.bucket WHERE q.kind = 'q' AND c.kind = 'c' GROUP BY ALL),
ran AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM hit QUALIFY rank <= 5)"""


def _search(f: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    # both written down: the chunks are read twice, and few hits meet them without moving their texts
    c = written(chunking.chunks(f).select("chunk_id", "filename", "page", "text", "scope", *retrieve.FACETS), "chunks")
    return c, written(retrieve.sparse_nearest(b.select(F.col("item_id").alias("query_id"), "text"), c), "hits")


@query("j1_sparse_nearest", f"WITH {SPARSE} SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(distance, 6) + 0.0 AS distance FROM ran", "files_v", "benchmark")
def _(f, b):
    return _search(f, b)[1].select("query_id", "chunk_id", "rank", (F.round("distance", 6) + 0.0).alias("distance"))


@query("w2_context", f"""
WITH {SPARSE},
par AS (SELECT r.query_id, r.rank, '[Source ' || r.rank || ' | File: ' || c.filename || ' | Page: ' || c.page || ']' || chr(10) || trim(c.text) AS part FROM ran r JOIN chunks_v c ON r.chunk_id = c.chunk_id
  WHERE r.distance <= 0.75 AND len(string_split_regex(trim(c.text), '\\s+')) >= 6),
run AS (SELECT *, sum(length(part)) OVER (PARTITION BY query_id ORDER BY rank) AS s FROM par)
SELECT query_id, string_agg(part, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n_sources FROM run WHERE s <= 8000 GROUP BY 1""", "files_v", "benchmark")
def answer_contexts(f, b):
    c, hits = _search(f, b)
    return retrieve.contexts(retrieve.packed(hits.join(c, "chunk_id"))).select("query_id", "context", F.size("sources").cast("long").alias("n_sources"))


@query("a15_sample", "SELECT substr(string_agg(text, chr(10) || chr(10) ORDER BY chunk_id), 1, 2500) AS sample FROM (SELECT chunk_id, text FROM chunks_v WHERE NOT deleted ORDER BY chunk_id LIMIT 8)", "files_v")
def _(f):
    return retrieve.suggestion_sample(chunking.chunks(f))


# --- questions ---


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


FOLLOW = " OR ".join(f"contains(n, {_quoted(p)})" for p in lexicons.FOLLOW_UPS)


@query("f6_followups", f"SELECT conv_id, turn, {FOLLOW} AS is_followup FROM (SELECT *, {NORMAL} AS n FROM messages_v WHERE role = 'user')", "messages_v")
def _(m):
    return m.filter("role = 'user'").select("conv_id", "turn", understand.has_pattern(F.col("content")).alias("is_followup"))


@query("w3_smart_query", f"""
WITH u AS (SELECT conv_id, turn, trim(content) AS text, {FOLLOW} AS f FROM (SELECT *, {NORMAL} AS n FROM messages_v WHERE role = 'user')),
l AS (SELECT *, last_value(CASE WHEN NOT f AND text <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM u)
SELECT conv_id, turn, CASE WHEN f AND p IS NOT NULL THEN p ELSE text END AS retrieval_query, f AND p IS NOT NULL AS used_history FROM l""", "messages_v")
def _(m):
    return understand.smart_queries(m, understand.has_pattern(F.col("content"))).select("conv_id", "turn", "retrieval_query", "used_history")


@query("j3_small_talk", "SELECT conv_id, turn, CASE {} END AS casual FROM (SELECT *, {} AS n FROM messages_v WHERE role = 'user')".format(" ".join(f"WHEN n = {_quoted(k)} THEN {_quoted(v)}" for k, v in lexicons.SMALL_TALK), NORMAL), "messages_v")
def _(m):
    q = m.filter("role = 'user'").select("conv_id", "turn", F.col("content").alias("text"))
    return understand.small_talk(q, use_fuzzy=False).select("conv_id", "turn", "casual")


@query("j4_expand", "SELECT conv_id, turn, CASE WHEN len(string_split(n, ' ')) > 7 THEN content {} ELSE content END AS expanded FROM (SELECT *, {} AS n FROM messages_v WHERE role = 'user')".format(" ".join(f"WHEN contains(n, {_quoted(k)}) THEN {_quoted(v)}" for k, v in lexicons.EXPANSIONS), NORMAL), "messages_v")
def _(m):
    q = m.filter("role = 'user'").select("conv_id", "turn", F.col("content").alias("text"))
    return understand.expanded(q, use_fuzzy=False).select("conv_id", "turn", "expanded")


@query("u1_fuzzy", None, "messages_v")
def _(m):
    words = m.select(F.explode(T.words(T.normal(F.col("content")))).alias("word"))
    return understand.fuzzy(words, [k for k, _ in lexicons.EXPANSIONS], "word")


@query("j5_topic", None, "messages_v")
def _(m):
    return m.filter("role = 'user'").select("conv_id", "turn", understand.topic(F.col("content")).alias("topic"))


# --- conversations ---


@query("w4_pairs", "SELECT conv_id, turn, content AS question, a AS answer FROM (SELECT *, lead(role) OVER w AS r, lead(content) OVER w AS a FROM messages_v WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant'", "messages_v")
def _(m):
    return conversations.pairs(m)


@query("p13_history", "SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || content, chr(10) ORDER BY turn) AS text FROM messages_v GROUP BY 1", "messages_v")
def _(m):
    return conversations.history(m)


@query("a13_paired_history", "SELECT conv_id, string_agg(chr(10) || 'User: ' || content || chr(10) || 'Assistant: ' || a, '' ORDER BY turn) AS text FROM (SELECT *, lead(role) OVER w AS r, lead(content) OVER w AS a FROM messages_v WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant' GROUP BY 1", "messages_v")
def _(m):
    return conversations.paired_history(m)


@query("a12_titles", "SELECT conv_id, CASE WHEN coalesce(t, '') = '' THEN 'New Chat' WHEN length(t) > 40 THEN left(t, 40) || '...' ELSE t END AS title FROM (SELECT conv_id, trim(min_by(content, turn) FILTER (role = 'user')) AS t FROM messages_v GROUP BY 1)", "messages_v")
def _(m):
    return conversations.titles(m)


@query("a11_latest_answers", "SELECT conv_id, max_by(content, turn) AS answer FROM messages_v WHERE role = 'assistant' GROUP BY 1", "messages_v")
def _(m):
    return conversations.latest_answers(m)


@query("f9_guest_limit", "SELECT conv_id, count_if(role = 'user') AS asked, count_if(role = 'user') >= 2 AS at_limit FROM messages_v GROUP BY 1", "messages_v")
def _(m):
    return conversations.guests_at_limit(m, 2)


@query("w5_first_files", "SELECT query_id, filename, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p) AS INTEGER) AS place FROM (SELECT q.query_id, c.filename, min(c.vec_id) AS p FROM vec_questions_v q JOIN vec_chunks_v c ON c.vec_id > q.query_id AND c.vec_id < q.query_id + 12 GROUP BY 1, 2) QUALIFY place <= 3", "vec_questions_v", "vec_chunks_v")
def _(q, c):
    near = q.select("query_id", F.explode(F.sequence(F.col("query_id") + 1, F.col("query_id") + 11)).alias("vec_id")).join(c.select("vec_id", "filename"), "vec_id")
    return conversations.first_files(near.select(F.col("query_id").alias("answer_id"), F.col("vec_id").alias("pos"), F.col("filename").alias("file"))).select(F.col("answer_id").alias("query_id"), F.col("file").alias("filename"), "place")


@query("w6_newest_versions", "SELECT conversation_id AS id, CAST(created_at AS DATE) AS updated_at, min(question) AS question FROM logs_v WHERE created_at IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY CAST(created_at AS DATE) DESC) = 1", "logs_v")
def _(logs):
    # versions of one day are ties
    return conversations.newest(logs.filter("created_at is not null").select(F.col("conversation_id").alias("id"), F.to_date("created_at").alias("updated_at"), "question"))


@query("w7_edit", "SELECT conv_id, turn, role, content FROM messages_v WHERE turn < 2 OR conv_id % 2 = 1 UNION ALL SELECT DISTINCT conv_id, CAST(2 AS BIGINT), 'user', 'edited' FROM messages_v WHERE conv_id % 2 = 0", "messages_v")
def _(m):
    return conversations.edited(m, m.filter("conv_id % 2 = 0").select("conv_id", F.lit(2).cast("long").alias("edit_turn"), F.lit("edited").alias("new_content")).distinct())


@query("s13_logged", "SELECT id FROM logs_v WHERE user_id IS NOT NULL AND trim(question) <> '' AND trim(coalesce(answer, '')) <> ''", "logs_v")
def _(logs):
    return conversations.logged(logs).select("id")


@query("j8_delete_logs", "SELECT id FROM logs_v a WHERE NOT EXISTS (SELECT 1 FROM logs_v b WHERE b.id % 40 = 0 AND b.user_id = a.user_id AND b.conversation_id = a.conversation_id) AND NOT EXISTS (SELECT 1 FROM logs_v b WHERE b.id % 40 = 1 AND b.user_id = a.user_id AND b.question = a.question AND b.answer = a.answer)", "logs_v")
def _(logs):
    gone = logs.filter("id % 40 in (0, 1)").withColumn("conversation_id", F.when(F.col("id") % 40 == 0, F.col("conversation_id")))
    return conversations.without_conversation(logs, gone).select("id")


@query("s15_transcripts", """
SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'You' ELSE 'Bot' END || ' (10:' || turn || ')' || chr(10) || content || CASE WHEN role <> 'user' AND conv_id % 3 = 0
  THEN chr(10) || 'Sources:' || chr(10) || '1. f' || turn || '.pdf (Page 2)' || chr(10) || '2. Unknown source (Page 7)' || chr(10) || '3. g.txt' ELSE '' END, chr(10) || chr(10) || '----------------------' || chr(10) || chr(10) ORDER BY turn) AS text
FROM messages_v GROUP BY 1""", "messages_v")
def _(m):
    m = m.withColumn("time", F.concat(F.lit("10:"), F.col("turn").cast("string")))
    cited = F.array(*[F.struct(F.lit(i).alias("pos"), file.alias("file"), F.lit(page).alias("page")) for i, file, page in ((2, F.lit("g.txt"), "?"), (0, F.concat(F.lit("f"), F.col("turn").cast("string"), F.lit(".pdf")), "2"), (1, F.lit(None).cast("string"), "7"))])
    sources_ = m.filter("role <> 'user' and conv_id % 3 = 0").select("conv_id", "turn", F.inline(cited))
    return conversations.transcripts(m, sources_, assistant="Bot")


# --- analytics ---

ANSWERED = "coalesce(is_answered, trim(coalesce(answer, '')) <> '')"
ACTOR = "coalesce(nullif(user_id, ''), nullif(user_email, ''))"
CASES = " ".join(f"WHEN regexp_matches(lower(question), '{p}') THEN '{c}'" for c, p in lexicons.CATEGORIES)
SHORT_CASES = " ".join(f"WHEN regexp_matches(lower(question), '{p}') THEN '{c}'" for c, p in lexicons.CATEGORIES[:4])


@query("f8_answered", f"SELECT id, {ANSWERED} AS a, trim(coalesce(answer, '')) <> '' AS b, coalesce(is_answered, true) AS c FROM logs_v", "logs_v")
def _(logs):
    return logs.select("id", analytics.answered().alias("a"), analytics.has_answer().alias("b"), analytics.not_unanswered().alias("c"))


@query("a4_figures", f"SELECT count(*) AS total, count_if({ANSWERED}) AS answered, count_if(NOT {ANSWERED}) AS unanswered, count(DISTINCT {ACTOR}) AS active_users, CAST(coalesce(floor(avg(response_time_ms) + 0.5), 0) AS BIGINT) AS mean_response_ms FROM logs_v", "logs_v")
def _(logs):
    return analytics.figures(logs)


@query("a4_figures_not_found", "SELECT count(*) AS total, count_if(a) AS answered, count_if(NOT a) AS unanswered FROM (SELECT coalesce(is_answered, trim(coalesce(answer, '')) <> '') AND NOT contains(lower(coalesce(answer, '')), 'answer 1') AS a FROM logs_v)", "logs_v")
def _(logs):
    return analytics.figures(logs, "ANSWER 1").select("total", "answered", "unanswered")


@query("t1_figures", f"SELECT count(*) AS total, count_if({ANSWERED}) AS answered, count(DISTINCT {ACTOR}) AS active_users FROM (SELECT * FROM logs_v ORDER BY created_at DESC NULLS LAST, id LIMIT 500)", "logs_v")
def _(logs):
    return analytics.figures(analytics.newest(logs, 500)).select("total", "answered", "active_users")


@query("a5_dashboard", f"SELECT (SELECT count(DISTINCT filename) FROM files_v) AS documents, count(*) AS queries, count_if(trim(coalesce(answer, '')) = '') AS unanswered, count(DISTINCT {ACTOR}) AS active_users, (SELECT count(*) FROM profiles_v) AS registered_users FROM logs_v", "logs_v", "files_v", "profiles_v")
def _(logs, f, p):
    return analytics.dashboard(logs, f, p)


DAILY = f"""
SELECT d.day, coalesce(q, 0) AS queries, coalesce(u, 0) AS unanswered FROM (SELECT CAST(unnest(range(DATE '2024-01-24', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day) d
LEFT JOIN (SELECT CAST(created_at AS DATE) AS day, count(*) AS q, count_if(NOT {ANSWERED}) AS u FROM logs_v WHERE created_at IS NOT NULL GROUP BY 1) l ON d.day = l.day"""


@query("a6_daily", DAILY, "logs_v")
def _(logs):
    return analytics.daily(logs, CLOCK)


@query("a7_week", f"SELECT CAST(sum(queries) AS BIGINT) AS total, round(sum(queries) / 7.0, 1) AS per_day FROM ({DAILY})", "logs_v")
def _(logs):
    return analytics.week(analytics.daily(logs, CLOCK))


@query("a8_categories", f"SELECT CASE WHEN trim(coalesce(category, '')) <> '' THEN category {CASES} ELSE 'Others' END AS category, count(*) AS n FROM logs_v GROUP BY 1", "logs_v")
def _(logs):
    return analytics.categories(logs)


@query("a9_categories_dashboard", f"SELECT category, n, row_number() OVER (ORDER BY n DESC, f) AS place FROM (SELECT CASE {SHORT_CASES} ELSE 'Others' END AS category, count(*) AS n, min((coalesce(-epoch_us(created_at), 4611686018427387904), id)) AS f FROM logs_v GROUP BY 1)", "logs_v")
def _(logs):
    return in_order(analytics.categories(logs, lexicons.CATEGORIES[:4], use_saved=False))


@query("a10_shares", f"SELECT category, n, round(n / sum(n) OVER () * 100, 1) AS percent, n / sum(n) OVER () * 360 AS degrees FROM (SELECT CASE {SHORT_CASES} ELSE 'Others' END AS category, count(*) AS n FROM logs_v GROUP BY 1)", "logs_v")
def _(logs):
    return analytics.shares(analytics.categories(logs, lexicons.CATEGORIES[:4], use_saved=False))


@query("t1_newest", "SELECT id, created_at FROM logs_v ORDER BY created_at DESC NULLS LAST, id LIMIT 500", "logs_v")
def _(logs):
    return analytics.newest(logs, 500).select("id", "created_at")


@query("t2_topics", f"SELECT topic, n, row_number() OVER (ORDER BY n DESC, f) AS place FROM (SELECT CASE WHEN trim(coalesce(category, '')) <> '' THEN category {CASES} ELSE 'Others' END AS topic, count(*) AS n, min((coalesce(-epoch_us(created_at), 4611686018427387904), id)) AS f FROM logs_v GROUP BY 1) ORDER BY n DESC, f LIMIT 6", "logs_v")
def _(logs):
    return in_order(analytics.topics(logs))


@query("t3_unanswered", f"SELECT id FROM logs_v WHERE NOT {ANSWERED} ORDER BY created_at DESC NULLS LAST, id LIMIT 8", "logs_v")
def _(logs):
    return analytics.unanswered(logs).select("id")


@query("u5_suggestions", None, "logs_v")
def _(logs):
    return logs.select("id", T.suggestions(F.col("question")).alias("suggestions"))


@query("u8_day_label", "SELECT id, strftime(created_at, '%b ') || CAST(day(created_at) AS VARCHAR) AS label FROM logs_v", "logs_v")
def _(logs):
    return logs.select("id", analytics.day_label(F.col("created_at")).alias("label"))


@query("u7_route", "SELECT id, CASE WHEN trim(question) = '' THEN 'empty' WHEN id % 13 = 1 THEN 'casual' WHEN id % 5 = 2 THEN 'no_chunks' WHEN id % 7 = 3 THEN 'nothing_passed' WHEN trim(coalesce(answer, '')) = '' THEN 'refused' ELSE 'answered' END AS route FROM logs_v", "logs_v")
def _(logs):
    casual = F.when(F.col("id") % 13 == 1, "hi")
    return logs.select("id", retrieve.route(F.col("question"), casual, F.col("id") % 5 != 2, F.when(F.col("id") % 7 != 3, "x"), F.col("answer")).alias("route"))


# --- accounts ---


@query("f10_roles", "SELECT id, role IN ('admin', 'super_admin') AS is_admin, role <> 'super_admin' AND id <> 10 AS removable FROM profiles_v", "profiles_v")
def _(p):
    return p.select("id", accounts.is_admin(F.col("role")).alias("is_admin"), accounts.removable(F.col("role"), F.col("id"), F.lit(10)).alias("removable"))


@query("j9_invites", """
SELECT email, CASE WHEN id % 4 = 3 THEN 'rejected' WHEN role = 'super_admin' THEN 'already_super_admin' WHEN role = 'admin' THEN 'already_admin' ELSE 'promote' END AS action FROM profiles_v
UNION ALL SELECT 'new_' || email, CASE WHEN id % 5 = 4 THEN 'rejected' WHEN id % 3 = 0 THEN 'duplicate_pending' ELSE 'invite' END FROM profiles_v""", "profiles_v")
def _(p):
    i = F.col("id")
    role = F.when(i % 4 == 0, "admin").when(i % 4 == 1, " Admin ").when(i % 4 == 2, "").otherwise("super_admin")
    asked = p.select("email", role.alias("role")).unionByName(p.select(F.concat(F.lit(" New_"), "email").alias("email"), F.when(i % 5 == 4, " ").alias("role")))
    invites = p.filter("id % 3 = 0").select(F.concat(F.lit("NEW_"), "email").alias("email"), F.lit("pending").alias("status"))
    return accounts.resolve_invites(asked, p, invites).select("email", "action")


@query("j13_role_lookup", "SELECT u.user_id, p.role, coalesce(p.role IN ('admin', 'super_admin'), false) AS allowed FROM (SELECT DISTINCT user_id FROM logs_v WHERE user_id IS NOT NULL) u LEFT JOIN profiles_v p ON u.user_id = CAST(p.id AS VARCHAR)", "logs_v", "profiles_v")
def _(logs, p):
    return accounts.roles(logs.filter("user_id is not null").select("user_id").distinct(), p)


@query("m8_profile_upsert", "SELECT id, email, CASE WHEN id % 10 = 3 THEN 'renamed' ELSE full_name END AS full_name, role FROM profiles_v", "profiles_v")
def _(p):
    return accounts.upsert_profiles(p, p.filter("id % 10 = 3").select("id", F.lit("renamed").alias("full_name")))


@query("m9_set_role", "SELECT id, CASE WHEN id % 20 = 0 THEN 'student' ELSE role END AS role FROM profiles_v", "profiles_v")
def _(p):
    return accounts.changed(p, p.filter("id % 20 = 0").select("id", F.lit("student").alias("role")), "role").select("id", "role")


# --- smaller rules ---


@query("f3_active", "SELECT chunk_id FROM vec_chunks_v WHERE NOT deleted", "vec_chunks_v")
def _(c):
    return c.filter(store.active()).select("chunk_id")


@query("f5_least_words", r"SELECT doc_id FROM files_v WHERE trim(coalesce(text, '')) <> '' AND len(string_split_regex(trim(text), '\s+')) >= 6", "files_v")
def _(f):
    return f.filter(F.size(T.words(T.clean_chunk(F.col("text")))) >= retrieve.LEAST_WORDS).select("doc_id")


@query("f7_no_answer", r"SELECT conv_id, turn, contains(trim(regexp_replace(regexp_replace(lower(content), '[^A-Za-z0-9_\s]', '', 'g'), '\s+', ' ', 'g')), 'of the') AS refused FROM messages_v", "messages_v")
def _(m):
    return m.select("conv_id", "turn", conversations.no_answer(F.col("content"), "Of the.").alias("refused"))


@query("f11_shows_sources", "SELECT id, id % 2 = 0 AND id % 3 > 0 AND id % 5 > 0 AND id % 7 > 0 AS shown FROM logs_v", "logs_v")
def _(logs):
    i = F.col("id")
    return logs.select("id", conversations.shows_sources(F.when(i % 2 == 0, "assistant").otherwise("user"), F.array_repeat(F.lit("f"), (i % 3).cast("int")), F.when(i % 5 == 0, F.lit(False)), F.when(i % 7 == 0, "homework_refusal")).alias("shown"))


@query("j10_known_emails", "SELECT DISTINCT user_email AS email FROM logs_v WHERE user_email IN (SELECT 'u' || id || '@example.org' FROM profiles_v)", "logs_v", "profiles_v")
def _(logs, p):
    emails = logs.filter("user_email is not null").select(F.col("user_email").alias("email")).distinct()
    return accounts.known(emails, p.select(F.concat(F.lit("U"), F.col("id").cast("string"), F.lit("@example.org")).alias("email")))


@query("j11_display_name", "SELECT id, CASE WHEN id % 3 = 0 THEN full_name WHEN id % 3 = 1 THEN 'meta' WHEN id % 2 = 0 THEN split_part(email, '@', 1) ELSE 'Guest' END AS name FROM profiles_v", "profiles_v")
def _(p):
    i = F.col("id")
    return p.select("id", accounts.display_name(F.when(i % 3 == 0, F.col("full_name")).otherwise(" "), F.when(i % 3 == 1, "meta"), F.when(i % 2 == 0, F.col("email"))).alias("name"))


@query("m7_clear", "SELECT question, count(*) AS n FROM logs_v WHERE id % 9 = 0 GROUP BY 1", "logs_v")
def _(logs):
    return analytics.cleared(logs.withColumn("id", F.when(F.col("id") % 9 > 0, F.col("id")))).groupBy("question").agg(F.count(F.lit(1)).alias("n"))


@query("m10_delete_conversation", "SELECT id FROM logs_v WHERE conversation_id NOT IN ('c3', 'c4') OR user_id IS NULL", "logs_v")
def _(logs):
    gone = logs.filter("conversation_id in ('c3', 'c4')").select("user_id", "conversation_id", "question", "answer")
    return conversations.without_conversation(logs, gone).select("id")


@query("p9_table_text", "SELECT p_partkey, 'name | size' || chr(10) || 'name: ' || p_name || ' | size: ' || p_size || chr(10) || p_brand AS text FROM part", "part")
def _(p):
    rows = F.array(F.array(F.lit("name"), F.lit(" size ")), F.array("p_name", F.col("p_size").cast("string")), F.array(F.col("p_brand")), F.array(F.lit(" "), F.lit(None).cast("string")))
    return p.select("p_partkey", sources.table_text(rows).alias("text"))


@query("p15_prompt", "SELECT id, CASE WHEN trim(coalesce(answer, '')) <> '' THEN 'Context:' || chr(10) || answer || chr(10) || chr(10) ELSE '' END || 'Latest user request:' || chr(10) || question AS prompt FROM logs_v", "logs_v")
def _(logs):
    return logs.select("id", retrieve.prompt(F.col("answer"), F.lit(None).cast("string"), F.lit(" "), F.col("question")).alias("prompt"))


@query("p21_request", "SELECT id, CASE WHEN coalesce(user_id, '') <> '' THEN user_id ELSE question END AS text FROM logs_v", "logs_v")
def _(logs):
    return logs.select("id", T.request_text(F.col("user_id"), F.concat(F.lit(" "), "question")).alias("text"))


@query("p22_conversation_id", "SELECT id, 'chat-' || (epoch_us(created_at) // 1000) || '-' || substr(md5(CAST(id AS VARCHAR)), 1, 6) AS conv FROM logs_v WHERE created_at IS NOT NULL", "logs_v")
def _(logs):
    return logs.filter("created_at is not null").select("id", T.conversation_id(F.col("created_at"), F.col("id").cast("string")).alias("conv"))


@query("p23_suggestion_label", "SELECT id, CASE WHEN trim(coalesce(category, '')) <> '' THEN 'Did you mean ' || category || '?' WHEN trim(coalesce(answer, '')) <> '' THEN 'Did you mean ' || answer || '?' ELSE 'Did you mean one of these?' END AS label FROM logs_v", "logs_v")
def _(logs):
    return logs.select("id", T.suggestion_label(F.col("category"), F.col("answer")).alias("label"))


@query("t4_newest_questions", "SELECT id, question FROM logs_v ORDER BY created_at DESC NULLS LAST, id LIMIT 5", "logs_v")
def _(logs):
    return analytics.newest(logs, 5).select("id", "question")


@query("t6_three", "SELECT id, list_filter([trim(question), trim(coalesce(answer, '')), trim(coalesce(user_email, '')), 'last'], lambda x: x <> '')[1:3] AS three FROM logs_v", "logs_v")
def _(logs):
    return logs.select("id", T.three(F.array("question", F.coalesce("answer", F.lit("")), F.coalesce("user_email", F.lit("")), F.lit(" last "))).alias("three"))


@query("u6_parsed", "SELECT id, CASE WHEN id % 6 = 0 THEN [{}] ELSE [question, CAST(id AS VARCHAR)] END AS found FROM logs_v".format(", ".join(map(_quoted, lexicons.DEFAULT_SUGGESTIONS))), "logs_v")
def _(logs):
    reply = F.concat(F.lit('```json\n["'), "question", F.lit('", " '), F.col("id").cast("string"), F.lit('", ""]\n```'))
    reply = F.when(F.col("id") % 6 > 0, reply).otherwise("Sorry, no list.")
    return logs.select("id", T.parsed_suggestions(reply).alias("found"))


@query("w8_last_of_name", "SELECT 'file_' || (doc_id % 50) AS filename, max(lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS path FROM documents GROUP BY 1", "documents")
def _(d):
    named = d.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.concat(F.lit("file_"), (F.col("doc_id") % 50).cast("string")).alias("filename"))
    return sources.last_of_name(named)


@query("a14_source_list", f"""
WITH {SPARSE},
par AS (SELECT r.query_id, r.rank, r.distance, c.*, '[Source ' || r.rank || ' | File: ' || c.filename || ' | Page: ' || c.page || ']' || chr(10) || trim(c.text) AS part FROM ran r JOIN chunks_v c ON r.chunk_id = c.chunk_id
  WHERE r.distance <= 0.75 AND len(string_split_regex(trim(c.text), '\\s+')) >= 6),
run AS (SELECT *, sum(length(part)) OVER (PARTITION BY query_id ORDER BY rank) AS s FROM par)
SELECT query_id, CAST(rank AS INTEGER) AS id, filename AS file, CAST(page AS VARCHAR) AS page, trim(text) AS text, round(distance, 6) + 0.0 AS distance, scope, department, year, document_type FROM run WHERE s <= 8000""", "files_v", "benchmark")
def _(f, b):
    c, hits = _search(f, b)
    cited = retrieve.contexts(retrieve.packed(hits.join(c, "chunk_id"))).select("query_id", F.inline("sources"))
    return cited.withColumn("distance", F.round("distance", 6) + 0.0)


from . import inputs  # noqa: E402, F401  (registers its queries)
