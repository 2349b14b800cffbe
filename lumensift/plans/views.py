"""The operators' input tables as views of the given ones. The same text runs on Spark and, as a CTE, in the SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumensift.storage import texts

NOW = "2024-01-30 12:00:00"

VIEWS = {
    "files_v": """
SELECT doc_id, 'doc_' || CAST(doc_id AS VARCHAR(20)) || CASE WHEN doc_id % 4 = 0 THEN '.pdf' WHEN doc_id % 4 = 1 THEN '.txt' WHEN doc_id % 4 = 2 THEN '.html' ELSE '.csv' END AS filename,
  1 AS page, 1 AS total_pages, text, CASE WHEN doc_id % 10 = 9 THEN 'personal' ELSE 'official' END AS scope,
  CASE WHEN doc_id % 20 = 9 THEN 'u' || CAST(doc_id % 7 AS VARCHAR(20)) WHEN doc_id % 40 = 19 THEN '' END AS user_id, CASE WHEN doc_id % 30 = 9 THEN 's' || CAST(doc_id % 5 AS VARCHAR(20)) END AS session_id,
  CASE WHEN doc_id % 3 = 0 THEN 'general' ELSE source END AS department, lang AS document_type, CAST(2020 + doc_id % 5 AS VARCHAR(20)) AS year, doc_id % 6 = 5 AS deleted
FROM {documents}""",
    "vec_chunks_v": """
SELECT 'v_' || CAST(vec_id AS VARCHAR(20)) AS chunk_id, vec_id, embedding, 'file_' || CAST(label AS VARCHAR(20)) || '.txt' AS filename,
  CASE WHEN vec_id % 10 = 9 THEN 'personal' ELSE 'official' END AS scope, CASE WHEN vec_id % 10 = 9 THEN 'u' || CAST(vec_id % 7 AS VARCHAR(20)) ELSE 'admin' END AS user_id,
  CASE WHEN vec_id % 3 = 0 THEN 'general' ELSE 'd' || CAST(label % 4 AS VARCHAR(20)) END AS department, vec_id % 6 = 5 AS deleted
FROM {embeddings}""",
    "vec_questions_v": """
SELECT vec_id AS query_id, embedding AS query_embedding, CASE WHEN vec_id % 4 = 0 THEN 'd' || CAST(vec_id % 5 AS VARCHAR(20)) END AS department,
  vec_id % 5 = 4 AS use_personal, CASE WHEN vec_id % 5 = 4 THEN 'u' || CAST(vec_id % 9 AS VARCHAR(20)) END AS user_id
FROM {embeddings} WHERE vec_id % 17 = 0""",
    "messages_v": "SELECT conv_id, turn, role, text AS content FROM {conversations} WHERE role IN ('user', 'assistant')",
    "logs_v": """
SELECT event_id AS id, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 23 = 0 THEN '' ELSE CAST(user_id AS VARCHAR(20)) END AS user_id,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'u' || CAST(user_id AS VARCHAR(20)) || '@example.org' END AS user_email,
  CASE WHEN event_id % 11 = 0 THEN 'When is the library open?' WHEN event_type = 'signup' THEN 'How do I apply?' WHEN event_type = 'error' THEN 'Is a hostel ROOM free?'
    WHEN event_type = 'click' THEN 'Which degree course is there?' WHEN event_type = 'view' THEN 'Who is the principal?' ELSE 'What does tuition cost?' END AS question,
  CASE WHEN event_id % 7 = 0 THEN '   ' WHEN event_id % 13 = 0 THEN NULL ELSE 'Answer ' || CAST(event_id AS VARCHAR(20)) END AS answer,
  'c' || CAST(CAST(floor(event_id / 4) AS BIGINT) AS VARCHAR(20)) AS conversation_id, CASE WHEN event_id % 19 = 0 THEN 'Sports' WHEN event_id % 29 = 0 THEN '  ' END AS category,
  CASE WHEN event_id % 3 = 0 THEN event_type <> 'error' END AS is_answered, CASE WHEN event_id % 4 <> 0 THEN value * 100 END AS response_time_ms,
  CASE WHEN event_id % 31 <> 0 THEN CAST(ts AS TIMESTAMP) END AS created_at
FROM {events}""",
    "profiles_v": """
SELECT c_custkey AS id, lower(c_name) || '@example.org' AS email, c_name AS full_name,
  CASE WHEN c_custkey % 50 = 0 THEN 'super_admin' WHEN c_custkey % 10 = 0 THEN 'admin' ELSE 'student' END AS role
FROM {customer}""",
}
TEXTS = ("documents", "pages")
BASE = ("documents", "embeddings", "conversations", "events", "customer", "part", "benchmark", "pages")

#: Chunks of files_v, as SQL.
CTES = {
    "owned_v": "SELECT * REPLACE (coalesce(nullif(user_id, ''), CASE scope WHEN 'personal' THEN 'personal' ELSE 'admin' END) AS user_id, coalesce(nullif(session_id, ''), CASE scope WHEN 'personal' THEN 'personal' ELSE 'admin' END) AS session_id), CASE scope WHEN 'personal' THEN 'user' ELSE 'admin' END AS uploaded_by FROM files_v",
    "words_v": r"SELECT *, string_split_regex(trim(text), '\s+') AS w FROM owned_v WHERE trim(coalesce(text, '')) <> ''",
    "chunks_v": """
SELECT filename, page, scope, user_id, session_id, uploaded_by, department, document_type, year, deleted, i AS chunk_index,
  CASE WHEN scope = 'personal' THEN 'personal_' || user_id || '_' || session_id || '_' || filename || '_chunk_' || i ELSE 'official_' || filename || '_chunk_' || i END AS chunk_id,
  array_to_string(w[i * 370 + 1 : i * 370 + 450], ' ') AS text
FROM (SELECT *, unnest(range(CASE WHEN len(w) <= 450 THEN 1 ELSE CAST(ceil((len(w) - 450) / 370.0) AS BIGINT) + 1 END)) AS i FROM words_v WHERE len(w) >= 8)
WHERE len(w[i * 370 + 1 : i * 370 + 450]) >= 8""",
}
NEEDS = {"words_v": ["files_v", "owned_v"], "chunks_v": ["files_v", "owned_v", "words_v"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TEXTS:
        return texts(spark, f"{sf_dir}/{name}.parquet")
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    table = next(b for b in BASE if f"{{{b}}}" in VIEWS[name])
    return spark.sql(VIEWS[name], **{table: view(spark, sf_dir, table)})


def with_views(sql: str) -> str:
    """A query for DuckDB with the views that it names in front."""
    used = {n for n in [*VIEWS, *CTES] if n in sql}
    for n in list(used):
        used.update(NEEDS.get(n, []))
    parts = [f"{n} AS ({VIEWS[n].format(**{b: b for b in BASE}) if n in VIEWS else CTES[n]})" for n in [*VIEWS, *CTES] if n in used]
    if not parts:
        return sql
    head = ", ".join(parts)
    return f"WITH {head}, {sql.lstrip()[5:]}" if sql.lstrip().upper().startswith("WITH ") else f"WITH {head} {sql}"
