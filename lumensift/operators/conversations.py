"""Messages of conversations: pairs, histories, titles, edits, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumensift.functions import lexicons
from lumensift.functions import text as T


def by_turn() -> Window:
    return Window.partitionBy("conv_id").orderBy("turn")


def dialogue(messages: DataFrame) -> DataFrame:
    """Only what users and assistants said."""
    return messages.filter(F.col("role").isin("user", "assistant"))


def pairs(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): a user message directly followed by an assistant message."""
    m = messages.withColumn("_next", F.lead("role").over(by_turn())).withColumn("answer", F.lead("content").over(by_turn()))
    return m.filter("role = 'user' and _next = 'assistant'").select("conv_id", "turn", F.col("content").alias("question"), "answer")


def paired(messages: DataFrame) -> DataFrame:
    """messages with `paired`: whether an assistant message follows directly."""
    return messages.withColumn("paired", F.coalesce(F.lead("role").over(by_turn()) == "assistant", F.lit(False)))


def without_errors(messages: DataFrame, marks: list[str] = lexicons.ERRORS) -> DataFrame:
    """messages less the assistant's that begin with the mark of a failed request."""
    text, failed = F.ltrim(F.coalesce("content", F.lit(""))), F.lit(False)
    for mark in marks:
        failed = failed | text.startswith(mark)
    return messages.filter(~((F.col("role") == "assistant") & failed))


def joined(rows: DataFrame, line: Column, sep: str = "\n") -> DataFrame:
    """(conv_id, text): the lines of a conversation in order of turn."""
    own = F.sort_array(F.collect_list(F.struct("turn", line.alias("line"))))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(own, lambda x: x["line"]), sep).alias("text"))


def history(messages: DataFrame) -> DataFrame:
    """Every message as a line `User: ...` or `Assistant: ...`."""
    who = F.when(F.col("role") == "user", "User").otherwise("Assistant")
    return joined(messages, F.concat(who, F.lit(": "), F.coalesce("content", F.lit(""))))


def paired_history(messages: DataFrame) -> DataFrame:
    """The complete pairs only, each on new lines, the first one too."""
    return joined(pairs(messages), F.concat(F.lit("\nUser: "), F.col("question"), F.lit("\nAssistant: "), F.col("answer")), "")


def titles(messages: DataFrame, size: int = 40) -> DataFrame:
    """(conv_id, title): the first user message, shortened; `New Chat` without one."""
    first = F.min_by(F.when(F.col("role") == "user", F.trim("content")), F.when(F.col("role") == "user", F.col("turn")))
    return messages.groupBy("conv_id").agg(first.alias("t")).select("conv_id", F.when(F.coalesce("t", F.lit("")) == "", "New Chat").otherwise(T.shortened(F.col("t"), size)).alias("title"))


def latest_answers(messages: DataFrame, welcome: str | None = None) -> DataFrame:
    """(conv_id, answer): the last assistant message that isn't the welcome."""
    said = messages.filter(F.col("role") == "assistant")
    if welcome is not None:
        said = said.filter(F.col("content") != welcome)
    return said.groupBy("conv_id").agg(F.max_by("content", "turn").alias("answer"))


def no_answer(content: Column, not_found: str = lexicons.NOT_FOUND) -> Column:
    return F.contains(T.normal_ascii(content), T.normal_ascii(F.lit(not_found)))


def guests_at_limit(messages: DataFrame, limit: int = 5) -> DataFrame:
    """Per conversation without a user: user messages, and whether the limit is reached."""
    n = F.count_if(F.col("role") == "user")
    return messages.groupBy("conv_id").agg(n.alias("asked"), (n >= limit).alias("at_limit"))


def shows_sources(role: Column, sources: Column, show: Column, response_type: Column) -> Column:
    return (role != "user") & (F.coalesce(F.size(sources), F.lit(0)) > 0) & F.coalesce(show, F.lit(True)) & (F.coalesce(response_type, F.lit("")) != "homework_refusal")


def first_files(sources: DataFrame, many: int = 3) -> DataFrame:
    """(answer_id, pos, file) -> the first `many` different files of each answer, in order."""
    first = sources.groupBy("answer_id", "file").agg(F.min("pos").alias("pos"))
    order = Window.partitionBy("answer_id").orderBy("pos")
    return first.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= many)


def newest(versions: DataFrame) -> DataFrame:
    """The newest version of each conversation (id, updated_at, ...), newest first. Of versions of one time, the first by their content as text."""
    order = Window.partitionBy("id").orderBy(F.desc("updated_at"), F.to_json(F.struct(*versions.columns)))
    return versions.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n").orderBy(F.desc("updated_at"), "id")


def edited(messages: DataFrame, edits: DataFrame) -> DataFrame:
    """Messages cut off at each edit's turn, with its new content there. edits: (conv_id, edit_turn, new_content)."""
    e = edits.select("conv_id", "edit_turn", "new_content")
    kept = messages.join(e, "conv_id", "left").filter("edit_turn is null or turn < edit_turn").select("conv_id", "turn", "role", "content")
    return kept.unionByName(e.select("conv_id", F.col("edit_turn").alias("turn"), F.lit("user").alias("role"), F.col("new_content").alias("content")))


def logged(entries: DataFrame) -> DataFrame:
    """Log rows worth keeping: with a user, a question and an answer."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return entries.filter(F.col("user_id").isNotNull() & ~blank("question") & ~blank("answer"))


def without_conversation(logs: DataFrame, gone: DataFrame) -> DataFrame:
    """Logs less those of deleted conversations: by (user_id, conversation_id), or by question and answer where gone has no conversation_id."""
    by_id = gone.filter("conversation_id is not null").select("user_id", "conversation_id").distinct()
    by_text = gone.filter("conversation_id is null").select("user_id", "question", "answer").distinct()
    return logs.join(by_id, ["user_id", "conversation_id"], "left_anti").join(by_text, ["user_id", "question", "answer"], "left_anti").select(*logs.columns)


MESSAGE = "struct<role:string,content:string,sources:array<struct<file:string,page:string>>,suggested_questions:array<string>,suggestion_topic:string>"
CONVERSATION = f"struct<id:string,title:string,updatedAt:string,messages:array<{MESSAGE}>>"


def stored(blobs: DataFrame) -> DataFrame:
    """(user_id, blob) JSON -> a row for each message; what can't be parsed, or has no string id or message list, gives none."""
    c = blobs.select("user_id", F.get_json_object("blob", "$.conversations").alias("_raw"))
    c = c.select("user_id", F.posexplode(F.arrays_zip(F.from_json("_raw", f"array<{CONVERSATION}>").alias("c"), F.from_json("_raw", "array<string>").alias("raw"))).alias("_i", "z"))
    # only the raw text tells a string id from a number, and only its own field: messages and sources have ids too
    own = F.schema_of_variant(F.try_variant_get(F.try_parse_json("z.raw"), "$.id", "variant")) == "STRING"
    c = c.select("user_id", F.col("z.c").alias("c"), own.alias("string_id")).filter(F.col("string_id") & F.col("c.messages").isNotNull())
    c = c.select("user_id", F.col("c.id").alias("conv_id"), F.col("c.title").alias("title"), F.try_to_timestamp(F.col("c.updatedAt")).alias("updated_at"), F.posexplode("c.messages").alias("turn", "m"))
    return c.select("user_id", "conv_id", "title", "updated_at", "turn", "m.*")


def source_label(file: Column, page: Column) -> Column:
    """`file (Page n)`; the file alone where the page is missing, 0 or `?`."""
    name, page = F.coalesce(F.nullif(file, F.lit("")), F.lit("Unknown source")), page.cast("string")
    return F.when(F.coalesce(page, F.lit("")).isin("", "0", "?"), name).otherwise(F.concat(name, F.lit(" (Page "), page, F.lit(")")))


def transcripts(messages: DataFrame, sources: DataFrame | None = None, user: str = "You", assistant: str = "Assistant") -> DataFrame:
    """(conv_id, text) of messages (conv_id, turn, role, content, time): `sender (time)`, the content, and with sources (conv_id, turn, pos, file,
    page) a numbered list of them; a rule between messages. Who speaks is named as the caller likes."""
    who = F.when(F.col("role") == "user", user).otherwise(assistant)
    line = F.concat(who, F.lit(" ("), F.coalesce(F.col("time").cast("string"), F.lit("")), F.lit(")\n"), F.coalesce("content", F.lit("")))
    if sources is not None:
        own = sources.select("conv_id", "turn", "pos", source_label(F.col("file"), F.col("page")).alias("label"))
        own = own.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct("pos", "label"))).alias("_s"))
        messages = messages.join(own, ["conv_id", "turn"], "left")
        cited = F.array_join(F.transform("_s", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["label"])), "\n")
        line = F.concat(line, F.coalesce(F.concat(F.lit("\nSources:\n"), cited), F.lit("")))
    return joined(messages, line, f"\n\n{lexicons.RULE}\n\n")
