"""Text as columns: cleaning, normal forms, ids and labels. All of it stays in the JVM."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons

#: White space as Python's str methods see it, spelled out: a list is trimmed, and a class of it matched, without Unicode's tables.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: A range around those that are no Latin, as any other character would be held against each of them.
BLANK = r"[\x09-\x0D\x1C-\x20\x85\xA0[\u1680-\u3000&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]]]"
#: Any other character.
OTHER = r"[^\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def where(text: Column, needles: list[str], then: Callable[[Column], Column]) -> Column:
    """then(text) for texts with one of the needles, others as they are: a search for bytes costs next to nothing, a regex goes over every character.
    Inside a lambda, so that the text is computed once."""
    found = lambda t: functools.reduce(Column.__or__, [F.contains(t, F.lit(n)) for n in needles])
    return F.get(F.transform(F.array(text), lambda t: F.when(found(t), then(t)).otherwise(t)), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def clean_loaded(text: Column) -> Column:
    """Extracted text made fit for chunking: NUL to space, broken words joined, page-number lines blanked, white space squeezed."""
    t = where(F.coalesce(text, F.lit("")), ["\u0000"], lambda x: F.replace(x, F.lit("\u0000"), F.lit(" ")))
    t = where(t, ["-\n"], lambda x: F.regexp_replace(x, r"(?U)(\w)-\n(\w)", "$1$2"))
    t = F.regexp_replace(t, r"(?Umd)^\s*(?:[-–]\s*)?\d+\s*(?:[-–]\s*)?$", "")
    t = F.regexp_replace(t, r"(?Uimd)^\s*Page\s+\d+(?:\s+of\s+\d+)?\s*$", "")
    return strip(two_lines(one_space(t)))


def one_space(text: Column) -> Column:
    """Runs of spaces and tabs as one space; a lone space is no match, so it isn't written anew."""
    return where(text, ["  ", "\t"], lambda x: F.regexp_replace(x, r" [ \t]+|\t[ \t]*", " "))


def two_lines(text: Column) -> Column:
    """Runs of three and more newlines as two."""
    return where(text, ["\n\n\n"], lambda x: F.regexp_replace(x, r"\n{3,}", "\n\n"))


def clean_chunk(text: Column) -> Column:
    """A stored chunk for display: three or more newlines to two, then runs of spaces and tabs to one, trimmed."""
    return strip(one_space(two_lines(F.coalesce(text, F.lit("")))))


def words(text: Column) -> Column:
    """The words of a text; no words for a blank one, where split() would give one."""
    t = strip(F.coalesce(text, F.lit("")))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"{BLANK}+"))


def has_words(text: Column, least: int) -> Column:
    """Whether a stripped text has so many words; it is read up to the last of them."""
    return text.rlike(rf"\A(?:{OTHER}++{BLANK}++){{{least - 1}}}{OTHER}") if least > 0 else text.isNotNull()


def normal(text: Column) -> Column:
    """Lower case, only word characters of any script, single spaces."""
    t = F.regexp_replace(strip(F.lower(F.coalesce(text, F.lit("")))), r"(?U)[^\w\s]", "")
    return strip(F.regexp_replace(t, r"(?U)\s+", " "))


def normal_ascii(text: Column) -> Column:
    """The same with ASCII word characters only, so accented letters go; trimmed last."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\w\s]", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def safe_id(value: Column) -> Column:
    v = F.coalesce(F.nullif(value, F.lit("")), F.lit("unknown"))
    return F.regexp_replace(F.translate(v, " ", "_"), r"[^A-Za-z0-9_.-]", "_")


def chunk_id(scope: Column, user: Column, session: Column, filename: Column, index: Column) -> Column:
    i = index.cast("string")
    personal = F.concat_ws("_", F.lit("personal"), safe_id(user), safe_id(session), safe_id(filename), F.lit("chunk"), i)
    return F.when(scope == "personal", personal).otherwise(F.concat_ws("_", F.lit("official"), safe_id(filename), F.lit("chunk"), i))


def shortened(text: Column, size: int) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) > size, F.concat(F.substring(t, 1, size), F.lit("..."))).otherwise(t)


def first_name(name: Column) -> Column:
    return F.get(words(name), F.lit(0))


def local_part(email: Column) -> Column:
    return F.get(F.split(email, "@"), F.lit(0))


def email_label(email: Column) -> Column:
    return F.coalesce(F.nullif(email, F.lit("")), F.lit("Unknown user"))


def rounded(x: Column) -> Column:
    """Half goes up, also below zero."""
    return F.floor(x + 0.5)


def age(then: Column, now: Column) -> tuple[Column, Column]:
    """(value, unit) of the time since then: minutes below 60, hours below 24, else days.

    What is rounded is then - now, so a half goes towards the later time: 90 minutes ago is an hour ago."""
    minutes = rounded((F.unix_micros(then) - F.unix_micros(now)) / 60e6)
    hours, days = rounded(minutes / 60), rounded(rounded(minutes / 60) / 24)
    value = -F.when(F.abs(minutes) < 60, minutes).when(F.abs(hours) < 24, hours).otherwise(days)
    return value, F.when(F.abs(minutes) < 60, "minute").when(F.abs(hours) < 24, "hour").otherwise("day")


def extension(filename: Column) -> Column:
    """The last suffix with its dot, lower-cased; empty without one."""
    return F.lower(F.regexp_extract(filename, r"(\.[^./\\]*)$", 1))


def type_label(filename: Column) -> Column:
    ext = F.lower(F.element_at(F.split(filename, r"\."), -1))
    out = F.lit("DOC")
    for label, exts in lexicons.TYPE_LABELS:
        out = F.when(ext.isin(exts), label).otherwise(out)
    return out


def person_name(name: Column) -> Column:
    return F.regexp_replace(strip(name), r"\s+", " ")


def email(value: Column) -> Column:
    return F.lower(strip(value))


def request_text(query: Column, question: Column) -> Column:
    """query, else question, trimmed; empty if both are blank."""
    return strip(F.coalesce(F.nullif(query, F.lit("")), question, F.lit("")))


def conversation_id(at: Column, salt: Column) -> Column:
    """An id that is the same at every run: milliseconds and six characters of a hash."""
    return F.concat_ws("-", F.lit("chat"), F.unix_millis(at).cast("string"), F.substring(F.md5(salt), 1, 6))


def suggestion_label(topic: Column, fallback: Column) -> Column:
    t = F.coalesce(F.nullif(F.trim(topic), F.lit("")), F.nullif(F.trim(fallback), F.lit("")))
    return F.when(t.isNull(), "Did you mean one of these?").otherwise(F.concat(F.lit("Did you mean "), t, F.lit("?")))


def category_label(category: Column) -> Column:
    return F.coalesce(F.nullif(category, F.lit("")), F.lit("General"))


def number_label(n: Column) -> Column:
    return F.format_number(F.coalesce(n, F.lit(0)), 0)


def category(question: Column, rules: list[tuple[str, str]] = lexicons.CATEGORIES, saved: Column | None = None) -> Column:
    """The first rule that fits the lower-cased question, else Others. A saved category that isn't blank wins."""
    text, out = F.lower(F.coalesce(question, F.lit(""))), F.lit("Others")
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out if saved is None else F.when(F.trim(F.coalesce(saved, F.lit(""))) != "", saved).otherwise(out)


def suggestions(question: Column, rules: list = lexicons.SUGGESTIONS, default: list[str] = lexicons.DEFAULT_SUGGESTIONS) -> Column:
    """Suggested questions of the first rule whose word is in the question."""
    q, out = normal_ascii(question), F.array(*map(F.lit, default))
    for within, equal, found in reversed(rules):
        fits = F.lit(False)
        for w in within:
            fits = fits | q.contains(w)
        out = F.when(fits | q.isin(equal or [None]), F.array(*map(F.lit, found))).otherwise(out)
    return out


def three(items: Column) -> Column:
    """The first three that aren't blank, trimmed."""
    return F.slice(F.filter(F.transform(items, strip), lambda x: x != ""), 1, 3)


def parsed_suggestions(reply: Column, default: list[str] = lexicons.DEFAULT_SUGGESTIONS) -> Column:
    """A model's JSON list, with or without code fences: its first three items; the default if it can't be read."""
    raw = strip(F.regexp_replace(F.coalesce(reply, F.lit("")), "```json|```", ""))
    items = F.from_json(raw, "array<string>")
    kept = F.slice(F.transform(F.filter(items, lambda x: F.coalesce(x, F.lit("")) != ""), strip), 1, 3)
    return F.coalesce(kept, F.array(*map(F.lit, default)))


def visible(html: Column) -> Column:
    """A page without its tags: blocks without text dropped, block tags as line breaks."""
    t = F.coalesce(html, F.lit(""))
    for tag in ("script", "style", "head"):
        t = F.regexp_replace(t, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    t = F.regexp_replace(t, r"(?i)</?(p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|nav)\b[^>]*>", "\n")
    return F.regexp_replace(t, r"<[^>]*>", "")


def html_text(html: Column) -> Column:
    """The visible text of a page, the common entities decoded; all of it in the JVM."""
    t = visible(html)
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return t
