"""URL filter: rules, then naive Bayes on segmented host and path names.

Names such as `cheapflights` are cut into words: every substring of a distinct name is joined with the word counts of the pages'
text, and a unigram Viterbi search over what the join brings picks the most probable cut. The words of a URL's host and path
are its tokens. A multinomial naive Bayes model, counted on the URLs that a rule decides, judges the others. Word counts,
substrings, names, tokens and model are tables joined by Spark; nothing of them passes through the driver.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Letters of the longest word that a longer name is cut into; a longer word is known where it is a whole name.
LONGEST_WORD = 24
#: A URL is blocked if the model gives blocking at least this probability.
SURE = 0.9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def by_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. Rules are a parameter, tried one by one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, act).otherwise(verdict)
    return rule, verdict


def word_counts(html: DataFrame) -> DataFrame:
    """(word, n): words of a-z in the text between tags, over all pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag, word = re.compile(rb"<[^>]*>"), re.compile(rb"[a-z]+")
        for part, _ in common.text_slices(batches, "html"):
            found: Counter = Counter()
            for text in part.column("html").to_pylist():
                if text:
                    found.update(word.findall(tag.sub(b" ", text.encode().lower())))
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    return html.select("html").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def best_cut(name: str, known: dict[tuple[int, int], int], total: int) -> list[str]:
    """The most probable words of a name; known: counts of its substrings by start and end. Ties: the longer last word."""
    best, back = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
    for end in range(1, len(name) + 1):
        for start in range(max(0, end - LONGEST_WORD), end) if end < len(name) or end <= LONGEST_WORD else (0, *range(end - LONGEST_WORD, end)):
            n = known.get((start, end), 0)
            # an unknown word costs ten times more with each letter
            p = math.log10(n / total) if n else 1 - math.log10(max(total, 1)) - 1.2 * (end - start)
            if best[start] + p > best[end]:
                best[end], back[end] = best[start] + p, start
    out, end = [], len(name)
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return out[::-1]


def segmented(names: DataFrame, words: DataFrame) -> DataFrame:
    """(name) distinct names of a-z -> (name, words)."""
    n = F.length("name")
    starts = names.select("name", F.explode(F.sequence(F.lit(1), n)).alias("start"))
    pieces = starts.select("name", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), n - F.col("start") + 1))).alias("size"))
    pieces = pieces.unionByName(names.filter(n > LONGEST_WORD).select("name", F.lit(1).alias("start"), n.alias("size")))
    pieces = pieces.withColumn("word", F.substring(F.col("name"), F.col("start"), F.col("size")))
    hits = pieces.join(words, "word").groupBy("name").agg(F.collect_list(F.struct((F.col("start") - 1).alias("a"), (F.col("start") - 1 + F.col("size")).alias("b"), "n")).alias("hits"))
    total = words.agg(F.sum("n")).first()[0] or 0
    rows = names.join(hits, "name", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [best_cut(r["name"], {(h["a"], h["b"]): h["n"] for h in r["hits"] or ()}, total) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(cut, pa.list_(pa.string()))], names=["name", "words"])

    return rows.select("name", "hits").mapInArrow(run, "name string, words array<string>")


def names_of(host: Column, path: Column) -> Column:
    """Runs of a-z in host and path, `#` for each run of digits."""
    return F.regexp_extract_all(F.concat(host, F.lit(" "), F.translate(F.regexp_replace(path, "[0-9]+", "#"), UPPER, LOWER)), F.lit("([a-z]+|#)"), F.lit(1))


def judge(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """pages (page_id, url, html, ...) -> (page_id, host, path, rule, verdict), a row for each row.

    A null url, or one without `://`, has empty host and path; so it has no token, and the prior decides. Html may be null. With
    no URL that a rule decides, prior and counts are even and `allow` stands. Long URLs are read whole, repeated
    rows come back and count as often as they are there, an empty table gives an empty one. Other columns are not used.
    """
    host, path = parts(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    urls = common.written(p.groupBy("host", "path").agg(F.count(F.lit(1)).alias("times")).select("host", "path", "times", rule.alias("rule"), verdict.alias("by_rule")), "urls")
    named = urls.select("host", "path", "times", "by_rule", F.explode(names_of(F.col("host"), F.col("path"))).alias("name"))
    cut = segmented(named.select("name").distinct().filter("name <> '#'"), common.written(word_counts(pages), "words"))
    cut = common.written(cut, "cut")
    tokens = named.join(cut, "name", "left").select("host", "path", "times", "by_rule", F.explode(F.coalesce("words", F.array("name"))).alias("token"))
    tokens = common.written(tokens, "tokens")
    known = tokens.filter("by_rule is not null").groupBy("token").agg(F.sum(F.when(F.col("by_rule") == "block", F.col("times")).otherwise(0)).alias("b"), F.sum(F.when(F.col("by_rule") == "allow", F.col("times")).otherwise(0)).alias("a"))
    na, nb, v = (x or 0 for x in known.agg(F.sum("a"), F.sum("b"), F.count(F.lit(1))).first())
    ua, ub = (x or 0 for x in urls.agg(*[F.sum(F.when(F.col("by_rule") == act, F.col("times"))) for act in ("allow", "block")]).first())
    rarest = math.log((na + v + 1) / (nb + v + 1))  # of a token that no rule has shown
    odds = known.select("token", (F.log(F.col("b") + F.lit(1)) - F.log(F.col("a") + F.lit(1)) + rarest).alias("odds"))
    per = tokens.filter("by_rule is null").groupBy("host", "path", "token").agg(F.count(F.lit(1)).alias("k"))
    scored = per.join(odds, "token", "left").groupBy("host", "path").agg(F.sum(F.coalesce("odds", F.lit(rarest)) * F.col("k")).alias("x"))
    prior = math.log((ub + 1) / (ua + 1))
    done = urls.join(scored, ["host", "path"], "left")
    done = done.select("host", "path", "rule", F.coalesce("by_rule", F.when(F.coalesce("x", F.lit(0.0)) + prior > math.log(SURE / (1 - SURE)), "block").otherwise("allow")).alias("verdict"))
    return p.join(done, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict")
