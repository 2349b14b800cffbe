"""Language identification with n-gram filters that answer for all languages at once.

One Bloom filter for each language would need a probe for each language. Here the filters lie side by side, bit-sliced: entry
i of the table is a bitmask with bit L set if bit i of language L's filter is. An n-gram's few entries, combined by AND, are
the set of languages that have it. Counted over a text and corrected for each filter's false positives, the language with the
most n-grams decides.

N-grams are N bytes of the lower-cased text in which everything but letters is one space. A language has an n-gram if its share of the
language's n-grams is at least `RATIO` of its share in the language where that is largest; so passages of another language
in a text do no harm. The table is built from bounded samples, so its size is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

N = 5
PROBES = 3
TABLE_BITS = 21
RATIO = 0.2
#: The bound of the sample that filters are fitted on: about so many training rows.
SAMPLE_ROWS = 20_000
NONE = "und"
SALTS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5]


def letters(column: pa.Array) -> pa.Array:
    """Lower-cased text with every run of other characters as one space, and two at either end."""
    text = pc.replace_substring_regex(pc.binary_join_element_wise(" ", pc.utf8_lower(pc.fill_null(column, "")), " ", ""), r"[^\p{L}]+", " ")
    return pc.binary_join_element_wise(" ", text, " ", "")


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of each text as integers, text after text, and where each text's begin (one more than texts)."""
    data, begins = common.text_bytes(letters(column))
    many = np.maximum(0, np.diff(begins) - N)  # the newline that ends each text is in none
    value = np.zeros(max(0, len(data) - N + 1), np.uint64)
    for j in range(N):
        value |= data[j : j + len(value)].astype(np.uint64) << np.uint64(8 * j)
    first = common.row_starts(many)
    keep = np.arange(first[-1]) + np.repeat(begins[:-1] - first[:-1], many)
    return value[keep], first


def places(gram: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((gram * np.uint64(salt)) >> np.uint64(64 - bits)).astype(np.int64) for salt in SALTS[:PROBES]]


def masks(n: int) -> np.dtype:
    return next(np.dtype(t) for t, w in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if n <= w)


class Filters:
    """tables: one bit-sliced filter for every 64 languages; false_rate: share of set bits to the power of probes, by language."""

    def __init__(self, languages: list[str], tables: list[np.ndarray], bits: int):
        self.languages, self.tables, self.bits = languages, tables, bits
        load = np.array([((t >> t.dtype.type(i)) & t.dtype.type(1)).mean() for t in tables for i in range(64)][: len(languages)] if languages else [])
        self.false_rate = load**PROBES

    def counts(self, gram: np.ndarray, first: np.ndarray) -> np.ndarray:
        """N-grams that each language has in each text, corrected for false positives: texts x languages."""
        at, many = places(gram, self.bits), np.diff(first)
        out = np.zeros((len(many), len(self.languages)))
        some = many > 0
        for block, table in enumerate(self.tables):
            mask = table[at[0]]
            for p in at[1:]:
                mask &= table[p]
            for i in range(min(64, len(self.languages) - 64 * block)):
                has = (mask >> mask.dtype.type(i)) & mask.dtype.type(1)
                if some.any():
                    out[some, 64 * block + i] = np.add.reduceat(has, first[:-1][some], dtype=np.int64)
        rate = self.false_rate
        return np.maximum(0, (out - many[:, None] * rate) / np.maximum(1e-9, 1 - rate))

    def decide(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        gram, first = grams(column)
        count = self.counts(gram, first)
        letter = pc.match_substring_regex(pc.fill_null(column, ""), r"\p{L}").to_numpy(zero_copy_only=False)
        if not self.languages:
            return [NONE] * len(column), np.zeros(len(column))
        best = count.argmax(axis=1)  # the first in order, if several are equal
        top = count[np.arange(len(best)), best]
        share = np.minimum(1, top / np.maximum(1, np.diff(first)))
        return [self.languages[b] if ok else NONE for b, ok in zip(best, letter, strict=True)], np.where(letter, share, 0.0)


def fit(docs: DataFrame, folds: int = 5, rows: int = SAMPLE_ROWS, bits: int = TABLE_BITS) -> Filters:
    """Filters learned from training rows (crc32(doc_id as text) mod folds not 0) whose lang isn't null.

    Rows are sampled by a hash of doc_id, each language to about `rows` over the number of languages, so the work after the
    pass over the ids is bounded. Within a language, an n-gram counts once for each text.
    """
    spark = docs.sparkSession
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~common.held_out("doc_id", folds))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each language
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return Filters([], [], bits)
    each = max(1, rows // len(languages))
    limits = spark.createDataFrame([(r["lang"], languages.index(r["lang"]), min(1.0, each / r["n"])) for r in sizes], "lang string, number int, share double")
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    some = known.join(F.broadcast(limits), "lang").filter(chance < F.col("share")).select("number", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in common.text_slices(batches):
            gram, first = grams(part.column("text"))
            number = np.repeat(part.column("number").to_numpy(zero_copy_only=False), np.diff(first))
            text = np.repeat(np.arange(len(first) - 1), np.diff(first))
            one = np.lexsort((gram, text))
            gram, text, number = gram[one], text[one], number[one]
            new = np.append(True, (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])) if len(gram) else np.zeros(0, bool)
            order = np.lexsort((number[new], gram[new]))
            gram, number = gram[new][order], number[new][order]
            start = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (number[1:] != number[:-1]))) if len(gram) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(gram[start].view(np.int64)), pa.array(number[start].astype(np.int32)), pa.array(np.diff(np.append(start, len(gram))))], names=["gram", "number", "n"])

    found = some.mapInArrow(count, "gram long, number int, n long").groupBy("gram", "number").agg(F.sum("n").alias("n"))
    totals = some.groupBy("number").agg(F.count(F.lit(1)).alias("texts"))
    rate = found.join(F.broadcast(totals), "number").withColumn("rate", F.col("n") / F.col("texts"))
    own = rate.withColumn("most", F.max("rate").over(Window.partitionBy("gram"))).filter(F.col("rate") >= RATIO * F.col("most"))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, number = batch.column("gram").to_numpy().view(np.uint64), batch.column("number").to_numpy()
            at = np.concatenate(places(gram, bits))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.tile(number // 64, PROBES)), pa.array((np.uint64(1) << np.tile(number % 64, PROBES).astype(np.uint64)).view(np.int64))], names=["at", "block", "mask"])

    # at most 2**bits rows for every 64 languages come to the driver
    rows_ = own.select("gram", "number").mapInArrow(entries, "at long, block int, mask long").groupBy("block", "at").agg(F.bit_or("mask").alias("mask")).toArrow()
    kind = masks(min(64, len(languages)))
    tables = [np.zeros(1 << bits, kind) for _ in range(-(-len(languages) // 64))]
    block, at, mask = (rows_.column(c).to_numpy() for c in ("block", "at", "mask"))
    for i, t in enumerate(tables):
        t[at[block == i]] = mask[block == i].view(np.uint64).astype(kind)
    return Filters(languages, tables, bits)


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """docs with lang_pred and score, the share of the text's n-grams that the language has.

    A text that is null or has no letter is `und` with score 0. If no n-gram is known, or nothing was learned that tells
    languages apart, the first language in order stands (`und` if none was learned). Long texts are read whole, repeated rows
    stay, an empty table gives an empty one. Columns of these two names are replaced, others stay.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    # plain values, as executors know no class of this package
    shared = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.tables, filters.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filters(*shared.value)
        for part, _ in common.text_slices(batches):
            language, share = own.decide(part.column("text"))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(language, pa.string()), pa.array(share, pa.float64())], names=[*kept, "lang_pred", "score"])

    return docs.select(*kept).mapInArrow(run, common.fields(docs, kept) + ", lang_pred string, score double")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", common.held_out("doc_id", 5).alias("held_out"), "lang_pred", "score")
