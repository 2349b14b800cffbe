"""Benchmark decontamination: windows of items that documents contain, by a prefix-filtered set join.

An item's windows are its runs of `window` words; a shorter item is one window. Equal windows are one, with the items that have them as
its members. A window is a set of shingles of k words (of all its words, where it has fewer), and a document that contains the window has
every one of them. So one shingle is enough to look for: with the shingles in order of rarity, by the documents that have each, a window's
necessary prefix is its rarest one. A window with a shingle that no document has is nowhere and goes at once.

The first pass over the documents counts in how many each shingle of the items stands; the second one gives out the places of the prefix
shingles, with the words around them. What joins by the shingle must fit: as many words before it as the window has (positional bound), as
many words in all (length bound). Then the window's own words are compared with the item-sized window at that place, as text.

Before rows leave the documents, a bit array decides whether a shingle can be one of the items'. It has a size that can't grow beyond BITS,
and what it lets through by mistake joins with nothing, so any number of items is allowed.

Words are runs of ASCII letters, digits and all other characters than ASCII, with A-Z lower-cased. Shingles travel as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WINDOW, K = 10, 5
#: The bit array has 16 bits for each shingle, but no more than 2**BITS (16 MB).
BITS = 27
#: Places in one Arrow batch.
ROWS = 1 << 14


class Found(NamedTuple):
    #: (doc_id, doc_key, n_words), a row for each row of docs. doc_key: a hash of id and text.
    docs: DataFrame
    #: (doc_id, doc_key, start, size, window): where a window of so many words begins in a document, counted in words. Equal rows of docs share theirs.
    hits: DataFrame
    #: (window, item_id): the items that have a window, for windows that occur.
    members: DataFrame


def grams(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the `size` words from each word on, and whether the text has so many left."""
    begins = common.row_starts(counts)
    left = np.repeat(begins[1:], counts) - np.arange(len(hashes))
    rolled = np.full(len(hashes), size, np.uint64)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    for j, factor in enumerate(common.powers(size + 1)[1:]):
        rolled += padded[j : j + len(hashes)] * factor
    return common.mixed(rolled), left >= size


def word_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, some: np.ndarray) -> pa.Array:
    """Some of the words as strings."""
    if not len(some):
        return pa.array([], pa.string())
    offsets = np.stack([starts, ends], axis=1).astype(np.int32).ravel()  # every other value is a word, those between are what stands between words
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).take(pa.array(2 * some))


def item_windows(items: DataFrame, window: int, k: int) -> DataFrame:
    """(item_id, window, size, shingles) of every window of every item; window: its words with a space between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in common.text_slices(batches):
            data, starts, ends, hashes, counts = common.words_of(part.column("text"), common.MARK)
            begins = common.row_starts(counts)
            for row, (at, n) in enumerate(zip(begins.tolist(), counts.tolist(), strict=False)):
                if n == 0:
                    continue
                size, own = min(n, window), min(n, window, k)
                found, _ = grams(hashes[at : at + n], np.array([n]), own)
                texts = word_array(data, starts, ends, np.arange(at, at + n)).to_pylist()
                for first in range(0, n - size + 1, ROWS):
                    places = np.arange(first, min(first + ROWS, n - size + 1))
                    many = size - own + 1
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(places) + 1, dtype=np.int32) * many), pa.array(found[(places[:, None] + np.arange(many)).ravel()].view(np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("item_id").take(pa.array(np.full(len(places), row))), pa.array([" ".join(texts[p : p + size]) for p in places.tolist()], pa.string()), pa.array(np.full(len(places), size, np.int32)), lists],
                        names=["item_id", "window", "size", "shingles"],
                    )

    return items.select("item_id", "text").mapInArrow(run, f"{common.fields(items, ['item_id'])}, window string, size int, shingles array<long>")


class Bits:
    """A bit array that every given shingle passes, with two probes."""

    def __init__(self, words: np.ndarray):
        self.words, self.log = words, int(len(words) * 64).bit_length() - 1

    def may_have(self, h: np.ndarray) -> np.ndarray:
        first, second = h >> np.uint64(64 - self.log), h & np.uint64((1 << self.log) - 1)
        out = np.ones(len(h), bool)
        for spot in (first, second):
            out &= (self.words[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
        return out


def bits_of(shingles: DataFrame, most: int = BITS) -> np.ndarray:
    """The words of the bit array of shingles (a column `shingle`, no row twice); at most 2**most bits, whatever the number of shingles."""
    log = min(most, max(16, int(16 * shingles.count()).bit_length()))
    h = F.col("shingle")
    spots = shingles.select(F.explode(F.array(F.shiftrightunsigned(h, 64 - log), h.bitwiseAND(F.lit((1 << log) - 1)))).alias("spot"))
    masks = spots.groupBy(F.shiftrightunsigned("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(spot & 63 AS INT))")).alias("mask")).toArrow()
    out = np.zeros(1 << log >> 6, np.uint64)
    out[masks.column("word").to_numpy()] = masks.column("mask").to_numpy().view(np.uint64)
    return out


def document_counts(docs: DataFrame, shingles: DataFrame, sizes: list[int]) -> DataFrame:
    """(shingle, df): in how many documents each given shingle stands, if in any."""
    bits = docs.sparkSession.sparkContext.broadcast(bits_of(shingles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bits(bits.value)
        for part, _ in common.text_slices(batches):
            *_, hashes, counts = common.words_of(part.column("text"), common.MARK)
            row = np.repeat(np.arange(len(counts)), counts)
            for size in sizes:
                h, whole = grams(hashes, counts, size)
                at = np.flatnonzero(whole)
                at = at[known.may_have(h[at])]
                distinct, place = np.unique(h[at], return_inverse=True)
                df = np.bincount(np.unique(place * len(counts) + row[at]) // max(1, len(counts)), minlength=len(distinct))
                yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(df.astype(np.int64))], names=["shingle", "df"])

    found = docs.select("text").mapInArrow(run, "shingle long, df long")
    return found.groupBy("shingle").agg(F.sum("df").alias("df")).join(shingles, "shingle", "left_semi")


def places(docs: DataFrame, prefixes: DataFrame, sizes: list[int], window: int) -> DataFrame:
    """(doc_id, doc_key, n_words, shingle, at, before, around): a row for each document, whose last four columns are null, and one for each place
    of a prefix shingle, whose n_words is null. around: the words from `before` words before the place on, as far as a window may reach."""
    bits = docs.sparkSession.sparkContext.broadcast(bits_of(prefixes))
    kind = common.fields(docs, ["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bits(bits.value)
        for part, _ in common.text_slices(batches):
            data, starts, ends, hashes, counts = common.words_of(part.column("text"), common.MARK)
            begins = common.row_starts(counts)
            ids, keys = part.column("doc_id"), part.column("doc_key")
            names = ["doc_id", "doc_key", "n_words", "shingle", "at", "before", "around"]
            nothing = [pa.nulls(len(ids), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([ids, keys, pa.array(counts.astype(np.int64)), *nothing], names=names)
            row = np.repeat(np.arange(len(counts)), counts)
            for size in sizes:
                h, whole = grams(hashes, counts, size)
                found = np.flatnonzero(whole)
                found = found[known.may_have(h[found])]
                for first in range(0, len(found), ROWS):
                    at = found[first : first + ROWS]
                    own = row[at]
                    before = np.minimum(at - begins[own], window - 1)
                    many = before + np.minimum(begins[own + 1] - at, window)
                    words = word_array(data, starts, ends, common.spread(at - before, many))
                    around = pa.ListArray.from_arrays(pa.array(common.row_starts(many).astype(np.int32)), words)
                    own = pa.array(own)
                    yield pa.RecordBatch.from_arrays([ids.take(own), keys.take(own), pa.nulls(len(at), pa.int64()), pa.array(h[at].view(np.int64)), pa.array(at - begins[row[at]]), pa.array(before.astype(np.int32)), around], names=names)

    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc_key"), "text")
    return keyed.mapInArrow(run, f"{kind}, doc_key long, n_words long, shingle long, at long, before int, around array<string>")


def search(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K) -> Found:
    """Every occurrence of every window of items (item_id, text, ...) in docs (doc_id, text, ...), in shared storage.

    Null and empty texts, and those without a word, have no window and contain none. Rows of one item_id are one item with the windows of
    all. Repeated rows of docs are documents each, of the same hits. Null ids are ids like others. Long texts are read whole. Empty tables
    give empty ones. Other columns are not used.
    """
    spark: SparkSession = docs.sparkSession
    own = common.written(item_windows(items, window, k), "windows")
    windows = own.select("window", "size", "shingles").dropDuplicates(["window"])
    sizes = sorted(r[0] for r in own.select(F.least(F.lit(k), "size")).distinct().collect())  # k values at most
    shingles = common.written(windows.select("window", "size", F.posexplode("shingles").alias("offset", "shingle")), "shingles")
    df = common.written(document_counts(docs, shingles.select("shingle").distinct(), sizes), "counts")
    ranked = shingles.join(df, "shingle", "left").groupBy("window", "size").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "shingle", "offset")).alias("rarest"))
    prefix = common.written(ranked.filter("rarest.df > 0").select("window", "size", "rarest.shingle", "rarest.offset"), "prefixes")
    found = common.written(places(docs, prefix.select("shingle").distinct(), sizes, window), "places")
    seeds = found.filter("shingle is not null").select("doc_id", "doc_key", "shingle", "at", "before", "around").distinct()
    fits = (F.col("offset") <= F.col("before")) & (F.col("before") - F.col("offset") + F.col("size") <= F.size("around"))
    same = F.array_join(F.slice("around", F.col("before") - F.col("offset") + 1, F.col("size")), " ") == F.col("window")
    hits = seeds.join(prefix, "shingle").filter(fits).filter(same).select("doc_id", "doc_key", (F.col("at") - F.col("offset")).alias("start"), "size", "window")
    hits = common.written(hits, "hits")
    members = own.select("window", "item_id").distinct().join(prefix.select("window"), "window", "left_semi")
    return Found(found.filter("n_words is not null").select("doc_id", "doc_key", "n_words"), hits, members)


def passages(found: Found) -> DataFrame:
    """(doc_id, doc_key, start, end, n_windows): the hit words of each document as runs, from start to end - 1, with the windows that make them."""
    before = Window.partitionBy("doc_id", "doc_key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    h = found.hits.select("doc_id", "doc_key", "start", (F.col("start") + F.col("size")).alias("end"))
    h = h.withColumn("opens", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int"))
    h = h.withColumn("run", F.sum("opens").over(Window.partitionBy("doc_id", "doc_key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    return h.groupBy("doc_id", "doc_key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_windows")).drop("run")


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), a row for each row of docs.

    n_hit: words inside an occurrence of a window; n_items: items with one; items_sha256: of their ids, sorted as text, with commas between
    (an item whose id is null hits, but isn't counted or named). For the rest, see `search`.
    """
    found = search(docs, items, window, k)
    hit = passages(found).groupBy("doc_id", "doc_key").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"))
    named = found.hits.select("doc_id", "doc_key", "window").distinct().join(found.members.filter("item_id is not null"), "window")
    named = named.select("doc_id", "doc_key", F.col("item_id").cast("string").alias("item")).distinct()
    named = named.groupBy("doc_id", "doc_key").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    marks = hit.join(named, (hit["doc_key"] == named["doc_key"]) & hit["doc_id"].eqNullSafe(named["doc_id"]), "left").select(hit["doc_id"].alias("hit_id"), hit["doc_key"].alias("hit_key"), "n_hit", "n_items", "items")
    out = found.docs.join(marks, (F.col("doc_key") == F.col("hit_key")) & F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, most: float = 0.0, window: int = WINDOW, k: int = K) -> DataFrame:
    """The rows of docs of whose words no larger part than `most` is hit, with all their columns."""
    key, id_, part = (common.fresh(docs.columns, n) for n in ("hit_key", "hit_id", "hit_part"))
    found = search(docs, items, window, k)
    hit = passages(found).groupBy("doc_id", "doc_key").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"))
    words = found.docs.select(F.col("doc_id").alias("own_id"), F.col("doc_key").alias("own_key"), "n_words").distinct()
    bad = hit.join(words, (F.col("doc_key") == F.col("own_key")) & F.col("doc_id").eqNullSafe(F.col("own_id")))
    bad = bad.select(F.col("doc_id").alias(id_), F.col("doc_key").alias(key), (F.col("n_hit") / F.col("n_words")).alias(part)).filter(F.col(part) > most)
    return docs.join(bad, (F.xxhash64(docs["doc_id"], docs["text"]) == bad[key]) & docs["doc_id"].eqNullSafe(bad[id_]), "left_anti")


#: contaminated() of documents by benchmark for DuckDB, by the texts of all windows.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (
  SELECT DISTINCT item_id, size, array_to_string(w[s : s + size - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)),
p AS (SELECT r, size, w, unnest(range(1, len(w) - size + 2)) AS s FROM d, (SELECT DISTINCT size FROM v) WHERE len(w) >= size),
h AS (SELECT p.r, p.s, p.size, v.item_id FROM p JOIN v ON array_to_string(p.w[p.s : p.s + p.size - 1], ' ') = v.win AND p.size = v.size),
n AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(s, s + size)) AS place FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""
