"""Ranked lexical search: best-first intervals of documents, bounded by range-maximum tables of the posting lists.

The index is a table of blocks. A block holds some documents in the order of their ids, and for each of their terms a posting list:
documents and how often they hold the term. It knows no weights, so it serves any items.

A search first adds up, over all blocks, in how many documents each term of the items stands. Every block then turns the lists it
needs into impacts and lays a sparse table over them, from which the place of a list's largest impact in any interval of documents
can be read at once. An item's search begins with the interval of all documents. The sum of the lists' maxima in an interval bounds
every score in it. The intervals of the highest bounds are split at the document of their largest single impact: that document's score is
computed, and what lies before and behind it are two new intervals. An interval that can't beat the item's k-th document so far goes
unsplit, and a task keeps the k documents of each item from block to block, so later blocks are mostly cut off at once.

Terms travel as 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLOCK_BYTES = 8 << 20
#: Terms of items, with repeats, that travel to the workers at once; further items are searched in further rounds.
ROUND_TERMS = 1 << 20
#: Intervals that are split in one step.
STEP = 96
#: Entries (terms of an item times documents) of the table of places that a search holds at once.
PLACES = 1 << 22
LAST = np.iinfo(np.int64).max  # stands for a null id, which comes last


def index(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(n_docs, n_terms, ids, lengths, terms, dfs, places, tfs) of docs (doc_id, text, ...): blocks of about block_bytes of text, in shared storage.

    n_docs: documents with a term; n_terms: all terms; ids: the documents', ascending; lengths: their terms with repeats; terms: hashes,
    ascending; dfs: the length of each term's posting list; places and tfs: the lists' documents (by their place in ids) and occurrences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in common.text_slices(batches, limit=block_bytes):
            *_, hashes, counts = common.words_of(part.column("text"), common.MARK)
            ids = part.column("doc_id").fill_null(LAST).to_numpy()
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            terms, term = np.unique(hashes, return_inverse=True)
            posting, tf = np.unique(term * len(ids) + np.repeat(place, counts), return_counts=True)
            term, place = np.divmod(posting, max(1, len(ids)))
            one = lambda x, kind: pa.array([common.pack(x.astype(kind))], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([int((counts > 0).sum())], pa.int64()), pa.array([int(counts.sum())], pa.int64()), one(ids[order], "<i8"), one(counts[order], "<i8"), one(terms, "<u8"), one(np.bincount(term, minlength=len(terms)), "<u4"), one(place, "<u4"), one(tf, "<u4")],
                names=["n_docs", "n_terms", "ids", "lengths", "terms", "dfs", "places", "tfs"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.written(rows.mapInArrow(run, "n_docs long, n_terms long, ids binary, lengths binary, terms binary, dfs binary, places binary, tfs binary"), "index")


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item; rows of one item_id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in common.text_slices(batches):
            *_, hashes, counts = common.words_of(part.column("text"), common.MARK)
            yield pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array(np.repeat(np.arange(len(counts)), counts))), pa.array(hashes.view(np.int64))], names=["item_id", "term"])

    return items.select("item_id", "text").mapInArrow(run, f"{common.fields(items, ['item_id'])}, term long").distinct()


def document_counts(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, df): in how many documents each wanted term (a row each) stands; terms that stand in none are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, dfs in zip(batch.column("terms"), batch.column("dfs"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(common.unpacked(terms, "<i8")), pa.array(common.unpacked(dfs, "<u4").astype(np.int64))], names=["term", "df"])

    own = blocks.select("terms", "dfs").mapInArrow(run, "term long, df long")
    return own.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))


def discounts(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The m of each document: 50 + (50 * n * N) div L, in whole numbers."""
    if n_terms == 0:
        return np.full(len(lengths), 50, np.int64)
    if int(lengths.max(initial=0)) * 50 * n_docs >= 1 << 63:
        lengths = lengths.astype(object)
    return (50 + 50 * lengths * n_docs // n_terms).astype(np.int64)


class Postings:
    """Posting lists of one block that the items need, as impacts, with a sparse table over them."""

    def __init__(self, lists: list[np.ndarray], impacts: list[np.ndarray]):
        self.begin = common.row_starts(np.array([len(x) for x in lists], np.int64))
        self.place = np.concatenate([*lists, np.zeros(1, np.int64)])
        self.impact = np.concatenate([*impacts, np.zeros(1, np.int64)])  # an entry of no impact stands behind all
        #: tops[j][p]: where the largest impact of the 2**j entries from p on stands; what reaches into the next list is never asked for
        self.tops = [np.arange(len(self.place), dtype=np.int32)]
        longest = int(np.diff(self.begin).max(initial=0))
        while 2 << (len(self.tops) - 1) <= longest:
            half, last = 1 << (len(self.tops) - 1), self.tops[-1]
            a, b = last[:-half], last[half:]
            self.tops.append(np.where(self.impact[b] > self.impact[a], b, a))
        self.width = len(self.place)
        self.flat = np.concatenate([np.pad(t, (0, self.width - len(t))) for t in self.tops])
        size = np.arange(longest + 2)
        self.level = np.zeros(longest + 2, np.int64)
        self.level[1:] = np.floor(np.log2(np.maximum(size[1:], 1)))

    def top(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where the largest impact of entries first to end - 1 stands; the entry of no impact where there are none."""
        size = end - first
        level = self.level[size]
        row = level * self.width
        a, b = self.flat[row + first], self.flat[row + end - (1 << level)]
        return np.where(size > 0, np.where(self.impact[b] > self.impact[a], b, a), self.width - 1)


class Best:
    """The k best documents of an item so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.append(self.ids, ids), np.append(self.scores, scores)
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]

    def open(self, bound: np.ndarray, first_id: np.ndarray) -> np.ndarray:
        """Which bounds a document may have that comes among the best, if its id is first_id at least."""
        if len(self.ids) < self.k:
            return bound > 0
        return (bound > self.scores[-1]) | ((bound == self.scores[-1]) & (first_id < self.ids[-1]))


def explore(best: Best, lists: np.ndarray, postings: Postings, ids: np.ndarray, step: int = STEP) -> int:
    """Adds to best what a block's documents (their ids, ascending) have for an item with these posting lists. Returns how many were scored."""
    chunk = max(1, PLACES // max(1, len(lists)))
    return sum(explore_part(best, lists, postings, ids, at, min(at + chunk, len(ids)), step) for at in range(0, len(ids), chunk))


def explore_part(best: Best, lists: np.ndarray, postings: Postings, ids: np.ndarray, start: int, stop: int, step: int) -> int:
    """explore for the documents from start to stop - 1."""
    begin, end = postings.begin[lists], postings.begin[lists + 1]
    if not best.open(postings.impact[postings.top(begin, end)].sum(keepdims=True), ids[start : start + 1])[0]:
        return 0
    entries = common.spread(begin, end - begin)
    of_list, place = np.repeat(np.arange(len(lists)), end - begin), postings.place[entries]
    within = (place >= start) & (place < stop)
    # at[t, d]: the entry of list t at which documents from start + d on begin
    at = np.zeros((len(lists), stop - start + 1), np.int32)
    at[of_list[within], place[within] - start + 1] = 1
    at[:, 0] = begin + np.bincount(of_list[place < start], minlength=len(lists))
    at = np.ascontiguousarray(np.cumsum(at, axis=1, dtype=np.int32).T)

    def bounded(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
        """Intervals that may hold one of the best, with their bounds and the documents to split them at."""
        some = lo < hi
        lo, hi = lo[some], hi[some]
        top = postings.top(at[lo], at[hi])
        impact = postings.impact[top]
        bound = impact.sum(axis=1)
        some = best.open(bound, ids[start + lo])
        split = postings.place[top[some, impact[some].argmax(axis=1)]] - start if some.any() else lo[some]
        return lo[some], hi[some], bound[some], split

    lo, hi, bound, split = bounded(np.zeros(1, np.int64), np.full(1, stop - start, np.int64))
    scored = 0
    while len(lo):
        if len(lo) > step:
            order = np.argpartition(-bound, step)
            now, later = order[:step], order[step:]
        else:
            now, later = np.arange(len(lo)), np.zeros(0, np.int64)
        d = split[now]
        entry = at[d]
        score = np.where(at[d + 1] > entry, postings.impact[entry], 0).sum(axis=1)
        scored += len(d)
        may = best.open(score, ids[start + d])
        if may.any():
            best.add(ids[start + d[may]], score[may])
        parts = bounded(np.concatenate([lo[now], d + 1]), np.concatenate([d, hi[now]]))
        still = later[best.open(bound[later], ids[start + lo[later]])]
        lo, hi, bound, split = (np.concatenate([old[still], new]) for old, new in zip((lo, hi, bound, split), parts, strict=True))
    return scored


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search(blocks: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of an index that score highest for each item (item_id, text, ...), exactly.

    N: documents with a term; L: all their terms; n: one document's; df: documents that hold a term; tf: its occurrences in one. A term weighs
    w = floor(1000 ln((2N + 2) / (2 df + 1))); m = 50 + (50 n N) div L; a document scores the sum of w ((10^9 tf) div (1000 tf + 20 m)) over the
    item's terms, once each. Only scores above 0 count. Equal scores go by ascending doc_id, a null id last.

    Rows of one item_id (null is an id too) are one item. Items without text or terms, an empty index and empty tables give no rows. Repeated
    documents are documents each. Other columns are not used. Items are searched in rounds of about ROUND_TERMS terms.
    """
    spark = blocks.sparkSession
    asked = common.written(item_terms(items), "asked")
    size = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = int(size[0] or 0), int(size[1] or 0)
    df = common.written(document_counts(blocks, asked.select("term").distinct()), "counts")
    asked = asked.join(df, "term")
    rounds = max(1, -(-asked.count() // ROUND_TERMS))
    kind = common.fields(items, ["item_id"])
    found = None
    for i in range(rounds):
        own = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == i).orderBy("item_id").toArrow().combine_chunks()
        plans = spark.sparkContext.broadcast(plan(own.column("item_id").combine_chunks(), own.column("term").to_numpy(), own.column("df").to_numpy(), n_docs))
        one = found_in(blocks, plans, n_docs, n_terms, k, kind)
        found = one if found is None else found.unionByName(one)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def plan(names: pa.Array, terms: np.ndarray, dfs: np.ndarray, n_docs: int) -> tuple[pa.Array, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(item ids, their distinct terms' hashes, ascending, the terms' weights, each item's terms as places in these), from rows in the order of items."""
    distinct, first, place = np.unique(terms.view(np.uint64), return_index=True, return_inverse=True)
    weights = np.array([weight(n_docs, int(x)) for x in dfs[first]], np.int64)
    values = names.to_pylist()
    starts = [i for i in range(len(values)) if i == 0 or values[i] != values[i - 1]]
    return names.take(pa.array(starts, pa.int64())), distinct, weights, np.split(place, starts[1:]) if starts else []


def found_in(blocks: DataFrame, plans, n_docs: int, n_terms: int, k: int, kind: str) -> DataFrame:
    """(item_id, doc_id, score): the k best documents of each item in the blocks of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, distinct, weights, parts = plans.value
        best = [Best(k) for _ in names]
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lengths, terms, dfs, places, tfs = (common.unpacked(batch.column(c)[row], t) for c, t in (("ids", "<i8"), ("lengths", "<i8"), ("terms", "<u8"), ("dfs", "<u4"), ("places", "<u4"), ("tfs", "<u4")))
                if not len(terms):
                    continue
                m = discounts(lengths, n_docs, n_terms)
                begin = common.row_starts(dfs)
                at = np.minimum(np.searchsorted(terms, distinct), len(terms) - 1)
                there = np.flatnonzero((terms[at] == distinct) & (weights > 0))
                number = np.full(len(distinct), -1, np.int64)
                number[there] = np.arange(len(there))
                lists, impacts = [], []
                for t, w in zip(at[there].tolist(), weights[there].tolist(), strict=True):
                    place, tf = places[begin[t] : begin[t + 1]].astype(np.int64), tfs[begin[t] : begin[t + 1]].astype(np.int64)
                    lists.append(place)
                    impacts.append(w * (1_000_000_000 * tf // (1000 * tf + 20 * m[place])))
                postings = Postings(lists, impacts)
                for own, part in zip(best, parts, strict=True):
                    some = number[part]
                    if (some >= 0).any():
                        explore(own, some[some >= 0], postings, ids)
        ids, scores = (np.concatenate([getattr(b, x) for b in best] + [np.zeros(0, np.int64)]) for x in ("ids", "scores"))
        item = np.repeat(np.arange(len(best)), [len(b.ids) for b in best])
        yield pa.RecordBatch.from_arrays([names.take(pa.array(item)), pa.array(ids, mask=ids == LAST), pa.array(scores)], names=["item_id", "doc_id", "score"])

    return blocks.select("ids", "lengths", "terms", "dfs", "places", "tfs").mapInArrow(run, f"{kind}, doc_id long, score long")


#: search() over an index of documents for benchmark, for DuckDB, by scoring every document.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
n AS (SELECT count(*) FILTER (len(t) > 0) AS nd, CAST(sum(len(t)) AS BIGINT) AS lt FROM d),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
o AS (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d),
f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM o WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM f, n GROUP BY term, nd),
s AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * nd) // lt))))) AS BIGINT) AS score
  FROM i JOIN w USING (term) JOIN f USING (term), n GROUP BY ALL HAVING score > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s QUALIFY rank <= 50
"""
