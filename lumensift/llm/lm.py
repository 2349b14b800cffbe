"""Language-model scores from a log-frequency Bloom filter.

The filter holds the count of every word pair of the training texts, quantised: counts fall into levels whose bounds grow by
a seventh, and a pair is stored once for each level up to its own. Its count is read back by probing levels until one is missing. The filter is cut into segments by hash,
each built by one reducer with ten bits for each stored level, however many there are. No process holds the whole filter: every block
asks the reducer that has a segment for its pairs' levels, and the number of segments grows with the tokens.

Words travel as 64-bit hashes. Texts are tokenised once, into blocks: the block's distinct words in hash order and each
token's number among them. Counts of single words are exact (by hash): every block asks the reducer that has a range of hashes for
its words' counts in all training texts, and gets them back in the order it asked, so a block's words need no lookup table.

P(w | h) = (c(h, w) + KAPPA * P(w)) / (c(h) + KAPPA), with P(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

END = np.uint64(0x5851F42D4C957F2D)  # the end of a text, a token
START = np.uint64(0x14057B7EF767814F)  # before the first word; a condition, not a token
BLOCK_BYTES = 6 << 20
RANGE_WORDS = 1 << 19  # a reducer has so many entries, about
BITS_EACH, PROBES = 10, 5
KAPPA = 8.0


def level_bounds(top: float = 1e15, growth: float = 1.15) -> np.ndarray:
    """The smallest count of each level: one by one to 14, then 16, 18, 20, 23, 26, ...; fewer than 256."""
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, int(out[-1] * growth)))
    return np.array(out, np.int64)


BOUNDS = level_bounds()
MIDDLE = (BOUNDS[:-1] + BOUNDS[1:] - 1) / 2  # of level j at j - 1
COUNT = np.append(0.0, MIDDLE)  # of level j at j


def blocks(docs: DataFrame, folds: int) -> DataFrame:
    """(block, doc_ids, held_out, counts, tokens, words): about BLOCK_BYTES of text in each row.

    words: distinct token hashes, sorted; tokens: each token's place in words, text after text, END last in each.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in common.text_slices(batches, limit=BLOCK_BYTES):
            *_, hashes, counts = common.words_of(part.column("text"))
            ends = np.cumsum(counts)
            words, tokens = np.unique(np.insert(hashes, ends, END), return_inverse=True)
            ids = part.column("doc_id")
            one = lambda x: pa.array([common.pack(x)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), one(part.column("held_out").to_numpy(zero_copy_only=False)), one((counts + 1).astype("<i8")), one(tokens.astype("<u4")), one(words)],
                names=["doc_ids", "held_out", "counts", "tokens", "words"],
            )

    rows = docs.select("doc_id", "text", common.held_out("doc_id", folds).alias("held_out"))
    rows = rows.mapInArrow(run, f"doc_ids array<{kind}>, held_out binary, counts binary, tokens binary, words binary")
    return common.written(rows.withColumn("block", F.monotonically_increasing_id()), "blocks")


def unpack(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, ...]:
    """(held_out of each text, tokens in each text, tokens, words) of a block."""
    return tuple(common.unpacked(batch.column(n)[row], t) for n, t in (("held_out", "?"), ("counts", "<i8"), ("tokens", "<u4"), ("words", "<u8")))


def ranges(values: np.ndarray, number: int) -> np.ndarray:
    """Where each of `number` equal hash ranges starts in sorted values, and the end."""
    edges = (np.arange(number, dtype=object) * (1 << 64) // number).astype(np.uint64)
    return np.append(np.searchsorted(values, edges), len(values))


def word_counts(packed: DataFrame, number: int) -> DataFrame:
    """(block, at, counts, n, v): for a block's words from `at` on, their counts in training texts; n and v: tokens and distinct
    words of the range in training texts, in one row of each range."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                held, counts, tokens, words = unpack(batch, row)
                own = np.bincount(tokens[np.repeat(~held, counts)], minlength=len(words)).astype("<u4")
                at = ranges(words, number)
                some = np.flatnonzero(np.diff(at))
                cut = [(at[i], at[i + 1]) for i in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), pa.array([batch.column("block")[row].as_py()] * len(some), pa.int64()), pa.array([int(a) for a, _ in cut], pa.int64()), common.binary([common.pack(words[a:b]) for a, b in cut]), common.binary([common.pack(own[a:b]) for a, b in cut])],
                    names=["bucket", "block", "at", "words", "own"],
                )

    def answer(group: pa.Table) -> pa.Table:
        words = [common.unpacked(x, "<u8") for x in group.column("words")]
        own = np.concatenate([common.unpacked(x, "<u4") for x in group.column("own")])
        distinct, place = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(place, own, len(distinct)).astype("<i8")
        at = common.row_starts(np.array([len(w) for w in words]))
        found = [common.pack(total[place[a:b]]) for a, b in zip(at[:-1], at[1:], strict=True)]
        first = [1] + [0] * (len(words) - 1)
        return pa.table([group.column("block"), group.column("at"), common.binary(found), pa.array([x * int(total.sum()) for x in first], pa.int64()), pa.array([x * int((total > 0).sum()) for x in first], pa.int64())], names=["block", "at", "counts", "n", "v"])

    asked = packed.select("block", "held_out", "counts", "tokens", "words").mapInArrow(ask, "bucket int, block long, at long, words binary, own binary")
    return common.written(asked.groupBy("bucket").applyInArrow(answer, "block long, at long, counts binary, n long, v long"), "counts")


def pairs_of(tokens: np.ndarray, counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The hash of (word before, word) for each token."""
    own = words[tokens]
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[common.row_starts(counts)[:-1]] = START
    return common.mixed(before * np.uint64(0x9E3779B97F4A7C15) + own)


def spots(pair: np.ndarray, level: int, bits: np.ndarray | int) -> list[np.ndarray]:
    """Bit numbers of a level of some pairs, in segments of so many bits (below 2**32)."""
    h = common.mixed(pair + np.uint64(level * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
    low, high, bits = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32), np.asarray(bits, np.uint64)
    return [((((low + np.uint64(i) * (high | np.uint64(1))) & np.uint64(0xFFFFFFFF)) * bits) >> np.uint64(32)).astype(np.int64) for i in range(PROBES)]


class LogFrequencyFilter:
    """Segments by hash range, one behind the other in `bits`; begin and size in bits of each."""

    def __init__(self, segments: list[np.ndarray]):
        self.size = np.array([8 * len(s) for s in segments], np.int64)
        self.begin = common.row_starts(self.size)[:-1]
        self.bits = np.concatenate(segments) if segments else np.zeros(0, np.uint8)

    def counts(self, pair: np.ndarray) -> np.ndarray:
        """The quantised count of each pair: the middle of its highest level's counts, 0 if it is in none."""
        return COUNT[self.levels(pair)]

    def levels(self, pair: np.ndarray) -> np.ndarray:
        """The highest level that each pair is in, 0 if it is in none."""
        out = np.zeros(len(pair), np.uint8)
        if not len(self.size):
            return out
        edges = (np.arange(len(self.size), dtype=object) * (1 << 64) // len(self.size)).astype(np.uint64)
        where = np.searchsorted(edges, pair, "right") - 1
        left = np.flatnonzero(self.size[where] > 0)
        for level in range(1, len(BOUNDS)):
            p, s = pair[left], where[left]
            there = np.ones(len(left), bool)
            for bit in spots(p, level, self.size[s]):
                bit = bit + self.begin[s]
                there &= (self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
            left = left[there]
            if not len(left):
                break
            out[left] = level
        return out


def segment_of(pair: np.ndarray, level: np.ndarray) -> np.ndarray:
    """A segment that holds some distinct pairs up to their levels."""
    segment = np.zeros(-(-max(BITS_EACH * int(level.sum()), 64) // 8), np.uint8)
    for j in range(1, int(level.max(initial=0)) + 1):
        for spot in spots(pair[level >= j], j, 8 * len(segment)):
            np.bitwise_or.at(segment, spot >> 3, np.uint8(1) << (spot & 7).astype(np.uint8))
    return segment


def pair_levels(packed: DataFrame, number: int) -> DataFrame:
    """(block, at, levels): for a block's distinct pairs, in hash order, from `at` on, their levels in the filter of all training texts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                held, counts, tokens, words = unpack(batch, row)
                pair, place = np.unique(pairs_of(tokens, counts, words), return_inverse=True)
                n = np.bincount(place[np.repeat(~held, counts)], minlength=len(pair)).astype("<u4")
                at = ranges(pair, number)
                some = np.flatnonzero(np.diff(at))
                cut = [(at[i], at[i + 1]) for i in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), pa.array([batch.column("block")[row].as_py()] * len(some), pa.int64()), pa.array([int(a) for a, _ in cut], pa.int64()), common.binary([common.pack(np.diff(pair[a:b], prepend=np.uint64(0))) for a, b in cut]), common.binary([common.pack(n[a:b]) for a, b in cut])],
                    names=["bucket", "block", "at", "pairs", "n"],
                )

    def answer(group: pa.Table) -> pa.Table:
        pairs = [np.cumsum(common.unpacked(x, "<u8"), dtype=np.uint64) for x in group.column("pairs")]  # they travel as differences
        n = np.concatenate([common.unpacked(x, "<u4") for x in group.column("n")])
        distinct, place = np.unique(np.concatenate(pairs), return_inverse=True)
        total = np.bincount(place, n, len(distinct)).astype(np.int64)
        level = np.minimum(np.searchsorted(BOUNDS, total, "right"), len(MIDDLE))
        found = LogFrequencyFilter([segment_of(distinct, level)]).levels(distinct)[place]
        at = common.row_starts(np.array([len(x) for x in pairs]))
        return pa.table([group.column("block"), group.column("at"), common.binary([found[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)])], names=["block", "at", "levels"])

    asked = packed.select("block", "held_out", "counts", "tokens", "words").mapInArrow(ask, "bucket int, block long, at long, pairs binary, n binary")
    return asked.groupBy("bucket").applyInArrow(answer, "block long, at long, levels binary")


def score(docs: DataFrame, folds: int = 10, kappa: float = KAPPA) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (doc_id, text, ...).

    Learns from rows whose crc32(doc_id as text) mod folds isn't 0. A null or empty text has one token, its end. Long texts
    are read whole; repeated rows count, and come back, as often as they are there; an empty table gives an empty one.
    Without training rows N and V are 0 and the score is the base score. Other columns are not used.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    packed = blocks(docs, folds)
    size = packed.agg(F.sum(F.octet_length("words") / 8), F.sum(F.octet_length("tokens") / 4)).first()
    counts = word_counts(packed, max(1, int((size[0] or 0) // RANGE_WORDS) + 1))
    total = counts.agg(F.sum("n"), F.sum("v")).first()
    n, v = int(total[0] or 0), int(total[1] or 0)
    levels = pair_levels(packed, max(1, int((size[1] or 0) // RANGE_WORDS) + 1))
    # the start of a text is as frequent as its end
    trained = docs.select(common.held_out("doc_id", folds).alias("h")).filter(~F.col("h")).count()

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        held, many, tokens, words = unpack(block.to_batches()[0], 0)
        c = np.zeros(len(words), np.int64)
        pair, place = np.unique(pairs_of(tokens, many, words), return_inverse=True)
        level = np.zeros(len(pair), np.uint8)
        for at, own, of_pairs in zip(answers.column("at").to_pylist(), answers.column("counts"), answers.column("levels"), strict=True):
            if own.is_valid:
                own = common.unpacked(own, "<i8")
                c[at : at + len(own)] = own
            else:
                own = np.frombuffer(of_pairs.as_buffer(), np.uint8)
                level[at : at + len(own)] = own
        base = (c + 0.1) / (n + 0.1 * (v + 1))
        first = common.row_starts(many)
        before = np.empty(len(tokens), np.int64)
        before[1:] = c[tokens[:-1]]
        before[first[:-1]] = trained
        both = np.minimum(COUNT[level][place], np.minimum(before, c[tokens]))  # what the filter adds by mistake is never more than a word's own count
        p = (both + kappa * base[tokens]) / (before + kappa)
        add = lambda x: np.add.reduceat(x, first[:-1])
        columns = [pa.array(held), pa.array(many), pa.array(add((c[tokens] > 0).astype(np.int64))), pa.array(np.full(len(many), n, np.int64)), pa.array(add(np.log10(base)[tokens])), pa.array(add(np.log10(p)))]
        return pa.table([block.column("doc_ids").combine_chunks().flatten(), *columns], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def of_block(left: pa.Table, right: pa.Table) -> pa.Table:
        return run(left.combine_chunks(), right)

    answers = counts.drop("n", "v").unionByName(levels, allowMissingColumns=True)
    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(of_block, out)
