"""Cross-tokenizer alignment: the tokens of two tokenizers over the same bytes, by lockstep merging.

Both tokenizers encode each text. The ends of their tokens, as byte offsets, are two ascending lists, and a document is a lane with one
pointer into each. One vector holds the pointers of all lanes of a batch: a step compares the two ends of every lane at once and moves the pointer
of the smaller one; where they are equal it moves both and puts out a cut, which closes a group of tokens. Lanes that have reached their end
are taken out of the vector. As a merge of ascending lists can begin at any offset, a long document is several lanes, each begun by binary
search, so the number of steps is bounded and the vector is wide, whatever the lengths of texts. The groups' tokens are tied to each other,
all of one side with all of the other.

Then the links of each block's documents are counted as sparse rows over the block's distinct pairs of ids. Only these pairs, a row each,
are added up over the corpus, and find their way back to their block.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, common

BLOCK_BYTES = 2 << 20
#: Token ends of both sides in one lane.
LANE = 1024
#: Links that are spelled out at once.
LINKS = 1 << 21
#: Texts with so many characters in one word, or so much more white space than words, go to the tokenizer's own library.
LONG_PIECE = 1000
#: Characters whose class, letter, number, white space or neither, is the same in every version of Unicode that a tokenizer may have been built with.
SETTLED = r"\u0000-\u052F\u1E00-\u1FFF\u2000-\u206F\u20A0-\u20BF\u3000-\u30FF\u4E00-\u9FA5\uAC00-\uD7A3"


def byte_tokens(vocabulary: dict[str, int]) -> dict[int, bytes]:
    """Id to bytes of a byte-level vocabulary: printable bytes stand for themselves, the others for the characters from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    return {i: bytes(map(byte_of.__getitem__, t)) if all(c in byte_of for c in t) else t.encode() for t, i in vocabulary.items()}


def ranks_of(a_json: str) -> dict[bytes, int] | None:
    """Token bytes to rank, if merging the pair of lowest rank does what the tokenizer's list of merges does; else None.

    It does if ids ascend in the order of merges and every token, merged by the list from its own bytes alone, becomes itself. For then two
    tokens that stand side by side and together are a token were both made within its bytes, in the same order as there, so they are the
    pair that the list has for it.
    """
    whole = json.loads(a_json)
    model, before = whole["model"], whole.get("pre_tokenizer") or {}
    usual = model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not model.get("unk_token") and whole.get("normalizer") is None
    if not usual or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    special = {t["content"] for t in whole.get("added_tokens", [])}
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
    ranks = {t: i for i, t in byte_tokens(vocabulary).items()}
    parts = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [vocabulary.get(x + y, -1) for x, y in parts]
    if any(bytes([b]) not in ranks for b in range(256)) or min(made, default=0) < 0 or any(x >= y for x, y in zip(made, made[1:], strict=False)):
        return None
    codec = bpe.Codec(ranks)
    listed = np.append(np.isin(codec.keys[:-1], [vocabulary[x] << 32 | vocabulary[y] for x, y in parts]), True)
    codec.keys, codec.merged, codec.ranks = codec.keys[listed], codec.merged[listed], {}
    tokens = list(ranks)
    ids, begins = codec.replay(tokens)
    return ranks if len(ids) == len(tokens) and (np.diff(begins) == 1).all() and ids.tolist() == [ranks[t] for t in tokens] else None


class Pair:
    """The two tokenizers in a worker, with the bytes of their tokens."""

    def __init__(self, a_json: str, ranks: dict[bytes, int] | None, b_model: bytes, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a_json), sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.a.encode_special_tokens = True
        self.ranked = ranks and tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.unsettled = regex.compile(f"[^{SETTLED}]").search
        self.a_bytes = self.table(byte_tokens(self.a.get_vocab(with_added_tokens=True)))
        pieces = {i: self.b.id_to_piece(i) for i in range(self.b.get_piece_size())}
        self.b_bytes = self.table({i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in pieces.items()})

    @staticmethod
    def table(tokens: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all bytes, where each id's begin, how many they are)."""
        own = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        size = np.array([len(t) for t in own], np.int64)
        return np.frombuffer(b"".join(own), np.uint8), common.row_starts(size)[:-1], size

    def usual(self, text: str) -> bool:
        """Whether ranks may encode the text: no characters on which versions of Unicode differ, no very long piece."""
        if not self.ranked or not text.isascii() and self.unsettled(text):
            return False
        words = text.split()
        size = sum(map(len, words))
        return len(text) - size - len(words) < LONG_PIECE and (size < LONG_PIECE or max(map(len, words)) < LONG_PIECE)

    def encode_a(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts: by ranks, which is faster, where that is the same, else by the tokenizer's own library."""
        by_ranks = [self.usual(t) for t in texts]
        other = iter(self.a.encode_batch_fast([t for t, ok in zip(texts, by_ranks, strict=True) if not ok], add_special_tokens=False))
        return [np.array(self.ranked.encode_ordinary(t) if ok else next(other).ids, np.int32) for t, ok in zip(texts, by_ranks, strict=True)]

    def encode_b(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int32) for x in self.b.encode(texts, num_threads=1)] if texts else []


def token_bytes(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    flat, first, size = table
    return flat[common.spread(first[ids], size[ids])]


def same_bytes(ids: list[np.ndarray], table: tuple[np.ndarray, np.ndarray, np.ndarray], texts: list[bytes]) -> np.ndarray:
    """Whether the bytes of each text's tokens are the text."""
    size = table[2]
    return np.array([int(size[x].sum()) == len(t) and token_bytes(x, table).tobytes() == t for x, t in zip(ids, texts, strict=True)], bool)


def cuts(a_end: np.ndarray, b_end: np.ndarray, a_doc: np.ndarray, b_doc: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """(end of each group in A's tokens, end in B's tokens): places after the groups' last tokens, in order.

    a_end and b_end: byte offsets of token ends over all documents one behind the other, ascending; a_doc, b_doc: where each document's
    tokens begin, and the end. The ends of each document's two lists agree.
    """
    if not len(a_end):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # lanes: each document from the start of its tokens, and once more after every `lane` of A's and B's token ends, taken together
    tokens = np.diff(a_doc) + np.diff(b_doc)
    many = -(-tokens // lane)
    doc = np.repeat(np.arange(len(tokens)), many)
    share = common.spread(np.zeros(len(many), np.int64), many) / np.repeat(many, many)
    i = a_doc[doc] + (share * np.diff(a_doc)[doc]).astype(np.int64)
    begin = np.where(i > 0, a_end[np.maximum(i - 1, 0)], 0)  # a lane begins after a token of A; its first token of B is the first that ends behind
    j = np.maximum(np.searchsorted(b_end, begin, "right"), b_doc[doc])
    last = np.where(np.append(doc[1:] != doc[:-1], True), a_doc[doc + 1], np.append(i[1:], 0))
    stop = a_end[last - 1]  # offsets up to here are this lane's
    keep = last > i
    i, j, stop = i[keep], j[keep], stop[keep]
    found_a, found_b = [], []
    n_b = len(b_end)
    while len(i):
        x, y = a_end[i], b_end[np.minimum(j, n_b - 1)]
        equal = x == y
        if equal.any():
            found_a.append(i[equal])
            found_b.append(j[equal])
        least = np.minimum(x, y)
        i, j = i + (x <= y), j + (y <= x)
        going = least < stop
        if not going.all():
            i, j, stop = i[going], j[going], stop[going]
    a, b = (np.concatenate([*f, np.zeros(0, np.int64)]) for f in (found_a, found_b))
    order = np.argsort(a)
    return a[order] + 1, b[order] + 1


def pairs(a_ids: np.ndarray, b_ids: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, A id << 32 | B id, links), in parts: the links of each group, all tokens of one side with all of the other.

    Equal ids of a group are taken together, so a long group of few different tokens is few pairs; LINKS pairs are held at most, about."""
    a_many, b_many = np.diff(a_cut, prepend=0), np.diff(b_cut, prepend=0)
    single = (a_many == 1) & (b_many == 1)
    yield doc[single], a_ids[a_cut[single] - 1].astype(np.int64) << 32 | b_ids[b_cut[single] - 1], np.ones(int(single.sum()), np.int64)
    rest = np.flatnonzero(~single)
    if not len(rest):
        return
    side = []
    for ids, cut, many in ((a_ids, a_cut, a_many), (b_ids, b_cut, b_many)):
        group = np.repeat(np.arange(len(rest)), many[rest])
        key, times = np.unique(group << 32 | ids[common.spread((cut - many)[rest], many[rest])].astype(np.int64), return_counts=True)
        side.append((key & 0xFFFFFFFF, times, common.row_starts(np.bincount(key >> 32, minlength=len(rest)))))
    (a_id, a_times, a_at), (b_id, b_times, b_at) = side
    # a row for each distinct A id of a group; it meets the group's distinct B ids
    row_group = np.repeat(np.arange(len(rest)), np.diff(a_at))
    meets = np.diff(b_at)[row_group]
    ends = np.cumsum(meets)
    at = 0
    while at < len(meets):
        until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LINKS, "right")))
        some = slice(at, until)
        left = np.repeat(np.arange(at, until), meets[some])
        right = common.spread(b_at[row_group[some]], meets[some])
        yield doc[rest[row_group[left]]], a_id[left] << 32 | b_id[right], a_times[left] * b_times[right]
        at = until


def written_out(a_ids: np.ndarray, b_ids: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(`a1,a2|b1;a3|b2,b3;` of all groups as bytes, where each group's bytes end)."""
    n_a, n_b = len(a_ids), len(b_ids)
    a_group, b_group = (np.repeat(np.arange(len(c)), np.diff(c, prepend=0)) for c in (a_cut, b_cut))
    ids, mark = np.empty(n_a + n_b, np.int64), np.full(n_a + n_b, ord(","), np.uint8)
    a_at, b_at = np.arange(n_a) + np.append(0, b_cut)[a_group], np.arange(n_b) + a_cut[b_group]
    ids[a_at], ids[b_at] = a_ids, b_ids
    mark[a_at[a_cut - 1]] = ord("|")
    mark[b_at[b_cut - 1]] = ord(";")
    digits = len(str(int(ids.max(initial=0))))
    number = np.arange(int(ids.max(initial=0)) + 1)
    shapes = np.stack([number // 10 ** (digits - 1 - d) % 10 + 48 for d in range(digits)] + [number], axis=1).astype(np.uint8)
    filled = np.stack([number >= 10 ** (digits - 1 - d) for d in range(digits - 1)] + [number >= 0] * 2, axis=1)
    text, used = shapes[ids], filled[ids]
    text[:, digits] = mark
    return text[used], np.cumsum(used.sum(axis=1))[b_at[b_cut - 1]]


def aligned(part: pa.RecordBatch, tokenizers: Pair) -> dict[str, np.ndarray | list]:
    """What a block's documents (text) have: tokens, groups and links, and their distinct pairs."""
    texts = pc.fill_null(part.column("text"), "").to_pylist()
    raw = [b" " + t.encode() if t else b"" for t in texts]
    some = [i for i, t in enumerate(texts) if t]
    a_ids, b_ids = tokenizers.encode_a([" " + texts[i] for i in some]), tokenizers.encode_b([texts[i] for i in some])
    own = [raw[i] for i in some]
    good = same_bytes(a_ids, tokenizers.a_bytes, own) & same_bytes(b_ids, tokenizers.b_bytes, own)
    none = np.zeros(0, np.int32)
    n_a, n_b = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    at = np.array(some, np.int64)[good]
    a_ids, b_ids = ([x for x, ok in zip(ids, good, strict=True) if ok] for ids in (a_ids, b_ids))
    n_a[at], n_b[at] = [len(x) for x in a_ids], [len(x) for x in b_ids]
    a_ids, b_ids = (np.concatenate([none, *ids]) for ids in (a_ids, b_ids))
    a_doc, b_doc = common.row_starts(n_a), common.row_starts(n_b)
    a_cut, b_cut = cuts(np.cumsum(tokenizers.a_bytes[2][a_ids]), np.cumsum(tokenizers.b_bytes[2][b_ids]), a_doc, b_doc)
    doc = np.searchsorted(a_doc, a_cut, "left") - 1
    n_groups = np.bincount(doc, minlength=len(texts))
    n_links = np.bincount(doc, np.diff(a_cut, prepend=0) * np.diff(b_cut, prepend=0), len(texts)).astype(np.int64)
    out, group_ends = written_out(a_ids, b_ids, a_cut, b_cut) if len(a_cut) else (np.zeros(0, np.uint8), np.zeros(0, np.int64))
    ends = np.append(0, group_ends)[common.row_starts(n_groups)]
    hashes = [hashlib.sha256(out[x : y - 1].tobytes()).hexdigest() if y > x else "" for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    rows, keys, times = (np.concatenate(x) for x in zip(*pairs(a_ids, b_ids, a_cut, b_cut, doc), strict=True))
    place, distinct = pd.factorize(keys)
    cell_of, cell = pd.factorize(rows * max(1, len(distinct)) + place)
    order = np.argsort(cell)
    cell, links = cell[order], np.bincount(cell_of, times, len(cell)).astype(np.int64)[order]
    row, pair = np.divmod(cell, max(1, len(distinct)))
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": hashes, "keys": distinct, "docs": np.bincount(pair, minlength=len(distinct)), "row": row, "pair": pair, "links": links}


def blocks(docs: DataFrame, a_json: str, b_model: bytes, pattern: str) -> DataFrame:
    """A row for each block of documents, in shared storage: their figures as lists, the block's distinct pairs, and the documents' links over these."""
    model = docs.sparkSession.sparkContext.broadcast((a_json, ranks_of(a_json), b_model))
    kind = docs.schema["doc_id"].dataType.simpleString()
    lists = ["n_a", "n_b", "n_groups", "n_links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = Pair(*model.value, pattern)
        for part, _ in common.text_slices(batches, limit=BLOCK_BYTES):
            x = aligned(part, tokenizers)
            row = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            one = lambda values, t: pa.array([common.pack(values.astype(t))], pa.binary())
            # the documents' cells as counts, so that they travel as small numbers
            cells = np.bincount(x["row"], minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [row(part.column("doc_id")), *(row(pa.array(x[n])) for n in lists), row(pa.array(x["groups_sha256"], pa.string())), row(pa.array(x["keys"])), row(pa.array(x["docs"].astype(np.int64))), one(cells, "<u4"), one(x["pair"], "<u4"), one(x["links"], "<u4")],
                names=["doc_ids", *lists, "groups_sha256", "pairs", "pair_docs", "cells", "cell_pairs", "cell_links"],
            )

    schema = f"doc_ids array<{kind}>, {', '.join(f'{n} array<long>' for n in lists)}, groups_sha256 array<string>, pairs array<long>, pair_docs array<long>, cells binary, cell_pairs binary, cell_links binary"
    rows = docs.select("doc_id", "text").mapInArrow(run, schema)
    return common.written(rows.withColumn("block", F.monotonically_increasing_id()), "aligned")


def pair_counts(packed: DataFrame) -> DataFrame:
    """(pair, count, best): in how many documents each pair of ids is linked, and whether no pair of its A id is in more."""
    pairs_ = packed.select(F.explode(F.arrays_zip("pairs", "pair_docs")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.pair_docs").alias("count"))
    of_a = Window.partitionBy(F.shiftright("pair", 32))  # as many rows as B has ids, at most
    return pairs_.withColumn("best", F.col("count") == F.max("count").over(of_a))


def align(docs: DataFrame, a_json: str, b_model: bytes, pattern: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs (doc_id, text, ...).

    a_json: a byte-level tokenizer, which gets a space and the text; b_model: a sentencepiece model, which puts the space itself; both are
    contents of files, whose size doesn't grow with the data. pattern: how A cuts a text into pieces. Special tokens are plain text.

    Groups lie between byte offsets at which tokens of both end. Links are all pairs of an A and a B token of a group. A pair of ids counts
    in how many documents (rows) it is linked; count_sum is the sum over links, n_best the number of links whose pair is its A id's most frequent one,
    ties included. groups_sha256 is the hash of `a1,a2|b1;a3|b2,b3`.

    A null or empty text, and one whose tokens' bytes aren't a space and the text, has no tokens: zeros, and '' for the hash. Repeated rows count
    as often as they are there. Long texts are aligned whole. An empty table gives an empty one. Other columns are not used.
    """
    packed = blocks(docs, a_json, b_model, pattern)
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = common.written(pair_counts(packed), "pairs")
    answers = packed.select(F.col("block").alias("asker"), F.posexplode("pairs").alias("at", "pair")).join(counts, "pair").select("asker", "at", "count", "best")
    lists = ["n_a", "n_b", "n_groups", "n_links"]

    def of_block(block: pa.Table, answer: pa.Table) -> pa.Table:
        at = answer.column("at").to_numpy()
        count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        count[at], best[at] = answer.column("count").to_numpy(), answer.column("best").to_numpy()
        block = block.combine_chunks()
        cells, pair, links = (common.unpacked(block.column(c)[0], "<u4").astype(np.int64) for c in ("cells", "cell_pairs", "cell_links"))
        at = common.row_starts(cells)
        total = lambda x: np.diff(common.row_starts(x)[at])
        own = lambda c: block.column(c).combine_chunks().flatten()
        return pa.table([own("doc_ids"), *map(own, lists), pa.array(total(links * best[pair])), pa.array(total(links * count[pair])), own("groups_sha256")], names=["doc_id", *lists, "n_best", "count_sum", "groups_sha256"])

    out = f"doc_id {kind}, {', '.join(f'{n} long' for n in [*lists, 'n_best', 'count_sum'])}, groups_sha256 string"
    own = packed.drop("pairs", "pair_docs")
    return own.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(of_block, out)
