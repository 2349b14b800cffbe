"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pieces of a block of documents are laid out as one array of token ids with links to the left and right
neighbour. An inverted index leads from each adjacent pair of ids to its positions. Merges are taken in rank order from
a heap of the ranks that occur; each touches its positions and their neighbours only. Blocks are bounded, so a task's
memory is too, and nothing is shuffled: documents stay where they were read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common

#: Pieces that a task keeps between blocks. It only saves work: what isn't kept is encoded again.
KEPT_PIECES = 200_000
BLOCK_BYTES = 4 << 20


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and a number."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Codec:
    """Merge tables of one rank file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        keys, merged = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int64)[order]
        # merging into these can make a pair of lower rank than their own
        parts = np.concatenate([self.keys >> 32, self.keys & 0xFFFFFFFF])
        self.early = set(parts[np.concatenate([self.merged, self.merged]) < parts].tolist())
        self.keys, self.merged = np.append(self.keys, np.iinfo(np.int64).max), np.append(self.merged, -1)  # a search ends here
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the token that each pair of ids makes; -1 where it makes none."""
        key = left << 32 | right
        at = self.keys.searchsorted(key)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, where each piece starts in them, one more than pieces).

        Equal to merging, in each piece, the leftmost pair of lowest rank until none is left.
        """
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
        begins = common.row_starts(size)
        n = int(begins[-1])
        ids = np.full(n, -1, np.int64)  # -1: the wall after each piece; -2: swallowed by its left neighbour
        inside = np.ones(n, bool)
        inside[begins[1:] - 1] = False
        ids[inside] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), size)
        for i, rank in enumerate(map(self.ranks.get, pieces)):
            if rank is not None:  # a piece that is a token is that token
                ids[begins[i] : begins[i + 1]] = -2
                ids[begins[i]] = rank
        left, right = np.arange(-1, n - 1), np.arange(1, n + 1)
        if n < 2:
            return ids[ids >= 0], np.zeros(len(pieces) + 1, np.int64)
        first = np.append(self.pair(ids[:-1], ids[1:]), -1)
        listed = np.flatnonzero(first >= 0)
        listed = listed[np.argsort(first[listed], kind="stable")]
        found, start = np.unique(first[listed], return_index=True)
        # the inverted index: id of the merged token to the places of its left half
        at_first = dict(zip(found.tolist(), np.split(listed, start[1:]), strict=True)) if len(found) else {}
        index: dict[int, list[int]] = {}  # places that merges have added
        heap = list(at_first)
        heapify(heap)
        while heap:
            new = heappop(heap)
            p, more = at_first.pop(new, None), index.pop(new, None)
            if more:
                p = np.unique(more) if p is None else np.union1d(p, more)
            q = right[p]
            live = self.pair(ids[p], ids[q]) == new  # else changed since it was listed
            if not live.all():
                p, q = p[live], q[live]
            if not len(p):
                continue
            if len(p) > 1:
                if new in self.early and (again := owner[p[1:]] == owner[p[:-1]]).any():
                    later = np.append(False, again)
                    index[new] = p[later].tolist()
                    heappush(heap, new)
                    p, q = p[~later], q[~later]
                elif (meet := q[:-1] == p[1:]).any():  # as in a run of one letter: from the left, each place once
                    take, free = np.ones(len(p), bool), True
                    for i in range(1, len(p)):
                        free = not (meet[i - 1] and free)
                        take[i] = free
                    p, q = p[take], q[take]
            r = right[q]
            ids[p], ids[q], right[p], left[r] = new, -2, r, p
            o = left[p]
            for at, made in ((p, self.pair(ids[p], ids[r])), (o, np.where(o >= 0, self.pair(ids[o], ids[p]), -1))):
                some = made >= 0
                if some.any():
                    for t, x in zip(made[some].tolist(), at[some].tolist(), strict=True):
                        if t in index:
                            index[t].append(x)
                        else:
                            index[t] = [x]
                            if t not in at_first:
                                heappush(heap, t)
        return ids[ids >= 0], common.row_starts(np.bincount(owner[ids >= 0], minlength=len(pieces)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Encoder:
    """Encodes blocks of texts, keeping what it knows between blocks."""

    def __init__(self, codec: Codec, pattern: str):
        import regex

        self.codec, self.pieces_of, self.known = codec, regex.compile(pattern).findall, {}

    def block(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        known = self.known
        if len(known) > KEPT_PIECES:
            known.clear()
        split = [self.pieces_of(t) for t in texts]
        fresh = list(set().union(*split).difference(known))
        ids, begins = self.codec.replay([p.encode() for p in fresh])
        flat, ends = ids.astype("<u4").tobytes(), (4 * begins).tolist()
        known.update(zip(fresh, (flat[a:b] for a, b in zip(ends, ends[1:], strict=False)), strict=True))
        return [b"".join(map(known.__getitem__, pieces)) for pieces in split]


def encode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256 and (with_ids) ids, binary: little-endian unsigned 32-bit.

    A null text is the empty text: no ids, the hash of no bytes. Long texts are encoded whole. Repeated rows give repeated
    rows, an empty table an empty one. Columns of docs that have one of these names are replaced, others stay.
    ranks_path is read once, on the driver, and travels with the job; its size doesn't grow with the data.
    """
    added = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")] + [("ids", "binary")] * with_ids
    names = {n for n, _ in added}
    kept = [c for c in docs.columns if c not in names]
    with open(ranks_path, "rb") as lines:
        ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(lines))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value)
        encoder = Encoder(codec, pattern)
        lengths = np.zeros(max(codec.tokens, default=0) + 1, np.int64)
        for i, t in codec.tokens.items():
            lengths[i] = len(t)
        begins = common.row_starts(lengths)
        flat = np.frombuffer(b"".join(codec.tokens.get(i, b"") for i in range(len(lengths))), np.uint8)
        for part, _ in common.text_slices(batches, limit=BLOCK_BYTES):
            found = encoder.block(pc.fill_null(part.column("text"), "").to_pylist())
            decoded = []
            for own in found:
                digest = hashlib.sha256()
                ids = np.frombuffer(own, "<u4")
                for at in range(0, len(ids), 1 << 16):  # token bytes by gathering, a part at a time
                    some = ids[at : at + (1 << 16)]
                    size = lengths[some]
                    first = common.row_starts(size)
                    digest.update(flat[np.arange(first[-1]) + np.repeat(begins[some] - first[:-1], size)].tobytes())
                decoded.append(digest.hexdigest())
            cols = [part.column(c) for c in kept]
            cols += [pa.array([len(x) // 4 for x in found], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                cols.append(pa.array(found, pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, *(n for n, _ in added)])

    return docs.select(*kept).mapInArrow(run, ", ".join([common.fields(docs, kept), *(f"{n} {t}" for n, t in added)]))


def digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    return encode(docs.select("doc_id", "text"), ranks_path, pattern, with_ids=False).drop("text")
