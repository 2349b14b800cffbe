"""Repeated passages across documents, by collinear chaining of shared seeds.

Seeds are the minimizers of a text's k-word windows, so any K + W - 1 equal words share one. Every occurrence of a seed is tied to the
first document that has it, and to the first ones that also have the same seed, or the same three seeds, behind it: where fragments
of a passage occur in earlier documents of their own, the longer keys lead to one that has more of it. Ties are made within a
slice of documents first, and only a slice's first occurrences go on; so a seed in a third of all documents costs a row a slice, and no
group is paired with itself.

No run of the least length that an earlier document has word for word is missed: where shared seeds lie as close as in a
repeated run, minimizers of windows SIDE words shorter are tied to the first document for each of the SIDE + 1 ways to have all
words of a full window. Ties of two documents are merged along their diagonal, and a Fenwick tree over the other document's
positions finds, for each stretch, the best chain to go on from under a cost for gaps. Chains are extended and aligned word by word; those of
enough words and identity are passages.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

K, W = 5, 6
MIN_WORDS, IDENTITY = 50, 0.8
GAP = 30  # words that a chain may skip in either document
REACH = 64  # words on either side that an extension gets at first; one that uses them all gets all there are
SIDE = 7  # words of context on either side of a shorter window
SLICE = 4 << 20
PIECE = 1 << 18  # words of one text that are looked at together
RANGE_SEEDS = 1 << 19

#: What an occurrence may share with an earlier one beyond its seed: bytes of its context.
SEED_KEYS = ((0, 2), (2, 4))
WINDOW_KEYS = tuple((a, a + SIDE) for a in range(SIDE + 1))


def sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every w neighbours."""
    at = 1
    while at < w:
        step = min(at, w - at)
        x = pick(x[:-step], x[step:])
        at += step
    return x


def minimizers(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, text, position) of the minimizers of each text."""
    long = counts >= K
    grams, _ = common.shingle_hashes(hashes[np.repeat(long, counts)], counts[long], K)
    many = counts[long] - K + 1
    texts = np.flatnonzero(long)
    # texts apart by W - 1 places that no window can pick, so that no window sees two texts
    first = common.row_starts(many + W - 1)
    x = np.full(first[-1] + 2 * W, np.iinfo(np.uint64).max, np.uint64)
    place = np.arange(many.sum()) - np.repeat(common.row_starts(many)[:-1], many)
    at = W - 1 + np.repeat(first[:-1], many) + place
    x[at] = grams
    highest = sliding(sliding(x, W, np.minimum), W, np.maximum)
    picked = highest[at - W + 1] == grams
    return grams[picked], np.repeat(texts, many)[picked], place[picked]


def seeds_of(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, text, position) of the minimizers of each text, in order. A very long text is read in pieces that overlap."""
    if counts.max(initial=0) <= PIECE:
        return minimizers(hashes, counts)
    found, begin = [], common.row_starts(counts)
    for i, n in enumerate(counts.tolist()):
        for a in range(0, max(1, n - K - W + 2), PIECE):
            seed, _, at = minimizers(hashes[begin[i] + a : begin[i] + min(n, a + PIECE + K + W - 2)], np.array([min(n, a + PIECE + K + W - 2) - a]))
            found.append((seed, np.full(len(seed), i), at + a))
    seed, text, at = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((at, text))
    order = order[np.append(True, (np.diff(text[order]) != 0) | (np.diff(at[order]) != 0))] if len(order) else order
    return seed[order], text[order], at[order]


def seeds_behind(seed: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Four bytes for each seed: a hash of the next seed of its text and a hash of the next three."""
    behind, out = np.zeros(len(seed), np.uint64), np.zeros((len(seed), 2), np.uint16)
    for j in (1, 2, 3):
        more = np.zeros(len(seed), np.uint64)
        more[:-j] = np.where(text[j:] == text[:-j], seed[j:], np.uint64(0))
        behind = common.mixed(behind + more)
        if j != 2:
            out[:, j // 2] = behind >> np.uint64(48)
    return out.view(np.uint8)


LINK = ["lo_id", "lo_th", "lo_at", "hi_id", "hi_th", "hi_at", "size"]


def first_holders(key: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, first, again): each occurrence `high` that isn't in its key's first document, and the place `low` there.

    Occurrences come in order of documents (who). A document's n-th place is tied to the first one's n-th; where that has fewer, it begins
    anew, so that a longer run of one word is tied along few diagonals. first: occurrences in first documents; again: their
    further places, where other documents have the key too.
    """
    order = np.argsort(key, kind="stable")
    if not len(order):
        return order, order, order, order
    k, d = key[order], who[order]
    new = np.append(True, k[1:] != k[:-1])
    begin = np.flatnonzero(new | np.append(True, d[1:] != d[:-1]))  # of a document's places
    many = np.diff(np.append(begin, len(k)))
    number = np.arange(len(k)) - np.repeat(begin, many)
    start = np.flatnonzero(new[begin])  # a key's first document
    docs = np.diff(np.append(start, len(begin)))
    of_first = np.repeat(np.repeat(start, docs), many)
    is_first = np.repeat(np.arange(len(begin)), many) == of_first
    low = begin[of_first] + number % many[of_first]
    again = is_first & (number > 0) & np.repeat(np.repeat(docs > 1, docs), many)
    return order[low[~is_first]], order[~is_first], order[is_first], order[again]


def tied(seed: np.ndarray, context: np.ndarray, who: np.ndarray, keys: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, first): places of occurrences tied to each other, and those that are the first for some key.

    A last byte of context that no key reads tells, if not 0, that the occurrence needs no tie to an earlier one. Further places of a first document are tied to themselves: chains leave that out, but it tells that the seed is shared there.
    """
    low, high, first, again = first_holders(seed, who)
    lows, highs, is_first = [low, again], [high, again], np.zeros(len(seed), bool)
    is_first[first] = True
    shared = np.zeros(len(seed), bool)
    shared[low] = shared[high] = shared[again] = True
    some = np.flatnonzero(shared)
    if len(some):
        for a, b in keys:
            extra = np.zeros((len(some), 8), np.uint8)
            extra[:, : b - a] = context[some, a:b]
            extra[:, 7] = b
            low, high, first, _ = first_holders(common.mixed(seed[some] + common.mixed(extra.view(np.uint64)[:, 0])), who[some])
            lows.append(some[low])
            highs.append(some[high])
            is_first[some[first]] = True
    both = np.unique(np.concatenate(lows) * max(1, len(seed)) + np.concatenate(highs))
    low, high = both // max(1, len(seed)), both % max(1, len(seed))
    if context.shape[1] > keys[-1][1]:
        left = context[high, -1] == 0
        low, high = low[left], high[left]
    return low, high, np.flatnonzero(is_first)


PARTS = (("doc", "<i8"), ("th", "<i4"), ("at", "<u4"))
ENDS = (("lo_id", "<i8"), ("lo_th", "<i4"), ("lo_at", "<u4"), ("hi_id", "<i8"), ("hi_th", "<i4"), ("hi_at", "<u4"))
DEALT = ", ".join(["bucket int", *(f"{n} binary" for n in ("seed", "context", *(n for n, _ in PARTS), *(n for n, _ in ENDS)))])


def dealt(seed: np.ndarray, context: np.ndarray, text: np.ndarray, at: np.ndarray, doc: np.ndarray, th: np.ndarray, keys: tuple, number: int) -> pa.RecordBatch:
    """A slice's ties, and its first occurrences by ranges of seeds; doc and th are of texts. Only ranges that hold something give a row."""
    rank = np.empty(len(doc), np.int64)
    rank[np.lexsort((th, doc))] = np.arange(len(doc))
    order = np.argsort(rank[text], kind="stable")
    seed, context, text, at = seed[order], context[order], text[order], at[order]
    low, high, first = tied(seed, context, rank[text], keys)
    first = first[np.argsort(seed[first], kind="stable")]
    cut = np.append(np.searchsorted(seed[first], (np.arange(number, dtype=object) * (1 << 64) // number).astype(np.uint64)), len(first))
    some = np.flatnonzero(np.diff(cut))
    spread = np.linspace(0, len(low), len(some) + 1).astype(np.int64)
    one = lambda x, t, b, e: common.binary([common.pack(x[i:j].astype(t)) for i, j in zip(b, e, strict=True)])
    begin, end = cut[some], cut[some + 1]
    gaps = np.diff(seed[first], prepend=np.uint64(0))
    gaps[begin] = seed[first][begin]
    cols = [one(gaps, "<u8", begin, end), common.binary([context[first[i:j]].T.tobytes() for i, j in zip(begin, end, strict=True)])]
    cols += [one(x[first], t, begin, end) for x, (_, t) in zip((doc[text], th[text], at), PARTS, strict=True)]
    cols += [one(x, t, spread[:-1], spread[1:]) for x, (_, t) in zip((doc[text[low]], th[text[low]], at[low], doc[text[high]], th[text[high]], at[high]), ENDS, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *cols], names=["bucket", "seed", "context", *(n for n, _ in PARTS), *(n for n, _ in ENDS)])


def ties(rows: DataFrame, keys: tuple, size: int) -> DataFrame:
    """Rows of LINK from what `dealt` made of slices; size: words of a seed."""

    def tie(group: pa.Table) -> pa.Table:
        seed = np.concatenate([np.cumsum(common.unpacked(x, "<u8"), dtype=np.uint64) for x in group.column("seed")])
        context = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, s.as_buffer().size // 8).T for x, s in zip(group.column("context"), group.column("seed"), strict=True)])
        doc, th, at = (np.concatenate([common.unpacked(x, t) for x in group.column(n)]).astype(np.int64) for n, t in PARTS)
        order = np.lexsort((at, th, doc))
        seed, context, doc, th, at = seed[order], context[order], doc[order], th[order], at[order]
        who = np.cumsum(np.append(False, (np.diff(doc) != 0) | (np.diff(th) != 0)))
        low, high, _ = tied(seed, context, who, keys)
        made = (doc[low], th[low], at[low], doc[high], th[high], at[high])
        found = [np.concatenate([common.unpacked(x, t) for x in group.column(n)] + [y.astype(t)]) for (n, t), y in zip(ENDS, made, strict=True)]
        return pa.table([*(pa.array(x.astype(np.int64 if t == "<i8" else np.int32)) for x, (_, t) in zip(found, ENDS, strict=True)), pa.array(np.full(len(found[0]), size, np.int32))], names=LINK)

    return rows.groupBy("bucket").applyInArrow(tie, "lo_id long, lo_th int, lo_at int, hi_id long, hi_th int, hi_at int, size int")


def links(docs: DataFrame) -> DataFrame:
    """Rows of LINK: a seed at word lo_at of one document and at word hi_at of a later one. Order: by doc_id, then th."""
    bytes_ = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = max(1, int(bytes_ // 24 // RANGE_SEEDS) + 1)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in common.text_slices(batches, limit=SLICE):
            *_, hashes, counts = common.words_of(part.column("text"))
            seed, text, at = seeds_of(hashes, counts)
            doc, th = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "th"))
            yield dealt(seed, seeds_behind(seed, text), text, at, doc, th, SEED_KEYS, number)

    return ties(docs.select("doc_id", "th", "text").mapInArrow(emit, DEALT), SEED_KEYS, K)


def dense(linked: DataFrame, n: int) -> DataFrame:
    """(doc_id, th, places): shared seeds of documents in which they lie as close as in a repeated run of n words somewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("places")
            many = lists.value_lengths().to_numpy()
            at, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(many)), many)
            start = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (np.diff(at) > W)))
            far = at[np.append(start[1:], len(at)) - 1] - at[start] >= n - K - 2 * (W - 1)
            keep = np.zeros(len(many), bool)
            keep[owner[start[far]]] = True
            yield batch.filter(pa.array(keep))

    sides = [linked.select(F.col(f"{s}_id").alias("doc_id"), F.col(f"{s}_th").alias("th"), F.col(f"{s}_at").alias("at")) for s in ("lo", "hi")]
    places = sides[0].unionByName(sides[1]).groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("at")).alias("places"))
    return places.mapInArrow(run, "doc_id long, th int, places array<int>")


def repeated_windows(words: np.ndarray, counts: np.ndarray, shared: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(seed, context, text, position) of windows of n - SIDE words, the smallest of each SIDE + 1 neighbours that make up n words.

    Only n-word windows in which each W neighbouring places have a shared seed count (shared: by word). Context: a byte for each of
    the SIDE words before and behind, 0 beyond the text.
    """
    size, total = n - SIDE, len(words)
    text, begin = np.repeat(np.arange(len(counts)), counts), common.row_starts(counts)
    at = np.arange(total) - np.repeat(begin[:-1], counts)
    mark = np.zeros(total, bool)
    hashed = np.zeros(total, np.uint64)
    power, back = common.powers(PIECE + n + 1), common.powers(PIECE + n + 1, common.INVERSE)
    for a in range(0, total, PIECE):
        b = min(total, a + PIECE)
        own = common.mixed(words[a : b + n])
        seen = np.cumsum(np.concatenate([[0], shared[a : b + n], np.zeros(2 * n, np.int64)]))
        bare = np.cumsum(np.append(0, seen[W : W + len(own) + n] == seen[: len(own) + n]))
        i = np.flatnonzero(at[a:b] + n <= counts[text[a:b]])
        i = i[bare[i + n - K - W + 2] == bare[i]]
        if not len(i):
            continue
        sums = np.append(np.uint64(0), np.cumsum(own * power[: len(own)], dtype=np.uint64))
        # the same words have the same hash wherever they stand: sums are divided by the power of their first place
        h = common.mixed((sums[size:] - sums[:-size]) * back[: len(sums) - size])
        least = sliding(h, SIDE + 1, np.minimum)[i]
        for j in range(SIDE + 1):
            hit = i[h[i + j] == least] + j
            mark[a + hit] = True
            hashed[a + hit] = h[hit]
    i = np.flatnonzero(mark)
    context = np.zeros((len(i), 2 * SIDE), np.uint8)
    for j in range(SIDE):
        for column, to in ((j, i - SIDE + j), (SIDE + j, i + size + j)):
            inside = (to >= begin[text[i]]) & (to < begin[text[i] + 1])
            context[inside, column] = words[to[inside]] % np.uint64(255) + np.uint64(1)
    return hashed[i], context, text[i], at[i]


def covered(spans: pa.Array, counts: np.ndarray, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether one span (start, end in words) of a text holds all from begin to end. spans: a list for each text."""
    first = common.row_starts(counts)
    owner = np.repeat(np.arange(len(counts)), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = spans.flatten()
    start, stop = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    far = np.zeros(first[-1] + 1, np.int64)
    np.maximum.at(far, first[owner] + start, first[owner] + stop)
    far = np.maximum.accumulate(far)  # a text's spans never reach into the next
    return far[first[text] + begin] >= first[text] + end


def window_links(words: DataFrame, n: int) -> DataFrame:
    """Rows of LINK for equal windows of n words. words (doc_id, th, words, places, spans): places are those of shared seeds; windows
    inside one of the spans are tied to no earlier one."""
    total = words.agg(F.sum(F.size("places"))).first()[0] or 0
    number = max(1, int(total // RANGE_SEEDS) + 1)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch.column("words").value_lengths().to_numpy())
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE // 8, "right")))
                part = batch.slice(a, b - a)
                a = b
                lists, places = part.column("words"), part.column("places")
                counts = lists.value_lengths().to_numpy().astype(np.int64)
                own = lists.flatten().to_numpy().view(np.uint32).astype(np.uint64)
                shared = np.zeros(len(own), np.int64)
                shared[np.repeat(common.row_starts(counts)[:-1], places.value_lengths().to_numpy()) + places.flatten().to_numpy()] = 1
                seed, context, text, at = repeated_windows(own, counts, shared, n)
                settled = covered(part.column("spans"), counts, text, np.maximum(0, at - SIDE), np.minimum(counts[text], at + n))
                context = np.hstack([context, settled[:, None].astype(np.uint8)])
                doc, th = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "th"))
                yield dealt(seed, context, text, at, doc, th, WINDOW_KEYS, number)

    rows = words.filter(F.col("places").isNotNull()).select("doc_id", "th", "words", "places", "spans")
    return ties(rows.mapInArrow(emit, DEALT), WINDOW_KEYS, n - SIDE)


def chain(low: np.ndarray, high: np.ndarray, size: np.ndarray) -> list[list[int]]:
    """Chains of stretches (low start, high start, words) of two documents: lists of their numbers, best first by end.

    Along a chain both starts come after the ends before. A chain's value is its words less the words skipped between
    stretches in either document. The stretches come in order of `high`; a Fenwick tree over the ends in the low document
    keeps the largest value + low end + high end of the chains that are complete where a stretch starts.
    """
    n = len(size)
    ends = np.unique(low + size)
    tree = [(-np.inf, -1)] * (len(ends) + 1)
    value, back = size.astype(float).tolist(), [-1] * n
    by_end = np.argsort(high + size, kind="stable").tolist()
    done = 0
    for j in range(n):
        while done < n and high[by_end[done]] + size[by_end[done]] <= high[j]:
            i = by_end[done]
            item = (value[i] + float(low[i] + high[i] + 2 * size[i]), i)
            at = int(np.searchsorted(ends, low[i] + size[i])) + 1
            while at <= len(ends):
                tree[at] = max(tree[at], item)
                at += at & -at
            done += 1
        at, best = int(np.searchsorted(ends, low[j], "right")), (-np.inf, -1)
        while at:
            best = max(best, tree[at])
            at -= at & -at
        gain = best[0] - float(low[j] + high[j])
        i = best[1]
        if i >= 0 and gain > 0 and max(low[j] - low[i] - size[i], high[j] - high[i] - size[i]) <= GAP:
            value[j], back[j] = size[j] + gain, i
    used, out = [False] * n, []
    for j in sorted(range(n), key=lambda j: -value[j]):
        own = []
        while j >= 0 and not used[j]:
            used[j] = True
            own.append(j)
            j = back[j]
        if own:
            out.append(own[::-1])
    return out


def stretches(t: np.ndarray) -> tuple[np.ndarray, ...]:
    """Links (columns as in LINK) merged along diagonals: (pair's first link, low start, high start, words) for each stretch."""
    pair = np.append(True, (t[1:, [0, 1, 3, 4]] != t[:-1, [0, 1, 3, 4]]).any(axis=1))
    number = np.cumsum(pair) - 1
    order = np.lexsort((t[:, 5], t[:, 5] - t[:, 2], number))
    number, low, high, size = number[order], t[order, 2], t[order, 5], t[order, 6]
    new = np.append(True, (number[1:] != number[:-1]) | (high[1:] - low[1:] != high[:-1] - low[:-1]) | (high[1:] - high[:-1] > size[:-1] + GAP))
    start = np.flatnonzero(new)
    return np.flatnonzero(pair)[number[start]], low[start], high[start], np.maximum.reduceat(high + size, start) - high[start]


CHAIN = "lo_id long, lo_th int, hi_id long, hi_th int, parts array<int>, weight int, begin int, end int"


def chains(linked: DataFrame) -> DataFrame:
    """(lo_id, lo_th, hi_id, hi_th, parts, weight, begin, end): parts holds low start, high start and words of each stretch of a chain, in
    order; weight is the sum of these words, begin and end are where the chain stands in the later document."""
    names = ["lo_id", "lo_th", "hi_id", "hi_th"]

    def of_pairs(t: np.ndarray) -> pa.RecordBatch:
        owner, low, high, size = stretches(t)
        start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        stop = np.append(start[1:], len(owner))
        rows, parts, more = [], [], []
        for a, b in zip(start.tolist(), stop.tolist(), strict=True):
            order = a + np.lexsort((low[a:b], high[a:b]))
            for own in chain(low[order], high[order], size[order]) if b - a > 1 else [[0]]:
                own = order[own]
                if high[own[-1]] + size[own[-1]] - high[own[0]] >= 2 * K:  # not a lone seed
                    rows.append(owner[a])
                    parts.append(np.stack([low[own], high[own], size[own]], axis=1).ravel().tolist())
                    more.append((int(size[own].sum()), int(high[own[0]]), int(high[own[-1]] + size[own[-1]])))
        row = t[rows] if rows else np.zeros((0, 7), np.int64)
        return pa.RecordBatch.from_arrays([*(pa.array(row[:, i].astype(np.int64 if i % 3 == 0 else np.int32)) for i in (0, 1, 3, 4)), pa.array(parts, pa.list_(pa.int32())), *(pa.array([m[i] for m in more], pa.int32()) for i in range(3))], names=[*names, "parts", "weight", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 7), np.int64)
        for batch in batches:
            t = np.concatenate([held, np.stack([batch.column(c).to_numpy().astype(np.int64) for c in LINK], axis=1)])
            if not len(t):
                continue
            last = int(np.flatnonzero((t[:, [0, 1, 3, 4]] != t[-1, [0, 1, 3, 4]]).any(axis=1))[-1:].sum() + 1) if (t[:, [0, 1, 3, 4]] != t[-1, [0, 1, 3, 4]]).any() else 0
            t, held = t[:last], t[last:]  # the last pair may go on in the next batch
            if len(t):
                yield of_pairs(t)
        if len(held):
            yield of_pairs(held)

    rows = linked.filter((F.col("lo_id") != F.col("hi_id")) | (F.col("lo_th") != F.col("hi_th"))).repartition(*names).sortWithinPartitions(*names, "hi_at", "lo_at")
    return rows.mapInArrow(run, CHAIN)


def foremost(found: DataFrame) -> DataFrame:
    """Chains with `first`: whether no heavier chain of the same later document stands where this one does, give or take GAP words."""
    columns = [f.split()[0] for f in CHAIN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, begins, ends = None, [], []  # of the chains taken, none inside another, so both are sorted
        for batch in batches:
            first = []
            for *own, begin, end in zip(*(batch.column(c).to_pylist() for c in ("hi_id", "hi_th", "begin", "end")), strict=True):
                if own != doc:
                    doc, begins, ends = own, [], []
                i = bisect_right(begins, begin + GAP)
                inside = i > 0 and ends[i - 1] >= end - GAP
                first.append(not inside)
                if not inside:
                    a, b = bisect_left(begins, begin), bisect_right(ends, end)
                    begins[a : max(a, b)], ends[a : max(a, b)] = [begin], [end]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(first, pa.bool_())], names=[*columns, "first"])

    rows = found.repartition("hi_id", "hi_th").sortWithinPartitions("hi_id", "hi_th", F.desc("weight"), "begin", "end", "lo_id", "lo_th")
    return rows.mapInArrow(run, f"{CHAIN}, first boolean")


def unsettled(found: DataFrame, passages: DataFrame) -> DataFrame:
    """The chains that stand in no passage of the later document."""
    own = passages.select(F.col("doc_id").alias("hi_id"), F.col("th").alias("hi_th"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    same = [found["hi_id"] == own["hi_id"], found["hi_th"] == own["hi_th"], own["p_start"] <= found["begin"], own["p_end"] >= found["end"]]
    return found.join(own, same, "left_anti")


def reach(a: np.ndarray, b: np.ndarray) -> int:
    """How far two word lists go together from their start: +1 for an equal word, -2 for another, until 12 below the best."""
    n = min(len(a), len(b))
    if not n:
        return 0
    value = np.cumsum(np.where(a[:n] == b[:n], 1, -2))
    best = np.maximum.accumulate(np.maximum(value, 0))
    stop = np.flatnonzero(best - value > 12)
    value = value[: stop[0]] if len(stop) else value
    return int(value.argmax()) + 1 if len(value) and value.max() > 0 else 0


def common_words(a: list[int], b: list[int]) -> int:
    """Words of a longest common subsequence; both have GAP words at most."""
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b):
            keep = row[j + 1]
            row[j + 1] = old + 1 if x == y else max(keep, row[j])
            old = keep
    return row[-1]


def equal_words(a: np.ndarray, b: np.ndarray) -> int:
    """Words that two stretches between seeds have in common, in order."""
    if len(a) == len(b):
        same = int((a == b).sum())
        if 2 * same >= len(a):
            return same
    return common_words(a.tolist(), b.tolist()) if len(a) and len(b) else 0


def aligned(parts: np.ndarray, low: np.ndarray, low_from: int, high: np.ndarray, high_from: int) -> tuple[int, ...]:
    """(low start, low end, high start, high end, equal words, words used before, words used behind) of a chain after extension,
    from the words around it."""
    equal, l_end, h_end = 0, None, None
    for l, h, n in parts.tolist():
        l, h = l - low_from, h - high_from
        if l_end is not None:
            equal += equal_words(low[l_end:l], high[h_end:h])
        equal += int((low[l : l + n] == high[h : h + n]).sum())
        l_end, h_end = l + n, h + n
    l, h = int(parts[0][0]) - low_from, int(parts[0][1]) - high_from
    before = reach(low[:l][::-1], high[:h][::-1])
    after = reach(low[l_end:], high[h_end:])
    equal += int((low[l - before : l] == high[h - before : h]).sum()) + int((low[l_end : l_end + after] == high[h_end : h_end + after]).sum())
    return low_from + l - before, low_from + l_end + after, high_from + h - before, high_from + h_end + after, equal, before, after


def marked(docs: DataFrame) -> tuple[DataFrame, Column]:
    """(doc_id, th, text) of the rows that take part, once each, and how th is made: a hash of the text if an id has several rows, else 0."""
    some = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    repeated = not some.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    th = F.hash("text") if repeated else F.lit(0)
    own = some.select(F.col("doc_id").cast("long").alias("doc_id"), th.alias("th"), "text")
    return (own.dropDuplicates(["doc_id", "th"]) if repeated else own), th


PASSAGE = "doc_id long, th int, start long, end long, other_id long, other_start long, other_end long, equal long"


def alignments(found: DataFrame, words: DataFrame, identity: float, min_words: int) -> DataFrame:
    """(doc_id, th, start, end, other_id, other_start, other_end, equal) of the chains that make a passage."""
    columns = ["doc_id", "th", "start", "end", "other_id", "other_start", "other_end", "equal"]
    chain_columns = ["lo_id", "lo_th", "hi_id", "hi_th", "parts"]

    def around(rows: DataFrame, most: int) -> DataFrame:
        for side, first, last in (("lo", "parts[0]", "parts[size(parts)-3] + parts[size(parts)-1]"), ("hi", "parts[1]", "parts[size(parts)-2] + parts[size(parts)-1]")):
            own = words.select(F.col("doc_id").alias(f"{side}_id"), F.col("th").alias(f"{side}_th"), "words")
            rows = rows.join(own, [f"{side}_id", f"{side}_th"]).withColumn(f"{side}_from", F.expr(f"greatest(0, {first} - {most})")).withColumn(f"{side}_more", F.expr(f"size(words) > {last} + {most}"))
            rows = rows.withColumn(f"{side}_words", F.expr(f"slice(words, {side}_from + 1, {last} + {most} - {side}_from)")).drop("words")
        return rows

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = {}
            for c in ("parts", "lo_words", "hi_words"):
                col = batch.column(c)
                lists[c] = (col.offsets.to_numpy(), col.values.to_numpy())
            got = np.zeros((batch.num_rows, 7), np.int64)
            sides = [batch.column(c).to_pylist() for c in ("lo_from", "hi_from", "lo_more", "hi_more")]
            most = np.zeros(batch.num_rows, bool)
            for i, (lf, hf, lm, hm) in enumerate(zip(*sides, strict=True)):
                p, lo, hi = (v[o[i] : o[i + 1]] for o, v in lists.values())
                p = p.reshape(-1, 3)
                got[i] = aligned(p, lo, lf, hi, hf)
                room = min(len(lo) - int(p[-1][0] + p[-1][2]) + lf, len(hi) - int(p[-1][1] + p[-1][2]) + hf)
                most[i] = (lf and hf and got[i, 5] == min(p[0][0] - lf, p[0][1] - hf)) or (lm and hm and got[i, 6] == room)
            size = np.maximum(got[:, 1] - got[:, 0], got[:, 3] - got[:, 2])
            least = np.minimum(got[:, 1] - got[:, 0], got[:, 3] - got[:, 2])
            keep = pa.array(most | ((least >= min_words) & (got[:, 4] >= identity * size)))
            cols = [*(batch.column(c) for c in chain_columns), *(pa.array(got[:, j]) for j in (2, 3, 0, 1, 4)), pa.array(most)]
            yield pa.RecordBatch.from_arrays(cols, names=[*chain_columns, "start", "end", "other_start", "other_end", "equal", "most"]).filter(keep)

    out = None
    for most in (REACH, 1 << 28):
        kind = "lo_id long, lo_th int, hi_id long, hi_th int, parts array<int>, start long, end long, other_start long, other_end long, equal long, most boolean"
        done = common.written(around(found, most).mapInArrow(align, kind), "aligned")
        own = done.filter("not most").select(F.col("hi_id").alias("doc_id"), F.col("hi_th").alias("th"), "start", "end", F.col("lo_id").alias("other_id"), "other_start", "other_end", "equal")
        out = own if out is None else out.unionByName(own)
        found = done.filter("most").select(*chain_columns)
        if found.isEmpty():
            break
    return out.select(*columns).distinct()


def settled(found: DataFrame, words: DataFrame, identity: float, min_words: int) -> DataFrame | None:
    """Passages of the chains: of the heaviest ones, then of all others that stand in no passage that these have made. So a document
    is aligned with one of many near copies, and what that doesn't cover with others. None without chains.
    """
    if found.isEmpty():
        return None
    chosen = common.written(foremost(found), "chains")
    out = common.written(alignments(chosen.filter("first"), words, identity, min_words), "passages")
    rest = common.written(unsettled(chosen.filter("not first").drop("first"), out), "chains")
    return out if rest.isEmpty() else out.unionByName(common.written(alignments(rest, words, identity, min_words), "passages"))


def passages(docs: DataFrame, min_words: int = MIN_WORDS, identity: float = IDENTITY) -> DataFrame:
    """(doc_id, th, start, end, other_id, other_start, other_end, equal): passages of a document that an earlier one has too.

    start and end count words; equal: words alike. A passage has min_words (at least 2 * SIDE) in both documents at least, and equal words of at
    least `identity` times the longer side. Runs that are equal word for word are all found; of passages with changed words, at least nine tenths of
    those of identity 0.88 and more are, and fewer between that and `identity` (figures in the README). Earlier: by doc_id, then by th. th is 0; only in a table in which an id has several rows is it a
    hash of the text. Rows whose doc_id or text is null take no part; empty texts have no words. Equal rows are one document and no repeat
    of each other; rows with one doc_id and different texts are different documents. Repeats within one document don't count. Long texts are
    read whole; an empty table gives an empty one. Other columns are not used.
    """
    own, _ = marked(docs)
    min_words = max(min_words, 2 * SIDE)
    linked = common.written(links(own), "links")
    by_seeds = common.written(chains(linked), "chains")
    wanted = dense(linked, min_words)
    for side in ("lo", "hi"):
        ids = by_seeds.select(F.col(f"{side}_id").alias("doc_id"), F.col(f"{side}_th").alias("th"))
        wanted = wanted.unionByName(ids, allowMissingColumns=True)
    wanted = wanted.groupBy("doc_id", "th").agg(F.max("places").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in common.text_slices(batches):
            *_, hashes, counts = common.words_of(part.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(common.row_starts(counts).astype(np.int32)), pa.array((hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), lists], names=["doc_id", "th", "words"])

    # every round of alignment reads some of them by document; dealt by hand, so that a bucket is written by one task however the join is made
    number = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = own.mapInArrow(run, "doc_id long, th int, words array<int>").repartition(number, "doc_id", "th")
    words = common.bucketed(hashed.join(wanted, ["doc_id", "th"]), "words", "doc_id", "th")
    out = settled(by_seeds, words, identity, min_words)
    none = own.sparkSession.createDataFrame([], PASSAGE)
    out = none if out is None else out
    # runs that are equal word for word, where chains of seeds have left any out
    spans = out.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    more = chains(window_links(words.join(spans, ["doc_id", "th"], "left"), min_words))
    more = settled(common.written(unsettled(more, out), "chains"), words, identity, min_words)
    return (out if more is None else out.unionByName(more)).distinct()


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, identity: float = IDENTITY) -> DataFrame:
    """docs with every passage that an earlier document has too cut from its text, and n_chars set anew where there is one.

    Words are cut with the white space after them. Texts without repeats, and rows that take no part (null id or text), stay as they
    are. Repeated rows stay repeated; long texts are read whole; an empty table gives an empty one. Columns of any name stay.
    """
    cut_id, cut_th, cut_spans = (common.fresh(docs.columns, n) for n in ("cut_id", "cut_th", "cut_spans"))
    spans = passages(docs, min_words, identity).groupBy(F.col("doc_id").alias(cut_id), F.col("th").alias(cut_th)).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias(cut_spans))
    spans = common.written(spans, "spans")
    rows = docs.withColumn(cut_th, marked(docs)[1]).withColumn(cut_id, F.col("doc_id").cast("long")).join(spans, [cut_id, cut_th], "left")
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in common.text_slices(batches):
            texts = part.column("text").to_pylist()
            for i, spans_ in enumerate(part.column(cut_spans).to_pylist()):
                if spans_:
                    data = texts[i].encode()
                    starts, _ = common.word_spans(np.frombuffer(data + b"\n", np.uint8))
                    starts = [*starts.tolist(), len(data)]
                    out, at = [], 0
                    for s in spans_:
                        a, b = starts[min(s["start"], len(starts) - 1)], starts[min(s["end"], len(starts) - 1)]
                        if a > at:
                            out.append(data[at:a])
                        at = max(at, b)
                    texts[i] = b"".join([*out, data[at:]]).decode()
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, "text"])

    done = rows.select(*kept, "text", cut_spans).mapInArrow(run, common.fields(docs, [*kept, "text"]))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return done.select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, other_doc_id, start_word, end_word, other_start_word, other_end_word, equal_words."""
    p = passages(docs)
    return p.select("doc_id", F.col("other_id").alias("other_doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), F.col("other_start").alias("other_start_word"), F.col("other_end").alias("other_end_word"), F.col("equal").alias("equal_words"))
