"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes, cut into blocks; two neighbouring blocks are one chunk, so chunks overlap by half and cover the
whole text. Learned filters slide over the bytes, the largest response of each filter in a chunk is kept, a small hidden
layer reads the responses of a chunk, and the largest hidden values over all chunks give one probability.

The network is fitted on a bounded sample of labelled rows on the driver and broadcast (its size is fixed). Scoring is a
pass over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK = 256
STEP = 1 << 13  # bytes whose responses are computed together
PAD = 255  # a byte that UTF-8 never has
#: The bound of the sample: labelled rows of each class, and the longest text among them in bytes.
SAMPLE_ROWS, SAMPLE_TEXT = 1500, 65536
THRESHOLD = 0.3


class Network:
    def __init__(self, width: int = 5, filters: int = 16, hidden: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        self.width = width
        self.p = {
            "table": r.normal(0, 0.3, (width, 256, filters)).astype(np.float32),  # a filter's weight for each byte at each place
            "bias": np.zeros(filters, np.float32),
            "w2": r.normal(0, 0.3, (filters + 2, hidden)).astype(np.float32),  # the last two read how full the chunk is
            "b2": np.full(hidden, 0.1, np.float32),
            "w3": r.normal(0, 0.3, hidden).astype(np.float32),
            "b3": np.zeros(1, np.float32),
        }
        self.p["table"][:, PAD] = 0

    @classmethod
    def of(cls, parts: dict[str, np.ndarray]) -> Network:
        """The network with these arrays; what is broadcast is the arrays, as executors know no class of this package."""
        out = cls(len(parts["table"]))
        out.p = parts
        return out

    def layout(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts, each padded to whole blocks (one at least), and the number of blocks of each."""
        blocks = np.maximum(1, -(-(ends - starts) // BLOCK))
        first = common.row_starts(blocks * BLOCK)
        size = ends - starts
        out = np.full(first[-1] + self.width, PAD, np.uint8)
        within = np.arange(size.sum()) - np.repeat(common.row_starts(size)[:-1], size)
        out[within + np.repeat(first[:-1], size)] = data[within + np.repeat(starts, size)]
        return out, blocks

    def responses(self, x: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Filter responses at every place but the padding: blocks x BLOCK x filters. No filter reads beyond its text's stop."""
        n, table = len(x) - self.width, self.p["table"]
        a, wide = np.empty((n, table.shape[2]), np.float32), x.astype(np.intp)
        more = np.empty((min(n, STEP), table.shape[2]), np.float32)
        for at in range(0, n, STEP):  # parts that stay in a cache
            own = a[at : at + STEP]
            np.take(table[0], wide[at : at + len(own)], axis=0, mode="clip", out=own)
            for j in range(1, self.width):
                np.take(table[j], wide[at + j : at + j + len(own)], axis=0, mode="clip", out=more[: len(own)])
                own += more[: len(own)]
        for left in range(1, self.width):
            at = stops - left
            a[at] = table[0][x[at]]
            for j in range(1, left):
                a[at] += table[j][x[at + j]]
        a[x[:n] == PAD] = -1e4
        return a.reshape(-1, BLOCK, a.shape[1])

    def head(self, top: np.ndarray, blocks: np.ndarray, size: np.ndarray) -> tuple:
        """From each block's largest responses to each text's logit, with what the gradient needs."""
        begins = common.row_starts(blocks)
        last = np.zeros(len(top), bool)
        last[begins[1:] - 1] = True
        second = np.where(last, np.arange(len(top)), np.arange(1, len(top) + 1))  # a chunk is a block and the next of its text
        use = ~last | np.repeat(blocks == 1, blocks)
        one, two = np.flatnonzero(use), second[use]
        m = np.maximum(np.maximum(top[one], top[two]) + self.p["bias"], 0)
        full = np.minimum(size[np.repeat(np.arange(len(blocks)), np.maximum(1, blocks - 1))], 2 * BLOCK)[:, None] / (2 * BLOCK)
        m = np.hstack([m, full, np.sqrt(full)]).astype(np.float32)
        h = np.maximum(m @ self.p["w2"] + self.p["b2"], 0)
        chunks = np.maximum(1, blocks - 1)
        first = common.row_starts(chunks)
        v = np.maximum.reduceat(h, first[:-1], axis=0)
        return v @ self.p["w3"] + self.p["b3"][0], v, h, m, one, two, first

    def score(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, part: int = 1 << 18) -> np.ndarray:
        """Probability of label 1 of each text. Filters and layout take about `part` bytes at a time, or one text's; a text longer
        than that is laid out in pieces of whole blocks, each with the bytes that the last filters of a piece reach into."""
        tops, size = [], ends - starts
        i = 0
        while i < len(size):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + part, "right")))
            for at in range(0, max(1, int(size[i])), part) if j == i + 1 else (0,):
                last = j > i + 1 or at + part >= size[i]
                a, b = starts[i:j] + at, ends[i:j] if last else starts[i:j] + at + part
                x, blocks = self.layout(data, a, b if last else np.minimum(ends[i:j], b + self.width))
                if not last:  # the bytes behind the piece only serve the filters that begin in it
                    x = x[: part + self.width]
                tops.append(self.responses(x, common.row_starts(blocks)[1:] * BLOCK if last else np.zeros(0, np.int64)).max(axis=1))
            i = j
        z = self.head(np.concatenate(tops), np.maximum(1, -(-size // BLOCK)), size)[0] if tops else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
        r, (moment, square) = np.random.default_rng(seed), ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        share = np.clip(np.bincount(labels, minlength=2) / max(1, len(labels)), 1e-6, None)
        weight = 0.5 / share[labels]
        step = 0
        for epoch in range(epochs):
            order = r.permutation(len(texts))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                size = np.array([len(texts[i]) for i in some], np.int64)
                ends = np.cumsum(size)
                g = self.gradient(np.frombuffer(b"".join(texts[i] for i in some), np.uint8), ends - size, ends, labels[some], weight[some])
                step += 1
                now = rate * (1 - epoch / epochs)
                for k, v in self.p.items():
                    moment[k] += 0.1 * (g[k] - moment[k])
                    square[k] += 0.01 * (g[k] ** 2 - square[k])
                    v -= now * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6) + now * 1e-3 * v
                self.p["table"][:, PAD] = 0
        return self

    def gradient(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        x, blocks = self.layout(data, starts, ends)
        stops = common.row_starts(blocks)[1:] * BLOCK
        a = self.responses(x, stops)
        place = a.argmax(axis=1)
        top = np.take_along_axis(a, place[:, None], axis=1)[:, 0]
        z, v, h, m, one, two, first = self.head(top, blocks, ends - starts)
        d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / len(y)).astype(np.float32)
        g = {"w3": v.T @ d, "b3": np.array([d.sum()], np.float32)}
        dv = d[:, None] * self.p["w3"]
        owner = np.repeat(np.arange(len(blocks)), np.diff(first))
        # the gradient of a largest value goes to the first place that has it
        hit = h == v[owner]
        seen = np.cumsum(hit, axis=0)
        before = np.vstack([np.zeros((1, h.shape[1]), seen.dtype), seen])[first[:-1]]
        hit &= (seen - before[owner]) == 1
        dh = np.where(hit & (h > 0), dv[owner], 0).astype(np.float32)
        g["w2"], g["b2"] = m.T @ dh, dh.sum(axis=0)
        dm = np.where(m > 0, dh @ self.p["w2"].T, 0)[:, :-2]
        g["bias"] = dm.sum(axis=0)
        winner = np.where(top[one] >= top[two], one[:, None], two[:, None])
        f = np.broadcast_to(np.arange(dm.shape[1]), dm.shape)
        some = dm != 0
        block, f, dm = winner[some], f[some], dm[some]
        at = block * BLOCK + place[block, f]
        g["table"] = np.zeros_like(self.p["table"])
        stop = np.repeat(stops, blocks)[block]
        for j in range(self.width):
            inside = at + j < stop
            np.add.at(g["table"][j], (x[(at + j)[inside]], f[inside]), dm[inside])
        return g


def sample(docs: DataFrame, labels: DataFrame, folds: int, rows: int) -> tuple[list[bytes], np.ndarray]:
    """Up to `rows` labelled training texts of each class, the same at every run: those whose id has the smallest hash."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~common.held_out("doc_id", folds))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = None
    for q in (0, 1):
        one = known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        ids = one if ids is None else ids.unionByName(one)
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_TEXT))
    found = texts.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "text").limit(2 * rows).toArrow()
    return [t.encode() for t in found.column("text").to_pylist()], np.array(found.column("quality").to_pylist(), np.int64)


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, rows: int = SAMPLE_ROWS) -> Network:
    """A network fitted on rows whose crc32(doc_id as text) mod folds isn't 0. Without such rows: an unfitted one."""
    texts, y = sample(docs, labels, folds, rows)
    return Network().fit(texts, y) if len(y) else Network()


def score(docs: DataFrame, network: Network, name: str = "score") -> DataFrame:
    """docs with a last column `name`: the probability of label 1.

    Null and empty texts are scored as the text without bytes; long texts are read whole. Repeated rows stay, an empty
    table gives an empty one, a column of that name is replaced and any others stay.
    """
    kept = [c for c in docs.columns if c != name]
    shared = docs.sparkSession.sparkContext.broadcast(network.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network.of(shared.value)
        for part, _ in common.text_slices(batches):
            data, begins = common.text_bytes(part.column("text"))
            found = own.score(data, begins[:-1], begins[1:] - 1)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(found, pa.float64())], names=[*kept, name])

    return docs.select(*kept).mapInArrow(run, ", ".join([common.fields(docs, kept), f"{name} double"]))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    found = score(docs.select("doc_id", "text"), train(docs, labels))
    return found.select("doc_id", common.held_out("doc_id", 5).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, in their own columns, whatever these are called.

    Null and empty texts are judged as the text without bytes; repeated rows stay or go together; an empty table gives an empty one.
    """
    name = common.fresh(docs.columns, "quality_score")
    return score(docs, train(docs, labels), name).filter(F.col(name) >= THRESHOLD).select(*docs.columns)
