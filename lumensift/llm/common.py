"""What the operators of this folder share: shared storage, slices of Arrow batches, word hashing.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, except where runs of ASCII letters, digits and all other
characters than ASCII are asked for (MARK stands between them).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumensift.storage import shared_dir, written  # noqa: F401

SLICE_BYTES = 2 << 20
M64 = np.uint64(0xFFFFFFFFFFFFFFFF)
BASE = 0x9E3779B97F4A7C15  # odd, so that its powers never vanish modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)


def bucketed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """The same, dealt into as many buckets by its keys as shuffles have partitions: joins on the keys don't move it again.

    df should be dealt by the keys already, as after a join on them, so that no bucket is written by many tasks.
    """
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/{table}").format("parquet")
    writer.bucketBy(number, *keys).sortBy(*keys).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # its name only: the files have a place of their own, and out knows it
    return out


def held_out(doc_id: str, folds: int):
    """True for the rows whose crc32(doc_id as text) leaves no remainder; a null id is held out too."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(True))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches cut so that `column` holds about `limit` bytes in each, with every row's byte length."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < len(size):
            until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, until - at), size[at:until]
            at = until


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in one array, a newline after each text, and the place where each text starts (one more than texts)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    starts = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=starts[1:])
    if not len(column):
        return np.zeros(0, np.uint8), starts
    joined = pc.binary_join_element_wise(column, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    if isinstance(joined, pa.ChunkedArray):
        joined = joined.combine_chunks()
    offsets = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1, joined.offset * 8)
    return np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], starts


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII bytes that are neither letters nor digits: what stands between words is one of these where only letters and digits count.
MARK = np.zeros(256, bool)
MARK[:128] = [not chr(b).isalnum() for b in range(128)]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(n: int, base: int = BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_spans(data: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in bytes that end in one of those that stand between words (white space)."""
    blank = between[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(data) and not blank[0]:
        edge = np.append(0, edge)
    return edge[::2], edge[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, part: int = 1 << 16) -> np.ndarray:
    """A 64-bit hash of each span of bytes. Spans don't overlap, and come in order; they are taken in parts that fit in a cache."""
    out = np.empty(len(starts), np.uint64)
    power = back = np.zeros(0, np.uint64)
    at = 0
    while at < len(starts):
        until = max(at + 1, int(np.searchsorted(starts, starts[at] + part)))
        first, n = starts[at], int(ends[until - 1] - starts[at])
        if n > len(power):
            power, back = powers(n + part), powers(n + part, INVERSE)
        value = data[first : first + n].astype(np.uint64)
        value += np.uint64(1)
        value *= power[:n]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(value, out=sums[1:])
        begin, end = starts[at:until] - first, ends[at:until] - first
        # the same bytes have the same hash wherever they stand: sums are divided by the power of their first place
        own = (sums[end] - sums[begin]) * back[begin]
        out[at:until] = mixed(own + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = until
    return out


def words_of(column: pa.Array, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends, word hashes, words in each text)."""
    data, begins = text_bytes(column)
    data = LOWER[data]
    starts, ends = word_spans(data, between)
    hashes = span_hashes(data, starts, ends)
    counts = np.diff(np.searchsorted(starts, begins))
    return data, starts, ends, hashes, counts


def shingle_hashes(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, text after text, and how many each text has.

    A text with 1 to k-1 words has one shingle, the whole sequence; one without words has none.
    """
    counts = counts.astype(np.int64)
    begins = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=begins[1:])
    many = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    if not len(hashes):
        return np.zeros(0, np.uint64), many
    rolled = np.zeros(len(hashes), np.uint64)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    factor = powers(k + 1)[1:]
    for j in range(k):
        rolled += padded[j : j + len(hashes)] * factor[j]
    keep = np.zeros(len(hashes), bool)
    first = np.repeat(begins[:-1], counts)
    place = np.arange(len(hashes)) - first
    keep[place < np.repeat(many, counts)] = True
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        own = hashes[begins[i] : begins[i + 1]]
        rolled[begins[i]] = (own * factor[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mixed(rolled[keep]), many


def row_starts(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... as often as many[0] says, then the same from first[1] on, and so forth."""
    at = row_starts(many)
    return np.arange(at[-1]) + np.repeat(first - at[:-1], many)


def binary(values: list[bytes] | np.ndarray) -> pa.Array:
    return pa.array(list(values), pa.binary())


def pack(x: np.ndarray) -> bytes:
    """Numbers as bytes, first all lowest bytes and so on: sorted or small numbers then compress well on their way."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unpacked(value: pa.Scalar, kind: str) -> np.ndarray:
    parts = np.frombuffer(value.as_buffer(), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(parts.T).view(kind).ravel()


def fresh(taken: list[str], name: str) -> str:
    """A column name like `name` that isn't taken; Spark's names don't tell capitals from small letters."""
    taken = {t.lower() for t in taken}
    while name in taken:
        name += "_"
    return name


def fields(df: DataFrame, names: list[str]) -> str:
    """The schema of some columns, as text."""
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)
