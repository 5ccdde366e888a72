"""What the corpus operators share: importable workers, batches cut to a bounded size, words and hashes.

Texts arrive as Arrow batches.  ``slices`` cuts them so that one slice holds about ``SLICE_BYTES`` of text (a longer
text is a slice of its own), which bounds the memory of the vectorised kernels whatever the batch holds.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch of rows that goes to a worker, about.
BATCH_BYTES = 8 << 20
#: UTF-8 bytes of text that a kernel takes at once: its arrays of words then stay near a processor's cache.
SLICE_BYTES = 256 << 10

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_OTHER_BASE = 0xC2B2AE3D27D4EB4F


def apart(column: str) -> Column:
    """The column under its name, as an expression that Spark doesn't know to be dealt out already.

    A join whose one side is a grouped table reuses that table's partitioning, and adaptive execution can then not split a hot
    key.  With this on the grouped side both sides are dealt anew (it is the smaller one), and it can."""
    return F.when(F.col(column).isNotNull(), F.col(column)).alias(column)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def importable(spark: SparkSession) -> None:
    """Lets Python workers that start from now on import this package from where the driver has it, and holds the session's Arrow
    batches to ``BATCH_BYTES``: a batch stands in the memory of the JVM and of the worker at once, beside each other."""
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
    if not 0 < most <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only (doc_id, text, *more), so that other columns of any name do no harm; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


# ---- batches -------------------------------------------------------------------------------------------------------


class Slice(NamedTuple):
    """Rows start..stop of a batch; ``data`` holds their UTF-8 bytes, document i at ``at[i]:at[i + 1]``."""

    start: int
    stop: int
    at: np.ndarray
    data: np.ndarray

    @property
    def rows(self) -> int:
        return self.stop - self.start


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column, a null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return at * 0, np.zeros(0, np.uint8)
    return at, np.frombuffer(data, np.uint8)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    at, data = string_buffers(column)
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield Slice(i, j, at[i : j + 1] - at[i], data[at[i] : at[j]])
        i = j


# ---- hashes --------------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, made longer when needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * U64(pow(self.base, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U64(pow(self.inverse, m, 1 << 64))])
        return self.up[:n], self.down[:n]


_POWERS, _OTHER_POWERS = _Powers(_BASE), _Powers(_OTHER_BASE)


class SpanHash:
    """64-bit hashes of any spans of a byte array, from one pass of prefix sums of a polynomial modulo 2**64; ``other`` takes
    another polynomial, for 128 bits together."""

    def __init__(self, data: np.ndarray, other: bool = False) -> None:
        n = len(data)
        up, self.down = (_OTHER_POWERS if other else _POWERS).upto(n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


#: Bits of the first n bytes of a word.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as rows; zeros after the end."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)


def _read(rows: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """A word of the bytes at each place, of which ``left`` count."""
    return rows[at].view("<u8").ravel().astype(U64, copy=False) & _FIRST[np.minimum(left, 8)]


def same_spans(a: np.ndarray, start: np.ndarray, end: np.ndarray, b: np.ndarray, other: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Whether each span of ``a`` has the bytes of the span of ``b`` beside it."""
    out = end - start == other_end - other
    rows, others, open_, done = eights(a), eights(b), np.flatnonzero(out), 0
    while len(open_):
        left = end[open_] - start[open_] - done
        equal = _read(rows, start[open_] + done, left) == _read(others, other[open_] + done, left)
        out[open_[~equal]] = False
        done += 8
        open_ = open_[equal & (left > 8)]
    return out


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of a byte array.  A span's blocks of eight bytes are mixed, each with its place in the span, before they
    are summed up: unlike a polynomial of the bytes, no texts are known whose hashes agree by their form.  Spans of up to eight
    bytes and of one length never agree."""
    size = end - start
    blocks = (size + 7) >> 3
    sums = np.concatenate([[0], np.cumsum(blocks)])
    span = np.repeat(np.arange(len(size)), blocks)
    block = np.arange(sums[-1]) - sums[span]
    values = mix(mix(_read(eights(data), start[span] + 8 * block, size[span] - 8 * block)) + block.astype(U64) * U64(_OTHER_BASE))
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values, out=total[1:])
    return mix(total[sums[1:]] - total[sums[:-1]] + size.astype(U64) * U64(_BASE))


#: The separators of words: the space and the control characters from tab to carriage return.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class Words(NamedTuple):
    """Words of a slice: bytes start:end, and the row (from 0 in the slice) that each is in; rows' words at first[row]."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray


def words(s: Slice, separator: np.ndarray = SEPARATOR) -> Words:
    n = len(s.data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~separator[s.data]
    # A document's end ends a word, though no separator stands there.
    edge = np.zeros(n + 1, bool)
    edge[s.at] = True
    begins = inside[1:] & (~inside[:-1] | edge)
    ends = inside[:-1] & (~inside[1:] | edge)
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    first = np.searchsorted(start, s.at)
    row = np.repeat(np.arange(s.rows), np.diff(first))
    return Words(start, end, row, first)


def windows(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of first word, hash) of each run of n words in one row."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    k = len(hashes) - n + 1
    total = np.zeros(k, U64)
    for i in range(n):
        total = total * U64(_BASE) + hashes[i : i + k]
    at = np.flatnonzero(row[:k] == row[n - 1 :])
    return at, mix(total[at])


def counted(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set in each at[i]:at[i + 1]."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]
