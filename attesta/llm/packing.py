"""Packing by concatenate and cut: all documents' ids form one line, cut into windows of fixed length.

1. Each task encodes its documents and writes their ids once to a table in the shared folder, with the number of the part
   and the ids that stand before the document in that part.
2. Totals by part, one row a part, get their prefix sums: the base of each part in the line.
3. A document's place in the line is its base plus its place in its part; windows cut it into pieces (boundary records).

Texts are never shuffled and no part waits for another.  Only the last window can be short.  Defined results: a null or
empty text is one piece, the end id; rows with equal doc_id are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.llm.common import documents, texts
from attesta.llm.tokens import encoded, encoder, tokenizer_path
from attesta.scratch import written

#: Ids in a sequence, and the id after each document.
LENGTH, END_ID = 2048, 1


def token_table(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(part, doc_id, before, ids) of every row, written; ids as little-endian words of the encoder's width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            for s, ids, first in encoded(batch, path, end_id):
                width = ids.dtype.itemsize
                column = pa.Array.from_buffers(pa.binary(), s.rows, [None, pa.py_buffer((first * width).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(s.rows, part, np.int32)), batch.column("doc_id").slice(s.start, s.rows), pa.array(first[:-1] + done), column], ["part", "doc_id", "before", "ids"]
                )
                done += int(first[-1])

    return written(texts(docs).mapInArrow(run, "part int, doc_id long, before long, ids binary"), "tokens")


def pieces(docs: DataFrame, path: str | None = None, *, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): one row per piece."""
    path = path or tokenizer_path()
    table = token_table(docs, path, end_id)
    width = encoder(path).dtype.itemsize
    kind = encoder(path).dtype.str
    ends = table.groupBy("part").agg(F.max(F.col("before") + F.octet_length("ids") / width).cast("long").alias("total"))
    bases = ends.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("ids")
            begin = np.asarray(batch.column("place"), np.int64)
            at = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64) // width
            ids = np.frombuffer(raw.buffers()[2], np.dtype(kind)).astype("<u4") if len(raw) else np.zeros(0, "<u4")
            size = np.diff(at)
            n = (begin + size - 1) // length - begin // length + 1
            row = np.repeat(np.arange(len(size)), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            sequence = begin[row] // length + k
            left = np.maximum(sequence * length, begin[row])
            right = np.minimum((sequence + 1) * length, (begin + size)[row])
            start = left - begin[row]
            bounds = np.stack([at[:-1][row] + start, at[:-1][row] + right - begin[row]], 1)
            crc = np.fromiter((zlib.crc32(ids[a:b]) for a, b in bounds.tolist()), np.int64, len(row))
            columns = [batch.column("doc_id").take(pa.array(row)), *map(pa.array, (start, right - left, crc, size[row], sequence, left - sequence * length))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([ids[a:b].tolist() for a, b in bounds.tolist()], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    placed = table.join(F.broadcast(bases), "part")  # one row a part
    return placed.select("doc_id", (F.col("base") + F.col("before")).alias("place"), "ids").mapInArrow(run, schema)


def sequences(docs: DataFrame, path: str | None = None, *, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(sequence_id, ids, boundaries): whole sequences with where each document's piece stands in them."""
    parts = pieces(docs, path, length=length, end_id=end_id, with_ids=True)
    packed = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids"))).alias("p"))  # at most ``length`` ids
    return packed.select(
        "sequence_id",
        F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"),
        F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["offset"].alias("offset"), x["length"].alias("length"), x["start"].alias("start"))).alias("boundaries"),
    )


def op8_concat_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all documents, packed into sequences of 2048 ids."""
    return pieces(documents(spark, sf_dir))
