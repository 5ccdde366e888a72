"""Token files with keyed access: raw ids in shards, and a minimal perfect hash from document keys to places in them.

Layout of a folder (all integers little-endian):

* ``shard-NNNNN.bin``: 16 bytes of head (magic, width of an id in bytes, reserved), then raw ids, documents in the order of
  doc_id.  A shard holds about ``SHARD_BYTES`` of text (or one longer document).
* ``shard-NNNNN.docs``: number of documents n, then n doc_ids, n flags (1: doc_id is null) and n + 1 places of their first ids.
* ``index-NNNNN.mph``: the index of the keys whose hash falls into part NNNNN; the part after the last one is the null key's.

An index part is built in levels: a level has twice as many bits as keys that are left, a key that is alone at its bit is
settled there, the others go on.  A key's slot is the number of set bits before its own, which stands beside each word of a
level, so slots are minimal; a slot holds a 32-bit fingerprint, the shard, the row in it and how many rows follow with the same
key.  A look-up reads 16 bytes a level (two levels on the average) and one slot, compares, and reads the document's places and
its span of ids, whatever the sizes of the files; a key that was never stored fails the comparison, but for one in 2**32.  Where
a good share of a part or a shard is asked for at once, its tables are read whole, and ids in runs of ``READ_BYTES``.

Files are written under a temporary name and moved, so a task that runs twice leaves the same file.  Defined results: a
null or empty text is the end id alone; a null doc_id is a key of its own, which sorts first; rows with equal doc_id stand
side by side (in the order of their texts) and are all returned; an empty table gives empty manifests and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import U64, documents, mix, partitions, texts
from attesta.llm.tokens import encoded, tokenizer_path
from attesta.scratch import shared_path, written

END_ID = 0
MAGIC = b"ATTESTA1"
#: Keys in an index part, and bytes of text in a shard, about.
PART_KEYS, SHARD_BYTES = 200_000, 64 << 20
#: Bytes of ids that are read at once.
READ_BYTES = 4 << 20
#: Tables of which less than one row in so many is asked for are read row by row.
SPARSE = 256


# ---- files ---------------------------------------------------------------------------------------------------------


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class _Out:
    """A file that appears under its name only when it is whole."""

    def __init__(self, uri: str) -> None:
        self.system, self.path = _place(uri)
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        self.stream = self.system.open_output_stream(self.own)

    def __enter__(self):
        return self.stream

    def __exit__(self, kind, *_):
        self.stream.close()
        if kind is None:
            self.system.move(self.own, self.path)
        else:
            self.system.delete_file(self.own)


class _In:
    """A file read in parts."""

    def __init__(self, uri: str) -> None:
        system, path = _place(uri)
        self.file = system.open_input_file(path)

    def __enter__(self) -> _In:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def array(self, kind: str | np.dtype, n: int, at: int) -> np.ndarray:
        kind = np.dtype(kind)
        return np.frombuffer(self.file.read_at(n * kind.itemsize, at), kind, n)

    def rows(self, kind: str | np.dtype, n: int, at: int, row: np.ndarray) -> np.ndarray:
        """Some rows (ascending) of a table of n: one by one where they are few."""
        if SPARSE * len(row) >= n:
            return self.array(kind, n, at)[row]
        size = np.dtype(kind).itemsize
        return np.concatenate([np.zeros(0, kind), *(self.array(kind, 1, at + size * i) for i in row.tolist())])


def _keys(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    """The key of each doc_id; that of null (0) is told apart by its part."""
    return np.where(null, U64(0), mix(ids.astype(U64)))


# ---- minimal perfect hash ------------------------------------------------------------------------------------------


#: A word of a level, and the number of bits set before it.
_WORD = np.dtype([("bits", "<u8"), ("before", "<u8")])


class PerfectHash:
    """Slots 0..n - 1 for n distinct 64-bit keys; ``read(level, words)`` gives some words (ascending) of a level."""

    def __init__(self, sizes: list[int], read) -> None:
        self.sizes, self.read = sizes, read

    @staticmethod
    def _bit(keys: np.ndarray, level: int, words: int) -> np.ndarray:
        return (mix(keys ^ U64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % U64(64 * words)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> list[np.ndarray]:
        """The levels' words."""
        levels: list[np.ndarray] = []
        total = 0
        while len(keys):
            n = max(1, -(-2 * len(keys) // 64))
            bit = cls._bit(keys, len(levels), n)
            alone = np.bincount(bit, minlength=64 * n) == 1
            words = np.zeros(n, _WORD)
            words["bits"] = np.packbits(alone, bitorder="little").view("<u8")
            counts = np.bitwise_count(words["bits"]).astype(np.int64)
            words["before"] = total + np.cumsum(counts) - counts
            total += int(counts.sum())
            levels.append(words)
            keys = keys[~alone[bit]]
        return levels

    @classmethod
    def of(cls, levels: list[np.ndarray]) -> PerfectHash:
        return cls([len(x) for x in levels], lambda level, at: levels[level][at])

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """-1 for a key that no level settles (it wasn't stored)."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            bit = self._bit(keys[left], level, size)
            at, back = np.unique(bit >> 6, return_inverse=True)
            words = self.read(level, at)
            word, shift = words["bits"][back].astype(U64), (bit & 63).astype(U64)
            hit = (word >> shift) & U64(1) == 1
            below = np.bitwise_count(word & ((U64(1) << shift) - U64(1))).astype(np.int64)
            out[left[hit]] = words["before"][back[hit]].astype(np.int64) + below[hit]
            left = left[~hit]
        return out


_SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("row", "<u8"), ("copies", "<u4")])


def _index_bytes(keys: np.ndarray, shard: np.ndarray, row: np.ndarray, copies: np.ndarray) -> bytes:
    levels = PerfectHash.build(keys)
    slots = np.zeros(len(keys), _SLOT)
    at = PerfectHash.of(levels).slots(keys)
    slots["print"][at] = (keys >> U64(32)).astype(np.uint32)
    slots["shard"][at], slots["row"][at], slots["copies"][at] = shard, row, copies
    head = struct.pack(f"<8sII{len(levels)}Q", MAGIC, len(levels), len(keys), *(len(x) for x in levels))
    return head + b"".join(x.tobytes() for x in levels) + slots.tobytes()


def _held(uri: str, keys: np.ndarray) -> np.ndarray:
    """The slots of those of ``keys`` (distinct) that an index part holds."""
    with _In(uri) as f:
        n, size = f.array("<u4", 2, 8).tolist()
        sizes = f.array("<u8", n, 16).astype(np.int64)
        first = 16 + 8 * n + _WORD.itemsize * (np.cumsum(sizes) - sizes)
        at = PerfectHash(sizes.tolist(), lambda level, words: f.rows(_WORD, int(sizes[level]), int(first[level]), words)).slots(keys)
        keys, at = keys[at >= 0], at[at >= 0]
        rows, back = np.unique(at, return_inverse=True)
        held = f.rows(_SLOT, size, 16 + 8 * n + _WORD.itemsize * int(sizes.sum()), rows)[back]
    return held[held["print"] == (keys >> U64(32)).astype(np.uint32)]


def _spans(f: _In, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, whether it is null, first id, end) of some rows (ascending) of a shard's table of documents."""
    n = int(f.array("<u8", 1, 0)[0])
    places = 8 + 9 * n
    return f.rows("<i8", n, 8, row), f.rows("<u1", n, 8 + 8 * n, row).astype(bool), f.rows("<i8", n + 1, places, row), f.rows("<i8", n + 1, places, row + 1)


def _payloads(f: _In, width: int, first: np.ndarray, end: np.ndarray) -> Iterator[np.ndarray]:
    """The ids at each first..end (ascending), neighbours read together."""
    i = 0
    while i < len(first):
        j = i + 1
        while j < len(first) and first[j] <= end[j - 1] and (end[j] - first[i]) * width <= READ_BYTES:
            j += 1
        ids = f.array(f"<u{width}", int(end[j - 1] - first[i]), 16 + width * int(first[i]))
        yield from (ids[a:b] for a, b in zip((first[i:j] - first[i]).tolist(), (end[i:j] - first[i]).tolist(), strict=True))
        i = j


# ---- operators -----------------------------------------------------------------------------------------------------


def write_shards(docs: DataFrame, folder: str, path: str | None = None, *, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Writes the shards; (shard, n_docs, n_ids) of each that isn't empty, as a written table.  One shuffle, by ranges of doc_id."""
    spark = docs.sparkSession
    path = path or tokenizer_path()
    if shards is None:
        size = texts(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(partitions(spark), -(-size // SHARD_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        first = next(batches := iter(batches), None)
        if first is None:
            return
        ids_of, null_of, counts = [], [], []
        with _Out(f"{folder}/shard-{shard:05d}.bin") as out:
            width = None
            for batch in (b for group in ((first,), batches) for b in group):
                for s, ids, start in encoded(batch, path, end_id):
                    if width is None:
                        width = ids.dtype.itemsize
                        out.write(struct.pack("<8sII", MAGIC, width, 0))
                    out.write(ids.tobytes())
                    column = batch.column("doc_id").slice(s.start, s.rows)
                    ids_of.append(np.asarray(column.fill_null(0), "<i8"))
                    null_of.append(np.asarray(column.is_null()))
                    counts.append(np.diff(start))
        count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        with _Out(f"{folder}/shard-{shard:05d}.docs") as out:
            out.write(struct.pack("<Q", len(count)))
            for column, kind in ((np.concatenate(ids_of), "<i8"), (np.concatenate(null_of), "<u1"), (np.concatenate([[0], np.cumsum(count)]), "<i8")):
                out.write(column.astype(kind).tobytes())
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": pa.array([len(count)], pa.int64()), "n_ids": pa.array([int(count.sum())], pa.int64())})

    ordered = texts(docs).repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(run, "shard int, n_docs long, n_ids long"), "shards")


def _part(keys: np.ndarray, null: np.ndarray, parts: int) -> np.ndarray:
    return np.where(null, parts, (keys & U64(0xFFFFFFFF)) % U64(parts)).astype(np.int32)


def write_index(manifest: DataFrame, folder: str, parts: int) -> DataFrame:
    """Writes the index parts from the shards' tables of documents; (part, n_keys) of each, as a written table."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("shard").to_pylist():
                with _In(f"{folder}/shard-{shard:05d}.docs") as f:
                    n = int(f.array("<u8", 1, 0)[0])
                    ids, null = f.array("<i8", n, 8), f.array("<u1", n, 8 + 8 * n).astype(bool)
                new = np.ones(len(ids), bool)
                new[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
                row = np.flatnonzero(new)
                key = _keys(ids[row], null[row])
                columns = {"part": _part(key, null[row], parts), "key": key.view(np.int64), "shard": np.full(len(row), shard, np.int32), "row": row.astype(np.int64), "copies": np.diff(np.append(row, len(ids))).astype(np.int64)}
                yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})

    def build(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        part = group.column("part")[0].as_py()
        key = np.asarray(group.column("key"), np.int64).view(U64)
        with _Out(f"{folder}/index-{part:05d}.mph") as out:
            out.write(_index_bytes(key, *(np.asarray(group.column(c), np.int64) for c in ("shard", "row", "copies"))))
        return pa.table({"part": pa.array([part], pa.int32()), "n_keys": pa.array([len(key)], pa.int64())})

    found = manifest.select("shard").repartition(partitions(manifest.sparkSession), "shard").mapInArrow(keys, "part int, key long, shard int, row long, copies long")
    return written(found.groupBy("part").applyInArrow(build, "part int, n_keys long"), "index")


def look_up(keys: DataFrame, folder: str, parts: int, there: frozenset[int]) -> DataFrame:
    """(shard, row, copies) of each distinct doc_id of ``keys`` that the index holds; ``there``: the parts that have keys."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("doc_id")
            null = np.asarray(column.is_null())
            key = _keys(np.asarray(column.fill_null(0), np.int64), null)
            both = np.unique(np.stack([_part(key, null, parts).astype(U64), key], 1), axis=0)
            yield pa.RecordBatch.from_pydict({"part": pa.array(both[:, 0].astype(np.int32)), "key": pa.array(np.ascontiguousarray(both[:, 1]).view(np.int64))})

    def probe(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        key = np.unique(np.asarray(group.column("key"), np.int64)).view(U64)
        part_ = group.column("part")[0].as_py()
        held = _held(f"{folder}/index-{part_:05d}.mph", key) if part_ in there else np.zeros(0, _SLOT)
        return pa.table({"shard": pa.array(held["shard"].astype(np.int32)), "row": pa.array(held["row"].astype(np.int64)), "copies": pa.array(held["copies"].astype(np.int64))})

    small = keys.select(F.col("doc_id").cast("long").alias("doc_id"))
    return small.mapInArrow(part, "part int, key long").groupBy("part").applyInArrow(probe, "shard int, row long, copies long")


def read_back(places: DataFrame, folder: str, bases: dict[int, int], *, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) from the raw ids at ``places``; ``bases`` holds a number for each shard."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        shard = group.column("shard")[0].as_py()
        row, copies = (np.asarray(group.column(c), np.int64) for c in ("row", "copies"))
        row = np.sort(np.repeat(row, copies) + np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies))
        with _In(f"{folder}/shard-{shard:05d}.docs") as f:
            ids, null, start, end = _spans(f, row)
        lists, sums = [], []
        with _In(f"{folder}/shard-{shard:05d}.bin") as f:
            for x in _payloads(f, int(f.array("<u4", 1, 8)[0]), start, end):
                sums.append(zlib.crc32(x.astype("<u4")))
                if with_ids:
                    lists.append(x.tolist())
        out = {
            "doc_id": pa.array(ids, mask=null),
            "start": pa.array(start + bases[shard]),
            "n_tokens": pa.array(end - start),
            "ids_crc32": pa.array(sums, pa.int64()),
        }
        if with_ids:
            out["ids"] = pa.array(lists, pa.list_(pa.int64()))
        return pa.table(out)

    return places.groupBy("shard").applyInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


class TokenFiles:
    """A written folder: ``TokenFiles.write(docs)`` makes one, ``get(keys)`` reads documents by key."""

    def __init__(self, spark: SparkSession, folder: str, manifest: DataFrame, index: DataFrame, parts: int) -> None:
        self.folder, self.manifest, self.parts = folder, manifest, parts
        self.there = frozenset(r[0] for r in index.select("part").collect())  # one number a part
        rows = sorted(manifest.select("shard", "n_ids").collect())  # one row a shard
        self.bases, total = {}, 0
        for shard, n in rows:
            self.bases[shard], total = total, total + n

    @classmethod
    def write(cls, docs: DataFrame, folder: str | None = None, path: str | None = None, *, end_id: int = END_ID) -> TokenFiles:
        spark = docs.sparkSession
        folder = folder or shared_path(spark, "token-files")
        manifest = write_shards(docs, folder, path, end_id=end_id)
        total = manifest.agg(F.sum("n_docs")).first()[0] or 0
        parts = max(2 * partitions(spark), -(-total // PART_KEYS))
        return cls(spark, folder, manifest, write_index(manifest, folder, parts), parts)

    def get(self, keys: DataFrame, *, with_ids: bool = False) -> DataFrame:
        return read_back(look_up(keys, self.folder, self.parts, self.there), self.folder, self.bases, with_ids=with_ids)


def op10_perfect_hash_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids and reads each document back by its key."""
    docs = documents(spark, sf_dir)
    return TokenFiles.write(docs).get(docs)
