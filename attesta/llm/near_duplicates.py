"""Near-duplicate classes by ProbMinHash, banding and exact verification.

1. Each distinct shingle of ``WORDS`` words of a document is a Poisson process whose rate is its weight: its arrivals, from a
   generator seeded by the shingle, fall on random components, and a component keeps the shingle that arrives first.  A document
   stops when no further arrival can be first anywhere.  Two documents agree in a component with their probability Jaccard
   similarity; links are of sets, so all weights are 1, whatever the counts, and that is the Jaccard similarity of step 3.
2. ``BANDS`` bands of ``ROWS`` components.  Documents that share a band are tied to the least document of that bucket, so a
   bucket of n gives n - 1 ties, never all pairs; connected ties are a family.  A pair of similarity 0.8 misses all bands with
   a probability of about five in a million.
3. In a family documents are compared exactly, by products of incidence matrices in units of bounded size.  Of a large family
   each chunk meets a few hubs, and only what these don't join to the largest part meets the whole family.  Only a spanning
   set of links of at least ``SIMILARITY`` (Jaccard, over the sets of shingles) leaves a unit.
4. Connected links are the classes.

Only one document of each group of equal texts takes part in 1-3 beyond its signature.  Defined results: words are separated
by white space of ASCII; a text of fewer than five words is one shingle; a text without words is in a class with equal texts
only; a null text is empty; the class id is the least doc_id of the class; rows without doc_id get no class; a text
counts under the least doc_id that has it, and texts under one doc_id are one document, linked where any of them is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import U64, Slice, apart, documents, mix, partitions, slices, span_hashes, texts, windows, words
from attesta.llm.components import components
from attesta.scratch import written

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 6
#: A chunk of a large family: so many documents, or bytes of text.
CHUNK_DOCS, CHUNK_BYTES = 400, 8 << 20
#: Documents of a large family that every chunk of it meets.
HUBS = 8
#: Marks of a unit: a whole family, or a chunk of a large one with its hubs.
WHOLE, PART = -2, -1

_GOLDEN = U64(0x9E3779B97F4A7C15)


def shingles(s: Slice, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct shingles of each document of a slice, by row and hash."""
    w = words(s)
    hashes = span_hashes(s.data, w.start, w.end)
    at, h = windows(hashes, w.row, n)
    row = w.row[at]
    length = np.diff(w.first)
    short = np.flatnonzero((length > 0) & (length < n))
    if len(short):
        total = np.zeros(len(short), U64)
        for i in range(n - 1):
            has = length[short] > i
            total[has] = total[has] * _GOLDEN + hashes[w.first[short[has]] + i]
        row, h = np.concatenate([row, short]), np.concatenate([h, mix(total + U64(1))])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(h)))


def signatures(row: np.ndarray, keys: np.ndarray, weight: np.ndarray, rows: int, m: int) -> np.ndarray:
    """ProbMinHash: for each row and component the hash of the element that arrives first there (0 for a row without any)."""
    first = np.full(rows * m, np.inf)
    who = np.zeros(rows * m, np.uint32)
    worst = np.full(rows, np.inf)
    time, live, drawn = np.zeros(len(keys)), np.arange(len(keys)), 0
    while len(live):
        g = max(1, min(64, 8192 // len(live))) if drawn else 1
        steps = (np.arange(drawn + 1, drawn + g + 1).astype(U64)) * _GOLDEN
        r = mix(keys[live][:, None] + steps[None, :])
        u = ((r >> U64(24)).astype(float) + 0.5) * 2.0**-40
        t = time[live][:, None] + np.cumsum(-np.log(u), 1) / weight[live][:, None]
        time[live] = t[:, -1]
        drawn += g
        place = row[live][:, None] * m + ((r & U64(0xFFFFFF)) * U64(m) >> U64(24)).astype(np.int64)
        early = t < worst[row[live]][:, None]
        t_, p_ = t[early], place[early]
        e_ = np.broadcast_to((keys[live] >> U64(32)).astype(np.uint32)[:, None], t.shape)[early]
        np.minimum.at(first, p_, t_)
        won = first[p_] == t_
        who[p_[won]] = e_[won]
        touched = np.unique(row[live])
        worst[touched] = first.reshape(rows, m)[touched].max(1)
        live = live[time[live] < worst[row[live]]]
    return who.reshape(rows, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sig), bands), U64)
    for i in range(rows):
        out = out * _GOLDEN + sig[:, i::rows][:, :bands]
    return mix(out + np.arange(1, bands + 1, dtype=U64)[None, :] * U64(0xD6E8FEB86659FD93))


def sketched(docs: DataFrame, *, n: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, digest, n_bytes, bands) of every row that has a doc_id; a document without words has no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                row, h, _ = shingles(s, n)
                keys = band_keys(signatures(row, h, np.ones(len(h)), s.rows, bands * rows), bands, rows)
                has = np.bincount(row, minlength=s.rows) > 0
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)), pa.array(keys[has].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(s.start, s.rows) for c in ("doc_id", "digest")), pa.array(np.diff(s.at)), lists], ["doc_id", "digest", "n_bytes", "bands"])

    some = texts(docs).where("doc_id is not null").select("doc_id", "text", F.sha2("text", 256).alias("digest"))
    return some.mapInArrow(run, "doc_id long, digest string, n_bytes long, bands array<long>")


def linked(ids: np.ndarray, column: pa.Array, n: int, similarity: float) -> list[tuple[int, int]]:
    """Links (document, least document of its part) among the documents of one unit, by exact comparison of all pairs; ``ids``
    ascend, and equal ones are one document."""
    rows, keys, sizes = [], [], np.zeros(len(ids))
    for s in slices(column):
        row, h, _ = shingles(s, n)
        rows.append(row + s.start)
        keys.append(h)
        sizes[s.start : s.stop] = np.bincount(row, minlength=s.rows)
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    row, key = row[order], key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(key)))
    shared = np.repeat(size > 1, size)
    row, column_of = row[shared], np.repeat(np.cumsum(size > 1) - 1, size)[shared]
    common = np.zeros((len(ids), len(ids)), np.float32)
    width = max(1, min(4096, (16 << 20) // (4 * max(1, len(ids)))))
    at = np.searchsorted(column_of, np.arange(0, (column_of[-1] if len(column_of) else -1) + 1 + width, width))
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b > a:
            x = np.zeros((len(ids), width), np.float32)
            x[row[a:b], column_of[a:b] % width] = 1
            common += x @ x.T
    union = sizes[:, None] + sizes[None, :] - common
    # 1e-9: 4 / 5 of whole numbers must count as 0.8
    near = (common > 0) & (common >= (similarity - 1e-9) * union)
    near |= ids[:, None] == ids[None, :]
    label = np.arange(len(ids))  # ids ascend, so the least index is the least document
    while True:
        new = np.where(near, label[None, :], len(ids)).min(1)
        new = new[new]
        if (new == label).all():
            return sorted({(int(ids[i]), int(ids[j])) for i, j in enumerate(label.tolist()) if ids[i] != ids[j]})
        label = new


def _verified(units: DataFrame, n: int, similarity: float) -> DataFrame:
    """(a, b, whole) with a > b: links within each unit of ``units`` (unit columns f, i, j; doc_id; text), which is sorted by unit
    and doc_id; ``whole`` tells that the unit is its whole family (j is WHOLE)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(unit: tuple[int, int, int], parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            ids, text = np.asarray(t.column("doc_id"), np.int64), t.column("text").combine_chunks()
            text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
            code = np.asarray(text.dictionary_encode().indices, np.int64)
            order = np.lexsort((code, ids))
            keep = order[np.concatenate([[True], (ids[order][1:] != ids[order][:-1]) | (code[order][1:] != code[order][:-1])])]  # a hub can be in its own chunk
            found = linked(ids[keep], text.take(pa.array(keep)), n, similarity) if len(keep) > 1 else []
            return pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)), pa.array([unit[2] == WHOLE] * len(found), pa.bool_())], ["a", "b", "whole"])

        held: list[pa.RecordBatch] = []
        unit: tuple[int, int, int] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([np.asarray(batch.column(c)) for c in ("f", "i", "j")], 1)
            ends = [*(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            a = 0
            for b in ends:
                if unit is not None and tuple(key[a]) != unit:
                    yield solve(unit, held)
                    held = []
                unit = tuple(key[a])
                held.append(batch.slice(a, b - a))
                a = b
        if held:
            yield solve(unit, held)

    return units.select("f", "i", "j", "doc_id", "text").mapInArrow(run, "a long, b long, whole boolean")


def _units(parts: DataFrame, held: DataFrame) -> DataFrame:
    """``parts`` (f, i, j, doc_id) with texts, units whole in their tasks."""
    return parts.join(held.select("f", "doc_id", "text"), ["f", "doc_id"]).repartition(partitions(held.sparkSession), "f", "i", "j").sortWithinPartitions("f", "i", "j", "doc_id")


def _joined(held: DataFrame, n: int, similarity: float) -> DataFrame:
    """(vertex, root): the linked documents of each family of ``held`` (f, doc_id, n_bytes, weight, text), and the least of each part.

    A family of one chunk is a unit, and its parts are known there.  Of a larger one, first each chunk meets a few hubs, the
    documents whose bands met the most others, as the original of many copies does; what then isn't in the family's largest part
    meets all of the family.  Every link outside of that part has an end there, so none is lost, and what is in the part isn't
    compared again."""
    sizes = held.groupBy("f").agg(F.count(F.lit(1)).alias("size"), F.sum("n_bytes").alias("n_bytes"))
    chunks = written(sizes.select("f", F.greatest(F.lit(1), F.ceil(F.col("size") / CHUNK_DOCS), F.ceil(F.col("n_bytes") / CHUNK_BYTES)).cast("int").alias("chunks")).where("chunks > 1"), "chunks")
    some = bool(chunks.limit(1).count())
    if not some:
        alone = held.select("f", F.lit(0).alias("i"), F.lit(WHOLE).alias("j"), "doc_id", "text").repartition(partitions(held.sparkSession), "f", "i", "j").sortWithinPartitions("f", "i", "j", "doc_id")
        return _verified(alone, n, similarity).select(F.col("a").alias("vertex"), F.col("b").alias("root"))

    placed = held.select("f", "doc_id", "weight").join(chunks, "f", "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"), F.lit(0)))
    large = written(placed.where("chunks is not null"), "large")
    hubs = large.groupBy("f", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(HUBS)).alias("h")).agg(F.max_by("doc_id", "weight").alias("doc_id"), F.max("chunks").alias("chunks"))
    spread = hubs.select("f", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i"), F.lit(PART).alias("j"), "doc_id")
    first = placed.select("f", F.col("chunk").alias("i"), F.when(F.col("chunks").isNull(), WHOLE).otherwise(PART).alias("j"), "doc_id").union(spread)
    links = written(_verified(_units(first, held), n, similarity), "links")
    whole = links.where("whole").select(F.col("a").alias("vertex"), F.col("b").alias("root"))

    joined = components(links.where("not whole"))
    part = large.join(joined.select(F.col("vertex").alias("doc_id"), "root"), "doc_id", "left").select("f", "doc_id", "chunks", "chunk", F.coalesce("root", "doc_id").alias("root"))
    part = written(part, "parts")
    most = part.groupBy("f", "root").agg(F.count(F.lit(1)).alias("size")).groupBy("f").agg(F.max_by("root", F.struct("size", "root")).alias("most"))
    rest = written(part.join(most.select(apart("f"), "most"), "f").where("root <> most").select("f", "doc_id", "chunks"), "rest")
    groups = written(rest.groupBy("f").agg(F.ceil(F.count(F.lit(1)) / CHUNK_DOCS).cast("int").alias("groups")), "groups")
    own = rest.join(groups, "f").select("f", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("groups")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"), "doc_id")
    every = part.join(groups, "f").select("f", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("i"), F.col("chunk").alias("j"), "doc_id")
    more = _verified(_units(own.union(every), held), n, similarity).select("a", "b")
    return whole.union(components(more.union(joined.select(F.col("vertex").alias("a"), F.col("root").alias("b")))))


def _classes(docs: DataFrame, *, n: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, digest, class_id) of every row that has a doc_id."""
    sketch = written(sketched(docs, n=n, bands=bands, rows=rows), "sketches")
    one = sketch.groupBy("digest").agg(F.min(F.struct("doc_id", "n_bytes", "bands")).alias("one"))  # one document of each text
    one = written(one.select("one.*", "digest"), "texts")

    keyed = one.select("doc_id", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size")).where("size > 1").select(apart("key"), "least", "size")
    met = written(keyed.join(buckets, "key").groupBy("doc_id", "least").agg(F.sum("size").alias("weight")), "ties")
    tied = components(met.where("doc_id > least").select(F.col("doc_id").alias("a"), F.col("least").alias("b")))
    members = met.groupBy("doc_id").agg(F.sum("weight").alias("weight"))
    family = members.join(tied.select(F.col("vertex").alias("doc_id"), "root"), "doc_id", "left").select("doc_id", "weight", F.coalesce("root", "doc_id").alias("f"))

    body = texts(docs).where("doc_id is not null").select("doc_id", "text", F.sha2("text", 256).alias("digest"))
    held = family.join(one.select("doc_id", "digest", "n_bytes"), "doc_id").join(body, ["doc_id", "digest"]).select("f", "doc_id", "n_bytes", "weight", "text")
    near = _joined(written(held, "families"), n, similarity)

    roots = one.select("doc_id", "digest").join(near.withColumnRenamed("vertex", "doc_id"), "doc_id", "left").select(apart("digest"), F.coalesce("root", "doc_id").alias("class_id"))
    return sketch.select("doc_id", "digest").join(roots, "digest")


def classes(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, class_id) of every row that has a doc_id."""
    return _classes(docs, **how).select("doc_id", "class_id")


def one_each(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with the first document of each class only; rows without doc_id stay.  Of equal rows (doc_id and text) one
    stays; rows that share the first doc_id of a class and differ in text all do."""
    key = f"_{max(map(len, docs.columns)) * 'k'}"  # longer than any name of a column
    own = F.concat_ws(" ", F.col("doc_id").cast("long"), F.sha2(F.coalesce("text", F.lit("")), 256))
    least = _classes(docs, **how).where("doc_id = class_id").select(F.concat_ws(" ", "doc_id", "digest").alias(key)).distinct()
    some = docs.where("doc_id is not null").withColumn(key, own).join(least, key, "left_semi").dropDuplicates([key]).drop(key)
    return some.unionByName(docs.where("doc_id is null"))


def op6_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return classes(documents(spark, sf_dir))
