"""Ranked lexical search: a threshold-seeded join of items with documents.

1. One pass over the texts writes a row for each document: its number of terms, and the items' terms in it with their counts.
   Later passes read these rows alone; texts are read once and never shuffled.
2. Counts of terms give their weights.  A term's impact on a document is what it adds to a score.
3. For each term the ``k`` highest impacts are stored with their documents: tasks give theirs, a window over a term's rows merges
   them.  The kth impact of any of an item's terms is a lower bound of the item's kth score; the exact scores of the stored documents
   of all its terms give a higher one.
4. An item's terms stand in order of their highest impact.  A document that has only terms of the first few, whose highest impacts
   sum up to less than the item's bound, can't be among its ``k`` best: those terms make no candidates.  A document with one
   of the others is a candidate if its impacts there, with the most that the first few can add, reach the bound; it
   is rescored exactly over all the item's terms.
5. Each task gives its ``k`` best of an item that reach the bound; a window over an item's rows ranks them.

The items are the query set; they are taken in blocks of ``BLOCK`` characters, each block against all documents, so what a task or
the driver holds (terms, thresholds, ``k`` stored documents a term) is bounded by the block and doesn't grow with the documents.

Defined results: a null or empty text has no terms; documents and items without a common term of positive weight aren't paired; rows with equal
doc_id are documents of their own, a null doc_id stands after the others of its score; rows with equal item_id are items of
their own; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.llm.common import Slice, documents, same_spans, slices, span_hashes, texts, words
from attesta.scratch import written

#: Documents returned for each item.
BEST = 10
#: Characters of items in a block.
BLOCK = 500_000
#: Pairs of a document and an item that a kernel keeps sums for at once.
_PAIRS = 1 << 21

#: Bytes between terms: ASCII but letters and digits.  Only A to Z are made small.
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[0x41:0x5B] += 0x20


def item_blocks(items: DataFrame, size: int = BLOCK) -> Iterator[list[tuple[int | None, str]]]:
    """(item_id, text) of all items, some ``size`` characters at a time."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text <> ''")
    total = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = -(-total // size)
    for i in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else rows
        yield [(r[0], r[1]) for r in part.orderBy("item_id", "text").collect()]  # about ``size`` characters


class Queries(NamedTuple):
    """The items of a block: their distinct terms as one line of bytes, and each item's terms as numbers in it."""

    ids: list[int | None]
    data: np.ndarray
    at: np.ndarray  # term t: data[at[t]:at[t + 1]]
    hashes: np.ndarray  # sorted
    by_hash: np.ndarray  # the term of each
    near: np.ndarray  # whether a term's hash has these leading bits
    first: np.ndarray  # item i: terms[first[i]:first[i + 1]]
    terms: np.ndarray


def queries(items: list[tuple[int | None, str]]) -> Queries:
    number: dict[bytes, int] = {}
    each = []
    for s in slices(pa.array([t for _, t in items], pa.large_string())):
        w = words(s, _BETWEEN)
        raw = _SMALL[s.data].tobytes()
        found = [number.setdefault(raw[a:b], len(number)) for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]
        each += [sorted({*found[a:b]}) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
    data = np.frombuffer(b"".join(number), np.uint8)
    at = np.concatenate([[0], np.cumsum(list(map(len, number)))]).astype(np.int64)
    hashes = span_hashes(data, at[:-1], at[1:])
    order = np.argsort(hashes)
    near = np.zeros(1 << 20, bool)
    near[hashes >> np.uint64(44)] = True
    first = np.concatenate([[0], np.cumsum(list(map(len, each)))]).astype(np.int64)
    return Queries([i for i, _ in items], data, at, hashes[order], order, near, first, np.array([t for e in each for t in e], np.int64))


def counts(q: Queries, s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms in each document with repeats; row, term and occurrences of each of the items' terms, by row and term)."""
    w = words(s, _BETWEEN)
    n = np.diff(w.first)
    if not len(q.hashes) or not len(w.start):
        return n, *(np.zeros(0, np.int64) for _ in range(3))
    small = _SMALL[s.data]
    h = span_hashes(small, w.start, w.end)
    some = np.flatnonzero(q.near[h >> np.uint64(44)])
    at = np.minimum(np.searchsorted(q.hashes, h[some]), len(q.hashes) - 1)
    equal = q.hashes[at] == h[some]
    some, term = some[equal], q.by_hash[at[equal]]
    equal = same_spans(small, w.start[some], w.end[some], q.data, q.at[term], q.at[term + 1])
    key, tf = np.unique(w.row[some[equal]] * len(q.hashes) + term[equal], return_counts=True)
    return n, key // len(q.hashes), key % len(q.hashes), tf


def term_rows(docs: DataFrame, q: Queries) -> DataFrame:
    """(row, doc_id, n, terms, tfs) of every document, written; terms and tfs as little-endian words."""
    held = docs.sparkSession.sparkContext.broadcast(q)  # one block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, done = held.value, TaskContext.get().partitionId() << 36
        for batch in batches:
            for s in slices(batch.column("text")):
                n, row, term, tf = counts(own, s)
                ends = pa.py_buffer((4 * np.searchsorted(row, np.arange(s.rows + 1))).astype(np.int32).tobytes())
                columns = [pa.Array.from_buffers(pa.binary(), s.rows, [None, ends, pa.py_buffer(x.astype("<u4").tobytes())]) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([pa.array(done + np.arange(s.rows)), batch.column("doc_id").slice(s.start, s.rows), pa.array(n), *columns], ["row", "doc_id", "n", "terms", "tfs"])
                done += s.rows

    return written(texts(docs).mapInArrow(run, "row long, doc_id long, n long, terms binary, tfs binary"), "terms")


class Postings(NamedTuple):
    """Rows of a batch: their own columns, and (row in the batch, term, impact) by row and term."""

    ids: np.ndarray
    row: np.ndarray
    term: np.ndarray
    impact: np.ndarray


class Weights(NamedTuple):
    """What scores need of all documents."""

    documents: int
    terms: int
    weight: np.ndarray

    def impacts(self, n: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Of terms that occur tf times in documents of n terms."""
        if 90 * int(n.max(initial=0)) * self.documents >= 1 << 63:
            n = n.astype(object)
        m = (100 - 90 + 90 * n * self.documents // max(1, self.terms)).astype(np.int64)
        return self.weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all rows, where each row's begin)."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
    data = column.buffers()[2]
    return (np.frombuffer(data, "<u4")[at[0] : at[-1]].astype(np.int64) if data is not None and at[-1] > at[0] else np.zeros(0, np.int64)), at - at[0]


def postings(batch: pa.RecordBatch, w: Weights) -> Postings:
    term, at = _words(batch.column("terms"))
    tf, _ = _words(batch.column("tfs"))
    row = np.repeat(np.arange(len(batch)), np.diff(at))
    impact = w.impacts(np.asarray(batch.column("n"), np.int64)[row], term, tf)
    some = impact > 0
    return Postings(np.asarray(batch.column("row"), np.int64), row[some], term[some], impact[some])


def _parts(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(batch), rows):
        yield batch.slice(a, rows)


def weights(table: DataFrame, n_terms: int) -> Weights:
    """From the number of documents with each term; one row a term and task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(n_terms + 2, np.int64)
        for batch in batches:
            if len(batch):
                found[:n_terms] += np.bincount(_words(batch.column("terms"))[0], minlength=n_terms)
                n = np.asarray(batch.column("n"), np.int64)
                found[n_terms] += np.count_nonzero(n)
                found[n_terms + 1] += n.sum()
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at])], ["term", "n"])

    total = np.zeros(n_terms + 2, np.int64)
    for r in table.select("n", "terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n")).collect():
        total[r[0]] = r[1]
    n = int(total[n_terms])
    return Weights(n, int(total[n_terms + 1]), np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for df in total[:n_terms].tolist()], np.int64))


def _leading(key: np.ndarray, *order: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each key, in an order (the first array counts most)."""
    by = np.lexsort([*order[::-1], key])
    own = key[by]
    first = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1]) if len(own) else np.zeros(0, np.int64)
    place = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    return by[place < k]


def stored_impacts(table: DataFrame, w: Weights, k: int) -> DataFrame:
    """(term, impact, row, place): the k highest impacts of each term, place 1 the highest."""
    held = table.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        term, impact, row = (np.zeros(0, np.int64) for _ in range(3))
        for batch in batches:
            for part in _parts(batch, 1 << 12):
                p = postings(part, own)
                term, impact, row = (np.concatenate(x) for x in ((term, p.term), (impact, p.impact), (row, p.ids[p.row])))
                best = _leading(term, -impact, row, k=k)
                term, impact, row = term[best], impact[best], row[best]
        yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(impact), pa.array(row)], ["term", "impact", "row"])

    found = table.select("row", "n", "terms", "tfs").mapInArrow(run, "term int, impact long, row long")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"), "row"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def exact(q: Queries, p: Postings, row: np.ndarray, item: np.ndarray) -> np.ndarray:
    """The scores of pairs of a row of the batch and an item: the impacts of all the item's terms."""
    size = q.first[item + 1] - q.first[item]
    pair = np.repeat(np.arange(len(row)), size)
    term = q.terms[np.repeat(q.first[item] - np.cumsum(size) + size, size) + np.arange(len(pair))]
    have, want = p.row * len(q.hashes) + p.term, row[pair] * len(q.hashes) + term
    at = np.minimum(np.searchsorted(have, want), max(0, len(have) - 1))
    value = np.where(have[at] == want, p.impact[at], 0) if len(have) else np.zeros(len(pair), np.int64)
    return _sums(pair, value, len(row))


def _sums(key: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit integers by key; ``bincount`` adds doubles, so halves are summed apart."""
    low = np.bincount(key, weights=value & ((1 << 26) - 1), minlength=n)
    high = np.bincount(key, weights=value >> 26, minlength=n)
    return low.astype(np.int64) + (high.astype(np.int64) << 26)


class Plan(NamedTuple):
    """Of each item: the least score to reach, and the most that terms which make no candidates add; term t makes candidates for
    items[first[t]:first[t + 1]]."""

    least: np.ndarray
    rest: np.ndarray
    first: np.ndarray
    items: np.ndarray


def plan(q: Queries, highest: np.ndarray, least: np.ndarray) -> Plan:
    """From the highest impact of each term and a lower bound of each item's kth score."""
    rest, pairs = np.zeros(len(q.ids), np.int64), []
    for i in range(len(q.ids)):
        own = q.terms[q.first[i] : q.first[i + 1]]
        own = own[np.argsort(highest[own], kind="stable")]
        bound = np.cumsum(highest[own])
        idle = int(np.searchsorted(bound, least[i]))  # these together stay below it
        rest[i] = bound[idle - 1] if idle else 0
        pairs.append(np.stack([own[idle:], np.full(len(own) - idle, i)]))
    term, item = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
    order = np.argsort(term, kind="stable")
    return Plan(least, rest, np.searchsorted(term[order], np.arange(len(q.hashes) + 1)), item[order])


def candidates(q: Queries, p: Postings, of: Plan, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, item) that can reach the items' bounds."""
    size = of.first[p.term + 1] - of.first[p.term]
    from_ = np.repeat(np.arange(len(p.term)), size)
    item = of.items[np.repeat(of.first[p.term] - np.cumsum(size) + size, size) + np.arange(len(from_))]
    key = p.row[from_] * len(q.ids) + item
    met = np.zeros(rows * len(q.ids), bool)
    met[key] = True
    total = _sums(key, p.impact[from_], rows * len(q.ids)).reshape(rows, -1)
    return np.nonzero(met.reshape(rows, -1) & (total + of.rest >= of.least))


def _scored(held, sought, k: int):
    """Runs over rows of terms: the k best of each item in a task, of the pairs that ``sought`` gives for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, w, least = held.value[:3]
        item, score, row, doc, none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        for batch in batches:
            for part in _parts(batch, max(1, _PAIRS // max(1, len(q.ids)))):
                p = postings(part, w)
                r, i = sought(held.value, p)
                found = exact(q, p, r, i)
                reach = found >= least[i]
                r, i, found = r[reach], i[reach], found[reach]
                ids = part.column("doc_id").take(pa.array(r))
                add = (i, found, p.ids[r], np.asarray(ids.fill_null(0), np.int64), np.asarray(ids.is_null()))
                item, score, row, doc, none = (np.concatenate(x) for x in zip((item, score, row, doc, none), add, strict=True))
                best = _leading(item, -score, none, doc, row, k=k)
                item, score, row, doc, none = item[best], score[best], row[best], doc[best], none[best]
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(score), pa.array(row), pa.array(doc, mask=none)], ["item", "score", "row", "doc_id"])

    return run


_SCORED = "item int, score long, row long, doc_id long"


def _all_candidates(held: tuple, p: Postings) -> tuple[np.ndarray, np.ndarray]:
    q, _, _, of = held
    return candidates(q, p, of, len(p.ids))


def _stored(held: tuple, p: Postings) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a stored document and an item with the term that it is stored for."""
    rows, items = held[3]
    left, right = np.searchsorted(rows, p.ids), np.searchsorted(rows, p.ids, "right")
    size = right - left
    row = np.repeat(np.arange(len(p.ids)), size)
    return row, items[np.repeat(left - np.cumsum(size) + size, size) + np.arange(len(row))]


def best_places(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bounds(table: DataFrame, q: Queries, w: Weights, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(highest impact of each term, lower bound of each item's kth score, 1 at least)."""
    stored = stored_impacts(table, w, k).toPandas()  # at most k rows a term of the block
    term, impact, row, place = (stored[c].to_numpy(np.int64) for c in ("term", "impact", "row", "place"))
    highest, kth = np.zeros(len(q.hashes), np.int64), np.zeros(len(q.hashes), np.int64)
    highest[term[place == 1]], kth[term[place == k]] = impact[place == 1], impact[place == k]
    least = np.array([max(1, int(kth[q.terms[a:b]].max(initial=0))) for a, b in zip(q.first[:-1], q.first[1:], strict=True)], np.int64)
    # each item with the documents that are stored for its terms
    order = np.argsort(term, kind="stable")
    first = np.searchsorted(term[order], np.arange(len(q.hashes) + 1))
    item_of = np.repeat(np.arange(len(q.ids)), np.diff(q.first))
    size = (first[1:] - first[:-1])[q.terms]
    at = np.repeat(first[q.terms] - np.cumsum(size) + size, size) + np.arange(size.sum())
    pairs = np.unique(np.stack([row[order][at], np.repeat(item_of, size)]), axis=1)
    spark = table.sparkSession
    held = spark.sparkContext.broadcast((q, w, least, (pairs[0], pairs[1])))  # k pairs a term of an item
    rows = spark.createDataFrame(pa.table({"row": np.unique(pairs[0])}))
    found = table.join(F.broadcast(rows), "row", "left_semi").mapInArrow(_scored(held, _stored, k), _SCORED)
    for r in best_places(found, k).where(F.col("rank") == k).select("item", "score").collect():
        least[r[0]] = max(least[r[0]], r[1])
    return highest, least


def ranked(docs: DataFrame, items: DataFrame, *, k: int = BEST, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item."""
    spark = docs.sparkSession

    def of(part: list[tuple[int | None, str]]) -> DataFrame:
        q = queries(part)
        table = term_rows(docs, q)
        w = weights(table, len(q.hashes))
        highest, least = bounds(table, q, w, k)
        held = spark.sparkContext.broadcast((q, w, least, plan(q, highest, least)))  # one block
        found = table.mapInArrow(_scored(held, _all_candidates, k), _SCORED)
        names = spark.createDataFrame(pa.table({"item": pa.array(range(len(q.ids)), pa.int32()), "item_id": pa.array(q.ids, pa.int64())}))
        return best_places(found, k).join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")

    found = [of(part) for part in item_blocks(items, block)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op11_threshold_seeded_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The same for DuckDB: scores of all pairs with a common term.
SQL = r"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
s AS MATERIALIZED (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
tf AS MATERIALIZED (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(t) AS term FROM d) GROUP BY ALL),
w AS MATERIALIZED (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
i AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark WHERE text IS NOT NULL),
q AS MATERIALIZED (SELECT DISTINCT item, item_id, unnest(t) AS term FROM i),
m AS (SELECT row, doc_id, 100 - 90 + (90 * len(t) * n_docs) // n_terms AS m FROM d, s),
p AS (SELECT item, item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (row) GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, row) AS INTEGER) AS rank, doc_id, score FROM p WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""
