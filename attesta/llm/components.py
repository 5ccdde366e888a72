"""Connected components of an edge table: forests within tasks, then one task or alternating large and small stars.

Every task first replaces the edges it reads, ``HELD`` at a time, by stars around the least vertex of each of their parts, so
an edge table is never larger than its vertices a task.  Once at most ``HELD`` edges are left, one task finishes: it holds
16 bytes an edge, whatever the input.  Above that, rounds follow: each replaces the edges at a vertex by edges to its least
neighbour, first those to larger vertices, then those to smaller ones, and every component shrinks to a star in about the
logarithm of its diameter.  A round is a grouped minimum (partial sums before the shuffle) and a join back, both on vertices; a
vertex with very many edges is split by adaptive execution.  The result is the same either way.  Nothing but a count and
whether all are stars reaches the driver; each round is a written table.  An empty table has no components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import apart
from attesta.scratch import written

#: Edges that a task holds.
HELD = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, root): for every vertex of the edges (a, b) but the least of its component that least one."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(ids))
    while True:
        x, y = label[x], label[y]
        apart_ = x != y
        if not apart_.any():
            break
        x, y = x[apart_], y[apart_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    at = np.flatnonzero(label != np.arange(len(ids)))
    return ids[at], ids[label[at]]


def _forests(edges: DataFrame, held: int) -> DataFrame:
    """The edges of each task as stars, ``held`` at a time; (a, b) with a > b, connected as ``edges`` are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a[0]), pa.array(b[0])], ["a", "b"])

        for batch in batches:
            a.append(np.asarray(batch.column("a"), np.int64))
            b.append(np.asarray(batch.column("b"), np.int64))
            size += batch.num_rows
            if size >= held:
                u, v = stars(np.concatenate(a), np.concatenate(b))
                a, b, size = [u], [v], len(u)
                if size >= held // 2:
                    yield table()
                    a, b, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        u, v = stars(np.concatenate(a), np.concatenate(b))
        a, b = [u], [v]
        yield table()

    return edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(run, "a long, b long")


def _round(edges: DataFrame) -> DataFrame:
    """One large and one small star over edges (a > b)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(apart("a"), F.least("a", "m").alias("m"))
    large = both.join(least, "a").where("b > a and b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m")).select(apart("a"), "m")
    small = large.join(least, "a")
    return small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").union(small.select("a", F.col("m").alias("b"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the distinct edges are stars: each vertex has one root at most, and a root has none."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(edges.select("b", F.lit(0), F.lit(1)))
    return not ends.groupBy("v").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or (out > 0 and in > 0)").limit(1).count()


def components(edges: DataFrame, rounds: int = 60, held: int = HELD) -> DataFrame:
    """(vertex, root) for every vertex other than the least one of its component; ``edges`` are (a, b), a <> b."""
    now = written(_forests(edges, held), "edges")
    for i in range(rounds):
        if now.count() <= held:  # a task's share
            now = written(_forests(now.coalesce(1), held + 1), "edges")
        elif not (i and _settled(now)):
            now = written(_forests(_round(now), held) if i % 2 else _round(now), "edges")
            continue
        return now.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    raise RuntimeError("components did not settle")
