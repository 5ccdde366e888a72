"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters with an error budget of k edits is cut into k + 1 pieces; where the item occurs with at most k edits,
one piece at least occurs exactly.  All pieces of all items are found in one pass over a text (Aho-Corasick).  Pieces stand in
groups of two (the last of an odd number in a group of three), and by the same principle one group of g pieces occurs with
fewer than g edits, so a hit whose group doesn't is dropped.  The other hits of an item on neighbouring diagonals make one
window, which Myers' bit-parallel algorithm verifies.

Items and texts are compared in lower case with runs of white space as one space.  The budget is ``RATE`` of the length at
every length, so pieces have some nine characters, and items of fewer than ``SHORT`` characters occur exactly, as whole words, or
not at all; ``clean`` removes no document for them, for they say little about where a text comes from.

The items are the query set: they are taken in blocks of bounded size, each block against every document, so what a task
holds does not grow with the benchmark.  Documents are not shuffled.  Defined results: null and empty texts and items match
nothing; an item that occurs several times in a document gives one row with the number of places and the best of them (the
first of equals); equal items are separate; rows with equal doc_id are separate.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import documents, texts

RATE = 0.1
#: Characters (after ``normal``) below which an item must stand between words, and doesn't make ``clean`` drop a document.
SHORT = 10
#: Characters of items in a block.
BLOCK = 2_000_000


def lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def normal(text: str) -> str:
    return " ".join(lowered(text).split())


def places(text: str) -> list[int]:
    """For each character of ``normal(text)``, and for its end, its place in ``text``."""
    out, space = [], True
    for i, c in enumerate(text):
        if not c.isspace():
            out.append(i)
            space = False
        elif not space:
            out.append(i)
            space = True
    if space and out:
        out.pop()
    return [*out, out[-1] + 1 if out else 0]


def myers(pattern: str, text: str) -> Iterator[tuple[int, int]]:
    """(end, distance): the least edit distance between ``pattern`` and a stretch of ``text`` that ends before ``end``."""
    m = len(pattern)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    every, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance = every, 0, m
    for end, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        diagonal = ((((eq & plus) + plus) ^ plus) | eq | minus) & every
        horizontal_plus = (minus | ~(diagonal | plus)) & every
        horizontal_minus = plus & diagonal
        if horizontal_plus & top:
            distance += 1
        elif horizontal_minus & top:
            distance -= 1
        horizontal_plus = (horizontal_plus << 1) & every
        horizontal_minus = (horizontal_minus << 1) & every
        plus = (horizontal_minus | ~(diagonal | horizontal_plus)) & every
        minus = horizontal_plus & diagonal
        yield end, distance


def one_edit(piece: str, text: str) -> bool:
    """Whether ``text`` starts with ``piece`` up to one edit."""
    if text.startswith(piece):
        return True
    i, n = 0, len(text)
    while i < n and piece[i] == text[i]:
        i += 1
    rest = piece[i + 1 :]
    return text.startswith(rest, i + 1) or text.startswith(rest, i) or text.startswith(piece[i:], i + 1)


class Match(NamedTuple):
    item: int
    distance: int
    start: int
    end: int
    places: int


class Matcher:
    """Finds items in texts; ``items`` are (id, text)."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE) -> None:
        import ahocorasick

        self.items = [(i, n) for i, t in items if (n := normal(t or ""))]
        self.budget = [int(rate * len(t)) for _, t in self.items]
        # piece -> (item, its place there, where its group begins and ends; the group's other piece, reversed if it comes first)
        found: dict[str, list[tuple[int, int, int, int, str]]] = defaultdict(list)
        for k, (_, t) in enumerate(self.items):
            n = self.budget[k] + 1
            cut = [j * len(t) // n for j in range(n + 1)]
            for j in range(n):
                first = max(0, min(j - j % 2, n - 3 if n % 2 else n))
                last = n if n % 2 and first == n - 3 else min(first + 2, n)
                a, b, low, high = cut[j], cut[j + 1], cut[first], cut[last]
                other = "" if last - first != 2 else t[b:high] if j == first else t[low:a][::-1]
                found[t[a:b]].append((k, a, low, high, other))
        self.automaton = ahocorasick.Automaton()
        for p, where in found.items():
            self.automaton.add_word(p, (len(p), where))
        self.automaton.make_automaton()

    def _near(self, text: str, at: int, end: int, k: int, a: int, low: int, high: int, other: str) -> bool:
        """Whether the group of a piece that stands at at..end in text occurs there with fewer edits than it has pieces."""
        if other:
            return one_edit(other, text[end : end + len(other) + 1] if a == low else text[max(0, at - len(other) - 1) : at][::-1])
        if self.budget[k] < 3:  # the group is the item
            return True
        return any(d < 3 for _, d in myers(self.items[k][1][low:high], text[max(0, at - (a - low) - 2) : at + high - a + 2]))

    def _apart(self, k: int, text: str, at: int) -> bool:
        """Whether item k, if it is short, stands at ``at`` as whole words."""
        pattern = self.items[k][1]
        if len(pattern) >= SHORT:
            return True
        end = at + len(pattern)
        return not (at and text[at - 1].isalnum() and pattern[0].isalnum()) and not (end < len(text) and text[end].isalnum() and pattern[-1].isalnum())

    def _verify(self, k: int, text: str, low: int, high: int) -> tuple[int, int, int] | None:
        """(distance, start, end) of item k in text, for matches that start near low..high."""
        pattern, budget = self.items[k][1], self.budget[k]
        left, right = max(0, low - budget), high + len(pattern) + budget
        exact = text.find(pattern, left, right)
        if exact >= 0:
            return 0, exact, exact + len(pattern)
        end, distance = min(myers(pattern, text[left:right]), key=lambda x: (x[1], x[0]), default=(0, budget + 1))
        if distance > budget:
            return None
        length = min((e for e, d in myers(pattern[::-1], text[left : left + end][::-1]) if d == distance), default=end)
        return distance, left + end - length, left + end

    def matches(self, text: str) -> list[Match]:
        """Matches in ``text``, by item; places are those of its code points."""
        if not len(self.automaton):
            return []
        low = normal(text)
        diagonals: dict[int, list[int]] = defaultdict(list)
        for end, (size, where) in self.automaton.iter(low):
            at = end + 1 - size
            for k, a, *group in where:
                if self._near(low, at, end + 1, k, a, *group) and self._apart(k, low, at - a):
                    diagonals[k].append(at - a)
        out, back = [], None
        for k, starts in sorted(diagonals.items()):
            starts.sort()
            found, first = [], 0
            for i in range(1, len(starts) + 1):
                if i == len(starts) or starts[i] - starts[i - 1] > 2 * self.budget[k] + 1:
                    if hit := self._verify(k, low, starts[first], starts[i - 1]):
                        found.append(hit)
                    first = i
            if found:
                back = back or places(text)
                distance, a, b = min(found)
                out.append(Match(self.items[k][0], distance, back[a], back[b - 1] + 1 if b > a else back[a], len(set(found))))
        return out


@lru_cache(maxsize=4)
def _matcher(items: tuple[tuple[int, str], ...], rate: float) -> Matcher:
    return Matcher(list(items), rate)


def blocks(benchmark: DataFrame, size: int = BLOCK) -> Iterator[tuple[tuple[int, str], ...]]:
    """The items, some ``size`` characters at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null")
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = -(-total // size)
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else items
        yield tuple(sorted((r[0], r[1]) for r in part.collect()))  # about ``size`` characters


def matched(docs: DataFrame, benchmark: DataFrame, *, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, distance, start, end, n_places): one row for each item that a document holds."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, distance int, start long, end long, n_places int"

    def of(items: tuple[tuple[int, str], ...]) -> DataFrame:
        held = spark.sparkContext.broadcast(items)  # one block

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tool = _matcher(held.value, rate)
            for batch in batches:
                rows = [(d, *m) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True) for m in tool.matches(t.as_py())]
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["doc_id", "item_id", "distance", "start", "end", "n_places"])

        return texts(docs).mapInArrow(run, schema)

    found = [of(items) for items in blocks(benchmark, block)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, *, rate: float = RATE, block: int = BLOCK, least: int = SHORT) -> DataFrame:
    """``docs`` without the documents that hold an item of ``least`` characters or more; all columns, no shuffle."""
    place = docs.columns.index("text")
    for items in blocks(benchmark, block):
        items = tuple(x for x in items if len(normal(x[1])) >= least)
        held = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            tool = _matcher(held.value, rate)
            for batch in batches:
                yield batch.filter(pa.array(np.array([not tool.matches(t.as_py() or "") for t in batch.column(place)], bool)))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1_pigeonhole_myers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds, up to the item's error budget."""
    return matched(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
