"""Quality rules: an ordered decision list of threshold conjunctions, learned from labelled statistics by sequential covering.

``statistics`` gives one row per document with counts over the whole text.  ``learn`` grows each rule by the gain of
Foil on two thirds of the labelled rows, prunes it on the other third, keeps it while it is precise there, removes what it
covers, and goes on.  ``verdict`` turns the list into one Spark conditional expression, evaluated in order.

The learner sees at most ``sample_rows`` labelled rows (those with the smallest hashed ids); the rules are then applied to
every row.  Defined results: a null text is empty (no words, so it fails the base test); with no labelled rows of both
kinds the list is empty and the base test alone decides; labels that are repeated for an id count once, the worst one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.common import SEPARATOR, U64, Slice, counted, documents, mix, slices, span_hashes, texts, windows, words

#: At most so many labelled rows fit the rules.
SAMPLE_ROWS = 6000
#: Words in a window of which repeats are counted.
WINDOW = 8


def _table(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


_SYMBOL, _MARK, _DIGIT = _table("#*$%&|<>"), _table(".,;:!?"), _table("0123456789")
_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_runs", "n_upper", "n_digits", "n_marks"]
RATIOS = ["symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "mark_share", "mean_word"]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)


def _repeats(row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each entry, whether an equal one stands in the same row; and in ``[1]`` whether an earlier one does."""
    key = mix(hashes ^ mix(row.astype(U64) + U64(1)))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order[1:]] == key[order[:-1]]
    twice, earlier = np.zeros(len(key), bool), np.zeros(len(key), bool)
    twice[order] = same[:-1] | same[1:]
    earlier[order] = same[:-1]
    return np.stack([twice, earlier])


def counts(s: Slice) -> dict[str, np.ndarray]:
    """Of each document of a slice, the counts named in COUNTS."""
    w = words(s)
    hashes = span_hashes(s.data, w.start, w.end)
    inside = ~SEPARATOR[s.data]
    lead = (s.data & 0xC0) != 0x80
    out = {"n_words": np.diff(w.first), "word_chars": counted(inside & lead, s.at), "n_symbols": counted(_SYMBOL[s.data], s.at)}
    # lines
    newline = np.flatnonzero(s.data == 10)
    starts = np.sort(np.concatenate([s.at[:-1], newline + 1]))
    row = _rows_of_lines(s.at, newline)  # by count, for starts are equal where a document is empty
    ends = np.concatenate([starts[1:], [len(s.data)]]).astype(np.int64)
    after = np.concatenate([row[1:] == row[:-1], [False]]).astype(np.int64)
    ends = ends - after  # without the newline itself
    sums = np.zeros(len(s.data) + 1, np.int64)
    np.cumsum(inside, out=sums[1:])
    wordy = sums[ends] > sums[starts]
    rows, lines = row[wordy], span_hashes(s.data, starts[wordy], ends[wordy])
    out["n_dup_lines"] = np.bincount(rows[_repeats(rows, lines)[1]], minlength=s.rows)
    out["n_lines"] = np.bincount(rows, minlength=s.rows)
    # windows of words
    at, h = windows(hashes, w.row, WINDOW)
    again = at[_repeats(w.row[at], h)[0]]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    out["n_repeat_words"] = counted(np.cumsum(cover[:-1]) > 0, w.first)
    at, h = windows(hashes, w.row, 3)
    new = np.zeros(len(hashes), bool)
    new[at] = ~_repeats(w.row[at], h)[1]
    out["n_distinct_runs"] = counted(new, w.first)
    out["n_upper"], out["n_digits"], out["n_marks"] = (counted(t[s.data], s.at) for t in (_UPPER, _DIGIT, _MARK))
    return out


def _rows_of_lines(at: np.ndarray, newline: np.ndarray) -> np.ndarray:
    """The row of each line: every row has one line more than newlines."""
    per_row = 1 + np.searchsorted(newline, at[1:]) - np.searchsorted(newline, at[:-1])
    return np.repeat(np.arange(len(at) - 1), per_row)


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, *COUNTS) of every row; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                found = counts(s)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s.start, s.rows), *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], ["doc_id", *COUNTS])

    return texts(docs).mapInArrow(run, SCHEMA)


def with_ratios(stats: DataFrame) -> DataFrame:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    made = {
        "symbol_share": ("n_symbols", "word_chars"),
        "dup_line_share": ("n_dup_lines", "n_lines"),
        "repeat_share": ("n_repeat_words", "n_words"),
        "upper_share": ("n_upper", "word_chars"),
        "digit_share": ("n_digits", "word_chars"),
        "mark_share": ("n_marks", "n_words"),
        "mean_word": ("word_chars", "n_words"),
    }
    # of runs of three words, of which a text has two fewer than words
    distinct = F.col("n_distinct_runs") / F.greatest(F.col("n_words") - 2, F.lit(1))
    return stats.withColumns({k: share(*v) for k, v in made.items()} | {"distinct_share": distinct})


class Condition(NamedTuple):
    feature: str
    above: bool
    threshold: float


def _holds(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        v = x[:, RATIOS.index(c.feature)]
        out &= (v > c.threshold) if c.above else (v <= c.threshold)
    return out


def _best(x: np.ndarray, y: np.ndarray) -> tuple[float, Condition | None]:
    """The condition of the largest Foil gain; thresholds lie halfway between neighbouring values."""
    p0, n0 = y.sum(), (~y).sum()
    best: tuple[float, Condition | None] = (1e-9, None)
    if p0 == 0 or n0 == 0:
        return best
    base = np.log2(p0 / (p0 + n0))
    for k, name in enumerate(RATIOS):
        order = np.argsort(x[:, k], kind="stable")
        v, good = x[order, k], y[order]
        cuts = np.flatnonzero(v[1:] > v[:-1])
        below_p, below_n = np.cumsum(good)[cuts], np.cumsum(~good)[cuts]
        for above in (True, False):
            p, n = (p0 - below_p, n0 - below_n) if above else (below_p, below_n)
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - base), -1.0)
            if len(gain) and gain.max() > best[0]:
                i = int(gain.argmax())
                best = (float(gain[i]), Condition(name, above, float((v[cuts[i]] + v[cuts[i] + 1]) / 2)))
    return best


def learn(x: np.ndarray, bad: np.ndarray, *, most_rules: int = 12, most_conditions: int = 4, least_cover: int = 3, precision: float = 0.9, tries: int = 5, seed: int = 7) -> list[list[Condition]]:
    """Rules that reject, in order; what none of them covers is kept."""
    rules: list[list[Condition]] = []
    random, left, failed = np.random.default_rng(seed), np.arange(len(x)), 0
    while failed < tries and len(rules) < most_rules and bad[left].any() and (~bad[left]).any():
        left = random.permutation(left)
        grow, prune = left[np.arange(len(left)) % 3 > 0], left[np.arange(len(left)) % 3 == 0]
        rule: list[Condition] = []
        at = grow
        while len(rule) < most_conditions and (~bad[at]).any() and bad[at].any():
            _, c = _best(x[at], bad[at])
            if c is None:
                break
            rule.append(c)
            at = at[_holds([c], x[at])]

        def worth(r: list[Condition]) -> float:
            hit = _holds(r, x[prune])
            p, n = (hit & bad[prune]).sum(), (hit & ~bad[prune]).sum()
            return float((p - n) / (p + n)) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        hit = _holds(rule, x[left])
        p, n = int((hit & bad[left]).sum()), int((hit & ~bad[left]).sum())
        if not rule or p < least_cover or p < precision * (p + n) or worth(rule) < 2 * precision - 1:
            failed += 1  # another split may do better
            continue
        rules.append(rule)
        left, failed = left[~hit], 0
    return rules


def rejects(rules: list[list[Condition]]) -> Column:
    """The decision list as ordered conditional expressions: true where a rule rejects."""
    out: Column | None = None
    for rule in rules:
        test = reduce(lambda a, b: a & b, [(F.col(c.feature) > c.threshold) if c.above else (F.col(c.feature) <= c.threshold) for c in rule])
        out = F.when(test, F.lit(True)) if out is None else out.when(test, F.lit(True))
    return F.lit(False) if out is None else out.otherwise(F.lit(False))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def labelled(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(ratios, rejected) of at most ``sample_rows`` labelled rows, those with the smallest hashed ids."""
    bound = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(bound.select("doc_id")), "doc_id", "left_semi")  # at most sample_rows ids
    rows = with_ratios(statistics(chosen)).join(F.broadcast(bound), "doc_id").orderBy("doc_id").limit(2 * sample_rows).select("quality", *RATIOS).toPandas()
    return rows[RATIOS].to_numpy(float).reshape(-1, len(RATIOS)), rows["quality"].to_numpy() == 0


def judged(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, *COUNTS, *RATIOS, base_failed, kept) of every row, by the rules learned from ``labels``."""
    rules = learn(*labelled(docs, labels, sample_rows))
    return with_ratios(statistics(docs)).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejects(rules))


def accepted(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that pass the base test and the rules, with all their columns; no shuffle."""
    rules = learn(*labelled(docs, labels, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            for s in slices(row.field("text") if not row.offset else row.flatten()[row.type.get_field_index("text")]):
                found = counts(s)
                yield pa.RecordBatch.from_arrays([row.slice(s.start, s.rows), *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], ["row", *COUNTS])

    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    schema = T.StructType([*whole.schema.fields, *(T.StructField(c, T.LongType()) for c in COUNTS)])
    return with_ratios(whole.mapInArrow(run, schema)).where(~base_failed() & ~rejects(rules)).select("row.*")


def op7_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of every row of documents."""
    out = judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
