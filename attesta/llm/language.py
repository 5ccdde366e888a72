"""Language identification by interpolated Kneser-Ney models of characters, one for each language.

Texts are lower-cased, every run of other characters than letters is one space, and a document starts after ``ORDER - 1``
boundary marks.

* Counting: tasks count the distinct grams of the highest order by language, Spark sums them; lower orders follow from
  these, for Kneser-Ney takes continuation counts there.  All learnable documents are counted; the counts of those set aside
  for calibration (one in ``ASIDE``, by hash) are kept apart too.
* Model: all grams of each language, at every size of the corpus.  Spark makes it from the full count table: discounts from how
  many grams occur once and twice, for each gram what its own count adds to its symbol's probability, and for each context the
  weight of the lower order.  It is written to the shared folder; only the discounts, four numbers a language, reach the driver.
  Workers read it into one array of sorted gram hashes, with the numbers beside it, for each language and order.
* Prediction: the language of the lowest cross-entropy per character; each distinct gram of a slice is looked up once.  A
  logistic model of (margin, length) gives the score; it is fitted on all documents set aside, judged by a model that
  was counted without them; Spark sums up what a step of the fit needs.  What lies beyond the usual cross-entropy of its language or below the
  threshold of the score is ``rejected``.

Defined results: a text that is null or has no letter is ``und`` with score 0; without learnable documents all are; ties go
to the first language in alphabetical order; rows without doc_id are predicted but not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.llm.common import U64, documents, mix, string_buffers
from attesta.scratch import shared_path, written

ORDER = 4
#: Learnable documents that fit the score: one in so many is set aside.
ASIDE = 10
#: Share of the entropies of a language's right predictions that lie below its limit.
USUAL = 0.995
#: Characters that a kernel takes at once.
SLICE = 1 << 20
#: Rows that a task gathers before it hands partial counts on.
HELD = 2_000_000

_STEP = U64(0x9E3779B97F4A7C15)
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, document of each): ORDER - 1 zeros before each document, then its letters with single spaces between words."""
    lead = "\0" * (ORDER - 1)
    low = [t.lower().replace("\0", " ") for t in texts]
    length = np.array([len(t) for t in low], np.int64)
    c = np.frombuffer((lead + lead.join(low)).encode("utf-32-le", "surrogatepass"), np.uint32) if texts else np.zeros(0, np.uint32)
    document = np.repeat(np.arange(len(texts)), length + ORDER - 1)
    c = np.where(_letters()[c] | (c == 0), c, np.uint32(32))
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | ((c[:-1] != 32) & (c[:-1] != 0))
    return c[keep], document[keep]


def gram_hash(parts: list[np.ndarray]) -> np.ndarray:
    total = np.full(len(parts[0]), U64(len(parts)))
    for p in parts:
        total = total * _STEP + p.astype(U64)
    return mix(total)


def _grams(c: np.ndarray, document: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The ORDER symbols that end at each symbol other than a boundary mark, and their document."""
    if len(c) < ORDER:
        return [np.zeros(0, np.uint32)] * ORDER, np.zeros(0, np.int64)
    at = np.flatnonzero(c[ORDER - 1 :] != 0)
    return [c[at + k] for k in range(ORDER)], document[at + ORDER - 1]


def _text_slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    at, _ = string_buffers(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE, "right")) - 1)
        yield i, j
        i = j


# ---- counting ------------------------------------------------------------------------------------------------------


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learnable(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang").where(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull())


def aside() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(ASIDE)) == 0


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values, where each first stands, for each value its place among them)."""
    codes, values = pd.factorize(h)
    example = np.empty(len(values), np.int64)
    example[codes[::-1]] = np.arange(len(h) - 1, -1, -1)
    return values, example, codes


class _Counts:
    """Partial counts of a task: gram (two words of two symbols) by language and whether its documents are set aside."""

    def __init__(self) -> None:
        self.held: dict[tuple[str, bool], list[tuple[np.ndarray, ...]]] = {}
        self.size = 0

    def add(self, key: tuple[str, bool], parts: list[np.ndarray]) -> None:
        h, example, codes = distinct(gram_hash(parts))
        first = (parts[0][example].astype(np.int64) << 32) | parts[1][example]
        last = (parts[2][example].astype(np.int64) << 32) | parts[3][example]
        self.held.setdefault(key, []).append((h, first, last, np.bincount(codes, minlength=len(h))))
        self.size += len(h)

    def shrink(self) -> None:
        for key, found in self.held.items():
            if len(found) > 1:
                h, first, last, n = (np.concatenate(x) for x in zip(*found, strict=True))
                h, example, codes = distinct(h)
                self.held[key] = [(h, first[example], last[example], np.bincount(codes, n, len(h)).astype(np.int64))]
        self.size = sum(len(x[0]) for found in self.held.values() for x in found)

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.shrink()
        for (lang, away), ((_, first, last, n),) in self.held.items():
            for i in range(0, len(n), 50_000):
                part = slice(i, i + 50_000)
                size = len(n[part])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * size), pa.array([away] * size, pa.bool_()), *map(pa.array, (first[part], last[part], n[part]))], ["lang", "aside", "first", "last", "n"])
        self.held, self.size = {}, 0


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, first, last, n, n_aside): how often each gram occurs in the learnable documents of each language, and how often in
    those of them that are set aside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            away = np.asarray(batch.column("aside"))
            for i, j in _text_slices(batch.column("text")):
                parts, document = _grams(*symbols(batch.column("text").slice(i, j - i).to_pylist()))
                names, of = np.unique(langs[i:j].astype(str), return_inverse=True)
                kind = 2 * of + away[i:j]
                for k in np.unique(kind):
                    at = kind[document] == k
                    counts.add((str(names[k // 2]), bool(k % 2)), [p[at] for p in parts])
            if counts.size > HELD:
                counts.shrink()
                if counts.size > HELD // 2:
                    yield from counts.rows()
        yield from counts.rows()

    found = learnable(docs).select("text", "lang", aside().alias("aside")).mapInArrow(run, "lang string, aside boolean, first long, last long, n long")
    return found.groupBy("lang", "first", "last").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("aside"), F.col("n")).otherwise(0)).alias("n_aside"))


# ---- model ---------------------------------------------------------------------------------------------------------


class Table(NamedTuple):
    """Sorted hashes with a number each, and where each value of the leading bits starts."""

    keys: np.ndarray
    values: np.ndarray
    starts: np.ndarray
    shift: int

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        order = np.argsort(keys)
        bits = max(1, min(22, int(len(keys)).bit_length() + 1))
        keys = keys[order]
        starts = np.searchsorted(keys >> U64(64 - bits), np.arange((1 << bits) + 1, dtype=U64)).astype(np.int32)
        return cls(keys, values[order], starts, 64 - bits)

    def find(self, h: np.ndarray, missing: float) -> np.ndarray:
        """The number of each hash, ``missing`` where there is none."""
        out = np.full(len(h), missing, np.float32)
        if not len(self.keys):
            return out
        lead = (h >> U64(self.shift)).astype(np.int64)
        at, end = self.starts[lead].astype(np.int64), self.starts[lead + 1]
        last = len(self.keys) - 1
        live = np.flatnonzero(at < end)
        while len(live):
            hit = self.keys[np.minimum(at[live], last)] == h[live]
            out[live[hit]] = self.values[at[live[hit]]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out


class Model(NamedTuple):
    langs: list[str]
    grams: list[list[Table]]  # by order from 1 and by language: what a gram's own count adds to its symbol's probability
    contexts: list[list[Table]]  # likewise: the weight of the lower order after a context
    alphabet: int  # symbols, and one for all others

    def logs(self, parts: list[np.ndarray]) -> np.ndarray:
        """For each gram the log probability of its last symbol in each language; equal grams are looked up once."""
        _, example, codes = distinct(gram_hash(parts))
        parts = [p[example] for p in parts]
        probability = np.full((len(example), len(self.langs)), 1 / self.alphabet)
        for k in range(1, ORDER + 1):
            own = parts[ORDER - k :]
            whole, head = gram_hash(own), gram_hash(own[:-1]) if k > 1 else np.zeros(len(example), U64)
            for i in range(len(self.langs)):
                probability[:, i] = self.grams[k - 1][i].find(whole, 0.0) + self.contexts[k - 1][i].find(head, 1.0) * probability[:, i]
        return np.log(probability).astype(np.float32)[codes]


class Stored(NamedTuple):
    """A model in the shared folder: (lang, k, is_context, first, last, value, rest), symbols as in the count table; ``column`` holds
    its numbers, and rows where that is null aren't of this model."""

    path: str
    column: str
    langs: tuple[str, ...]
    alphabet: int


@lru_cache(maxsize=2)
def opened(stored: Stored) -> Model:
    """The model in this process."""
    system, path = fs.FileSystem.from_uri(stored.path) if "://" in stored.path else (fs.LocalFileSystem(), stored.path)
    rows = ds.dataset(path, filesystem=system, format="parquet").to_table(["lang", "k", "is_context", "first", "last", stored.column], filter=ds.field(stored.column).is_valid())
    lang = rows.column("lang").combine_chunks().dictionary_encode()
    lang = lang.combine_chunks() if isinstance(lang, pa.ChunkedArray) else lang
    place = {name: i for i, name in enumerate(stored.langs)}
    code = np.array([place[x] for x in lang.dictionary.to_pylist()], np.int64)[np.asarray(lang.indices)]
    kind, context = rows.column("k").to_numpy(), rows.column("is_context").to_numpy(zero_copy_only=False)
    first, last, value = rows.column("first").to_numpy(), rows.column("last").to_numpy(), rows.column(stored.column).to_numpy()
    low = np.int64(0xFFFFFFFF)

    def table(k: int, i: int, of_context: bool) -> Table:
        at = np.flatnonzero((kind == k) & (context == of_context) & (code == i))
        symbols_ = [first[at] >> 32, first[at] & low, last[at] >> 32, last[at] & low][ORDER - k :]
        symbols_ = [x.astype(np.uint32) for x in (symbols_[:-1] if of_context else symbols_)]
        return Table.of(gram_hash(symbols_) if symbols_ else np.zeros(len(at), U64), value[at].astype(np.float32))

    every = range(len(stored.langs))
    return Model(list(stored.langs), *([[table(k, i, of_context) for i in every] for k in range(1, ORDER + 1)] for of_context in (False, True)), stored.alphabet)


def _levels(counts: DataFrame) -> DataFrame:
    """(lang, k, first, last, value, rest), written: at the highest order the counts of all documents and of those not set aside,
    below it continuation counts of both; unused symbols are 0."""
    level = counts.select("lang", "first", "last", F.col("n").alias("value"), (F.col("n") - F.col("n_aside")).alias("rest"))
    every = [level.withColumn("k", F.lit(ORDER))]
    low, none = F.lit(0xFFFFFFFF), F.lit(0).cast("long")
    for k, first, last in ((3, F.col("first").bitwiseAND(low), F.col("last")), (2, none, F.col("last")), (1, none, F.col("last").bitwiseAND(low))):
        level = level.groupBy("lang", first.alias("first"), last.alias("last")).agg(F.count(F.lit(1)).alias("value"), F.count_if(F.col("rest") > 0).alias("rest"))
        every.append(level.withColumn("k", F.lit(k)))
    return written(reduce(DataFrame.unionByName, every), "levels")


def store(counts: DataFrame) -> tuple[Stored | None, Stored | None]:
    """The models of a count table (lang, first, last, n, n_aside), written: of all counts, and of those without the documents that
    are set aside; None for one without counts."""
    spark = counts.sparkSession
    levels = _levels(counts)
    kinds = ("value", "rest")
    times = lambda c, n: F.count_if(F.col(c) == n).alias(f"{c}_{n}")
    symbol_ = lambda c: F.count_distinct(F.when((F.col("k") == 1) & (F.col(c) > 0), F.col("last"))).alias(f"{c}_symbols")
    rare = levels.groupBy("lang", "k").agg(*(times(c, n) for c in kinds for n in (1, 2)), *(F.max(c).alias(f"{c}_most") for c in kinds)).collect()  # four rows a language
    alphabets = levels.where("k = 1").agg(*map(symbol_, kinds)).first()
    discount = lambda one, two: min(0.9, max(0.1, one / (one + 2 * two) if one + two else 0.5))
    discounts = spark.createDataFrame([(r.lang, r.k, *(discount(r[f"{c}_1"], r[f"{c}_2"]) for c in kinds)) for r in rare], "lang string, k int, value_d double, rest_d double")
    head = F.when(F.col("k") > 2, F.col("first")).otherwise(0), F.when(F.col("k") > 1, F.shiftright("last", 32)).otherwise(0)
    context = Window.partitionBy("lang", "k", *head)  # at most an alphabet of grams
    told = levels.join(F.broadcast(discounts), ["lang", "k"]).withColumn("place", F.row_number().over(context.orderBy("first", "last")))
    for c in kinds:
        told = told.withColumns({f"{c}_total": F.sum(c).over(context), f"{c}_kinds": F.count_if(F.col(c) > 0).over(context)})
    own = lambda c: F.when(F.col(c) > 0, (F.col(c) - F.col(f"{c}_d")) / F.col(f"{c}_total")).cast("float").alias(c)
    back = lambda c: F.when(F.col(f"{c}_total") > 0, F.col(f"{c}_d") * F.col(f"{c}_kinds") / F.col(f"{c}_total")).cast("float").alias(c)
    gram = F.struct(F.lit(False).alias("is_context"), *map(own, kinds))
    weight = F.when(F.col("place") == 1, F.struct(F.lit(True).alias("is_context"), *map(back, kinds)))
    path = shared_path(spark, "language-model")
    told.select("lang", "k", "first", "last", F.explode(F.array_compact(F.array(gram, weight))).alias("x")).select("lang", "k", "x.is_context", "first", "last", "x.value", "x.rest").hint("rebalance").write.parquet(path)
    langs = {c: tuple(sorted({r.lang for r in rare if r[f"{c}_most"] > 0})) for c in kinds}
    return tuple(Stored(path, c, langs[c], 1 + alphabets[f"{c}_symbols"]) if langs[c] else None for c in kinds)


def fit(docs: DataFrame) -> Stored | None:
    """The model of the learnable documents; None if there are none."""
    return store(written(gram_counts(docs), "grams"))[0]


# ---- prediction ----------------------------------------------------------------------------------------------------


def entropies(docs: DataFrame, model: Stored, *keep: str) -> DataFrame:
    """(doc_id, *keep, best, n_symbols, entropy, margin): the best language, its cross-entropy per symbol, and how far the
    next one is; best is null where the text is null or has no letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = opened(model)
        letters = _letters()
        for batch in batches:
            column = batch.column("text")
            for i, j in _text_slices(column):
                texts = [t or "" for t in column.slice(i, j - i).to_pylist()]
                c, document = symbols(texts)
                parts, document = _grams(c, document)
                logs = m.logs(parts)
                lettered = np.bincount(document, letters[parts[-1]], j - i) > 0
                n = np.bincount(document, minlength=j - i)
                total = np.stack([np.bincount(document, logs[:, k], j - i) for k in range(len(m.langs))], 1)
                mean = -total / np.maximum(n, 1)[:, None]
                best = mean.argmin(1)
                two = np.sort(mean, 1)
                margin = two[:, 1] - two[:, 0] if two.shape[1] > 1 else np.ones(len(n))
                name = pa.array([m.langs[b] if ok else None for b, ok in zip(best, lettered, strict=True)], pa.string())
                rest = [batch.column(x).slice(i, j - i) for x in ("doc_id", *keep)]
                yield pa.RecordBatch.from_arrays([*rest, name, pa.array(n), pa.array(two[:, 0]), pa.array(margin)], ["doc_id", *keep, "best", "n_symbols", "entropy", "margin"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.drop("text").schema)
    return chosen.mapInArrow(run, f"{schema}, best string, n_symbols long, entropy double, margin double")


class Calibration(NamedTuple):
    coefficients: tuple[float, float, float]
    most_entropy: dict[str, float]
    least_score: float


def quantiles(rows: DataFrame, by: str, value: str, share: float = USUAL) -> dict[str, float]:
    """The quantile of each group's values, between neighbours in proportion.  A sketch tells from where on to look, what lies below
    is counted, and only what lies beyond, some hundredths of a group, is ordered."""
    marks = rows.groupBy(by).agg(F.count(value).alias("_n"), F.percentile_approx(value, share - 0.015, 10_000).alias("_near"), F.min(value).alias("_least"))
    marks = marks.select(by, "_n", F.when(F.col("_n") < 1000, F.col("_least")).otherwise(F.col("_near")).alias("_from"))  # few: all of them
    marked = rows.join(F.broadcast(marks), by)  # a row a language
    below = marked.groupBy(by, "_n").agg(F.count_if(F.col(value) < F.col("_from")).alias("_below"))
    place = F.lit(share) * (F.col("_n") - 1)
    own = Window.partitionBy(by).orderBy(value)
    tail = marked.where(F.col(value) >= F.col("_from")).select(by, value).withColumn("_own", F.row_number().over(own) - 1).join(F.broadcast(below), by)
    at = lambda k: F.max(F.when(F.col("_below") + F.col("_own") == k, F.col(value)))
    found = tail.groupBy(by, "_n").agg(at(F.floor(place)).alias("low"), at(F.ceil(place)).alias("high"))
    return {x[by]: float(x.value) for x in found.select(by, (F.col("low") + (F.col("high") - F.col("low")) * (place - F.floor(place))).alias("value")).collect()}


def logistic(rows: DataFrame, rounds: int = 30) -> np.ndarray:
    """The weights of (1, margin, length) that tell ``right`` (0 or 1), by Newton's steps with a slight pull to (0, 1, 0): each step is
    one row of sums over all rows."""
    names = ("one", "margin", "length")
    b, start = np.array([0.0, 1.0, 0.0]), np.array([0.0, 1.0, 0.0])
    x = {"one": F.lit(1.0), "margin": F.col("margin"), "length": F.col("length")}
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    for _ in range(rounds):
        z = sum((float(w) * x[n] for w, n in zip(b, names, strict=True)), F.lit(0.0))
        q = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
        judged = rows.select("*", q.alias("q")).withColumn("w", F.greatest(F.col("q") * (1 - F.col("q")), F.lit(1e-6)))
        sums = judged.agg(*(F.sum(F.col("w") * x[names[i]] * x[names[j]]) for i, j in pairs), *(F.sum(x[n] * (F.col("right") - F.col("q"))) for n in names)).first()
        if sums[0] is None:
            return b
        curve = np.zeros((3, 3))
        for (i, j), value in zip(pairs, sums, strict=False):
            curve[i, j] = curve[j, i] = value
        step = np.linalg.solve(curve + 0.1 * np.eye(3), np.array(sums[6:], float) - 0.1 * (b - start))
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    return b


def calibrate(docs: DataFrame, model: Stored, slack: float = 0.5) -> Calibration:
    """The score as a logistic model of (margin, log length), and the limits beyond which a prediction is rejected, from all
    documents that are set aside; ``model`` is one counted without them."""
    found = entropies(learnable(docs).where(aside()), model, "lang").where("best is not null")
    seen = written(found.select("best", "entropy", "margin", F.log1p("n_symbols").alias("length"), (F.col("best") == F.col("lang")).cast("double").alias("right")), "calibration")
    limit = {k: v + slack for k, v in quantiles(seen.where("right = 1"), "best", "entropy").items()}
    return Calibration(tuple(map(float, logistic(seen))), limit, 0.5)


def predicted(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, *keep, held_out, lang_pred, score, entropy, rejected) of every row."""
    model, rest = store(written(gram_counts(docs), "grams"))
    names = [F.col(x) for x in ("doc_id", *keep)]
    if model is None:
        return docs.select(*names, held_out().alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(True).alias("rejected"))
    c = calibrate(docs, rest or model)
    found = entropies(docs, model, *keep)
    a, b, d = c.coefficients
    score = F.when(F.col("best").isNull(), 0.0).otherwise(1 / (1 + F.exp(-(a + b * F.col("margin") + d * F.log1p(F.col("n_symbols"))))))
    limit = F.lit(None).cast("double")
    for lang, most in c.most_entropy.items():
        limit = F.when(F.col("best") == lang, most).otherwise(limit)
    return found.select(
        *names,
        held_out().alias("held_out"),
        F.coalesce("best", F.lit(UNKNOWN)).alias("lang_pred"),
        score.alias("score"),
        "entropy",
        (F.col("best").isNull() | (score < c.least_score) | F.coalesce(F.col("entropy") > limit, F.lit(False))).alias("rejected"),
    )


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents."""
    return predicted(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score", "rejected")
