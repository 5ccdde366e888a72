"""Personal data by weak supervision: regex, gazetteer and context labelers vote on candidate spans, expectation-maximisation
estimates how reliable each labeler is, and its posteriors train a final span classifier.

Base spans (email, ip, card, phone) are always found and always stay.  Candidates of further kinds become spans only if the
classifier says so.  Ill-formed candidates of the base kinds never do; they are voted on and fitted with the others, as
examples of what looks like personal data and is none.

* Pass 1 counts candidates by (kind, votes, shape); the table of counts is bounded by the code space whatever the corpus
  holds, and covers every document.
* The driver fits a naive Bayes model of the votes by expectation-maximisation on these counts, then a logistic
  classifier on the same cells weighted by count and posterior.
* Pass 2 finds spans again and lets the classifier decide.

All patterns are linear in the length of the text.  Defined results: a null text is empty and has no spans; without
candidates only base spans are returned; places are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import log2
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import documents, texts

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "iban", "national_id", "local_phone", "hidden_email")
KINDS = BASE + ADDED
LABELERS = ("shape", "checksum", "gazetteer", "cue_before", "assigned", "variety")

# ---- fixed values --------------------------------------------------------------------------------------------------
#: Words that stand before personal data, and words that stand before numbers that are not.
CUES = ("mail", "e-mail", "contact", "call", "phone", "tel", "mobile", "fax", "card", "visa", "iban", "account", "ssn", "token", "key", "secret", "password", "passwd", "pwd", "bearer", "ip", "host", "address", "correo", "telefon", "konto")
COUNTER_CUES = ("isbn", "issn", "doi", "version", "page", "section", "figure", "table", "chapter", "order", "part", "commit", "sha", "md5", "hash", "uuid")
#: Beginnings of well-known credentials, card issuers and country codes; endings of mail domains.
CREDENTIALS = ("AKIA", "ASIA", "ghp_", "gho_", "xox", "sk_live_", "sk_test_", "AIza", "eyJ", "glpat-")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35")
COUNTRIES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92")
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "co", "de", "fr", "es", "uk", "it", "nl", "eu", "ch", "at", "us", "ca", "au", "jp", "br", "mx")
# --------------------------------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_HIDDEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(.](?:dot[\])])? ?[A-Za-z0-9-]{1,63}){1,4}")
_ANY_DIGIT = re.compile(r"[0-9]")
_CUE = re.compile(r"\b(?:" + "|".join(map(re.escape, CUES)) + r")\b", re.I)
_COUNTER = re.compile(r"\b(?:" + "|".join(map(re.escape, COUNTER_CUES)) + r")\b", re.I)


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    base: bool


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(x: str) -> str:
    return "".join(c for c in x if "0" <= c <= "9")


def base_matches(text: str) -> list[Span]:
    """Leftmost matches of each base kind that do not overlap within the kind; ``base`` tells those that pass its test."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(Span("email", start, m.end(), True))
            done = m.end()
        at = text.find("@", at + 1)
    if not _ANY_DIGIT.search(text):
        return out
    out += (Span("ip", *m.span(), all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))) for m in _IP.finditer(text))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = _digits(m[0])
            if 12 <= len(d) <= 19:
                out.append(Span("card", *m.span(), luhn(d)))
    out += (Span("phone", *m.span(), 9 <= len(_digits(m[0])) <= 15) for m in _PHONE.finditer(text))
    return out


def candidates(text: str) -> list[Span]:
    """Base matches, passing or not, and matches of the added kinds."""
    out = base_matches(text)
    if "at)" in text or "at]" in text:
        out += (Span("hidden_email", *m.span(), False) for m in _HIDDEN.finditer(text))
    if not _ANY_DIGIT.search(text):
        return out
    out += (Span("secret", *m.span(), False) for m in _SECRET.finditer(text) if _ANY_DIGIT.search(m[0]) and not m[0].replace("-", "").isdigit())
    for kind, pattern in (("iban", _IBAN), ("national_id", _NATIONAL), ("local_phone", _LOCAL_PHONE)):
        out += (Span(kind, *m.span(), False) for m in pattern.finditer(text))
    return out


# ---- votes ---------------------------------------------------------------------------------------------------------


def _shape(s: Span, x: str) -> int:
    if s.kind in BASE:
        return 1 if s.base else -1
    if s.kind == "secret":
        return 1 if re.fullmatch(r"[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[A-Za-z0-9_]{20,}", x) else 0 if re.search("[A-Za-z]", x) else -1
    return 1


def _checksum(s: Span, x: str) -> int:
    if s.kind == "card":
        return 1 if luhn(_digits(x)) else -1
    if s.kind == "ip":
        return 1 if s.base else -1
    if s.kind == "iban":
        y = x.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in y[4:] + y[:4])) % 97 == 1 else -1
    if s.kind == "national_id":
        return -1 if x[:3] in ("000", "666") or x[0] == "9" or x[4:6] == "00" or x[7:] == "0000" else 1
    return 0


def _gazetteer(s: Span, x: str) -> int:
    d = _digits(x)
    if s.kind in ("email", "hidden_email"):
        return 1 if re.split(r"[^A-Za-z0-9-]+", x.rstrip("])"))[-1].lower() in DOMAINS else 0
    if s.kind == "secret":
        return 1 if x.startswith(CREDENTIALS) else 0
    if s.kind == "card":
        return 1 if d.startswith(ISSUERS) else -1
    if s.kind == "phone":
        return 1 if d.startswith(COUNTRIES) else -1
    if s.kind == "ip":
        return -1 if d.startswith(("0", "127")) else 0
    return 0


def votes(s: Span, text: str) -> tuple[int, ...]:
    """Of each labeler: 1 for personal data, -1 against, 0 no opinion."""
    x = text[s.start : s.end]
    before, after = text[max(0, s.start - 32) : s.start], text[s.end : s.end + 1]
    cue = 1 if _CUE.search(before) else -1 if _COUNTER.search(before) else 0
    assigned = 1 if re.search(r"[=:]\s*[\"']?$", before) or before[-1:] in "\"'" and after in "\"'" and before and after else 0
    kinds = len(set(x))
    variety = 1 if kinds >= min(8, len(x) // 2) else -1 if kinds <= 4 else 0
    return _shape(s, x), _checksum(s, x), _gazetteer(s, x), cue, assigned, variety


def cell(s: Span, text: str) -> tuple[int, ...]:
    """What the classifier sees: kind, votes, and the shape of the span (length and share of digits, in four steps each)."""
    x = text[s.start : s.end]
    return KINDS.index(s.kind), *votes(s, text), min(3, max(0, int(log2(max(1, len(x)))) - 2)), min(3, 4 * len(_digits(x)) // max(1, len(x)))


# ---- models --------------------------------------------------------------------------------------------------------


def posterior(cells: np.ndarray, weight: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Probability that each cell is personal data: naive Bayes over the votes, fitted by expectation-maximisation from
    the majority of the votes; the prior is one of each kind, reliabilities are shared."""
    kind, v = cells[:, 0], cells[:, 1 : 1 + len(LABELERS)] + 1
    p = 1 / (1 + np.exp(-1.5 * (v - 1).sum(1)))
    for _ in range(rounds):
        prior = np.array([(1 + (weight * p)[kind == k].sum()) / (2 + weight[kind == k].sum()) for k in range(len(KINDS))])
        score = np.log(prior[kind]) - np.log(1 - prior[kind])
        for j in range(v.shape[1]):
            for value in range(3):
                at = v[:, j] == value
                yes, no = (1 + (weight * p)[at].sum()) / (3 + (weight * p).sum()), (1 + (weight * (1 - p))[at].sum()) / (3 + (weight * (1 - p)).sum())
                score[at] += np.log(yes) - np.log(no)
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return p


def features(cells: np.ndarray) -> np.ndarray:
    """One column for each value of each part of a cell, and a constant."""
    sizes = [len(KINDS), *[3] * len(LABELERS), 4, 4]
    shifted = cells + np.array([0, *[1] * len(LABELERS), 0, 0])
    return np.concatenate([np.eye(n)[shifted[:, i]] for i, n in enumerate(sizes)] + [np.ones((len(cells), 1))], 1)


def classifier(cells: np.ndarray, weight: np.ndarray, p: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Coefficients of a logistic model of the posteriors, by damped Newton steps."""
    x = features(cells)
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        gradient = x.T @ (weight * (p - q)) - ridge * b
        hessian = (x * (weight * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(hessian, gradient)
        b += step * min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
    return b


_CELL = ["kind", *LABELERS, "length_step", "digit_step"]


def counted_cells(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells of all candidates of all documents, and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[tuple[int, ...]] = Counter()
        for batch in batches:
            for text in batch.column("text"):
                t = text.as_py()
                found.update(cell(s, t) for s in candidates(t))
        rows = [(*k, n) for k, n in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(_CELL) + 1)], [*_CELL, "n"])

    schema = ", ".join(f"{c} long" for c in [*_CELL, "n"])
    # at most 9 * 3**6 * 16 rows reach the driver
    rows = texts(docs).mapInArrow(run, schema).groupBy(*_CELL).agg(F.sum("n").alias("n")).orderBy(*_CELL).toPandas()
    return rows[_CELL].to_numpy(np.int64).reshape(-1, len(_CELL)), rows["n"].to_numpy(float)


class Model(NamedTuple):
    coefficients: np.ndarray
    threshold: float

    def accepts(self, cells: list[tuple[int, ...]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(np.array(cells)) @ self.coefficients, -30, 30))) >= self.threshold


def fit(docs: DataFrame, threshold: float = 0.5) -> Model:
    cells, weight = counted_cells(docs)
    return Model(classifier(cells, weight, posterior(cells, weight)) if len(cells) else np.zeros(features(np.zeros((1, len(_CELL)), int)).shape[1]), threshold)


def spans(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start, then kind as listed.  An added span never overlaps another one."""
    found = candidates(text)
    base = sorted((s for s in found if s.base), key=lambda s: (s.start, KINDS.index(s.kind)))
    rest = [s for s in found if s.kind in ADDED]
    if rest:
        keep = model.accepts([cell(s, text) for s in rest])
        starts, ends = [], []  # of stretches that base spans cover
        for s in base:
            if ends and s.start < ends[-1]:
                ends[-1] = max(ends[-1], s.end)
            else:
                starts.append(s.start)
                ends.append(s.end)
        added, end = [], 0
        for s in sorted((s for s, k in zip(rest, keep, strict=True) if k), key=lambda s: (s.start, s.start - s.end, KINDS.index(s.kind))):
            i = bisect_left(starts, s.end) - 1  # the last stretch that begins before its end
            if s.start >= end and (i < 0 or ends[i] <= s.start):
                added.append(s)
                end = s.end
        return base, sorted(base + added, key=lambda s: (s.start, KINDS.index(s.kind)))
    return base, base


def _written(found: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in found)


def found_spans(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                base, every = spans(text.as_py(), model)
                kinds = Counter(s.kind for s in base)
                rows.append((*(kinds[k] for k in BASE), hashlib.sha256(_written(base).encode()).hexdigest(), _written(every), len(every)))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans"])

    return texts(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def masked_text(text: str, found: list[Span]) -> str:
    """``text`` with each stretch of spans replaced by the kind of its first one, as in <EMAIL>."""
    out, done, end = [], 0, -1
    for s in found:
        if s.start >= end:
            out += [text[done : s.start], f"<{s.kind.upper()}>"]
        end = max(end, s.end)
        done = end
    return "".join([*out, text[done:]])


def masked(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with all its columns, personal data in ``text`` masked and ``n_chars`` (if there) counted again; null stays null."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [None if (t := x.as_py()) is None else masked_text(t, spans(t, model)[1]) for x in batch.column(place)]
            yield batch.set_column(place, "text", pa.array(new, batch.schema.field(place).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op2_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents."""
    docs = documents(spark, sf_dir)
    return found_spans(docs, fit(docs))
