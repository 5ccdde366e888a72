"""Ranked search against scores of all pairs in plain Python."""

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest

from attesta.llm import search

DATA = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(SMALL))


def brute(docs, items, k=10):
    """(item_id, rank, doc_id, score) of each item's best documents; rows are documents, also of one doc_id."""
    held = [(d, Counter(terms(t))) for d, t in docs]
    n, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for i, text in items:
        own = set(terms(text))
        scores = []
        for d, c in held:
            size = sum(c.values())
            m = 100 - 90 + (90 * size * n) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return Counter(out)


def made(seed, n, vocabulary, length):
    r = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [(i, " ".join(r.choices(vocabulary, weights, k=r.randint(*length)))) for i in range(n)]


VOCABULARY = [f"{a}{b}" for a in ("wo", "Ra", "ñe", "été", "x9", "中") for b in ("", "ta", "Lin", "zzzzzzzzzzzzzzzzzzzz", "Ü", "_k", "-m", "é")]


@pytest.fixture(scope="module")
def odd(spark):
    docs = made(1, 150, VOCABULARY, (0, 60))
    docs += [(3, docs[3][1]), (3, docs[3][1]), (7, docs[9][1]), (None, docs[4][1]), (None, None), (200, None), (201, ""), (202, " .,- "), (203, "wo " * 30_000), (204, "中" * 40_000), (205, "zzzzzzzzzzzzzzzzzzzzzzzzzz longest")]
    items = made(2, 25, VOCABULARY, (1, 12)) + [(50, None), (51, ""), (52, "..."), (53, "absent words only"), (4, "ra RA Ra"), (4, "ra RA Ra"), (None, "wo wota"), (54, "中" * 40_000), (55, "K k K")]
    rows = [(d, t, "en", i, [1]) for i, (d, t) in enumerate(docs)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, item_id long, terms array<int>"), spark.createDataFrame(items, "item_id long, text string"), docs, items


@pytest.mark.parametrize(("k", "block"), [(10, search.BLOCK), (3, 15_000)])
def test_all_pairs(odd, k, block):
    docs, items, rows, asked = odd
    got = Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in search.ranked(docs, items, k=k, block=block).collect())
    assert got == brute(rows, asked, k)


def test_empty_tables(odd):
    docs, items, _, _ = odd
    assert search.ranked(docs.where("false"), items).count() == 0
    assert search.ranked(docs, items.where("false")).count() == 0
    assert search.ranked(docs.where("text is null"), items).count() == 0


def test_terms():
    text = "Straße-ÄÖ_x9\tİI\x7f中文\x80a AKK"
    (s,) = search.slices(search.pa.array([text, "", text]))
    q = search.queries([(1, text), (2, "x9 straße")])
    n, row, term, tf = search.counts(q, s)
    name = lambda t: q.data[q.at[t] : q.at[t + 1]].tobytes().decode()
    assert n.tolist() == [len(terms(text)), 0, len(terms(text))]
    for r in (0, 2):
        assert {name(t): c for t, c in zip(term[row == r], tf[row == r], strict=True)} == Counter(terms(text))


def test_equal_hashes_are_told_apart(monkeypatch):
    """Terms of one hash are compared byte by byte."""
    monkeypatch.setattr(search, "span_hashes", lambda data, start, end: np.full(len(start), 5, np.uint64))
    q = search.queries([(1, "alpha")])
    (s,) = search.slices(search.pa.array(["alpha beta alphb alpha alphaa"]))
    _, row, _, tf = search.counts(q, s)
    assert tf.tolist() == [2]


def test_bounds_prune_and_stay_safe():
    """Terms that make no candidates add less than the bound, and no others are left out."""
    r = random.Random(5)
    q = search.queries([(i, " ".join(r.choices([f"t{k}" for k in range(60)], k=12))) for i in range(40)])
    highest = np.array([r.choice([0, r.randint(1, 1000)]) for _ in q.hashes], np.int64)
    least = np.array([r.randint(1, 3000) for _ in q.ids], np.int64)
    p = search.plan(q, highest, least)
    seen = 0
    for i in range(len(q.ids)):
        own = set(q.terms[q.first[i] : q.first[i + 1]].tolist())
        active = {t for t in own if i in p.items[p.first[t] : p.first[t + 1]]}
        idle = own - active
        assert sum(highest[t] for t in idle) == p.rest[i] < least[i]
        if active:
            assert p.rest[i] + min(highest[t] for t in active) >= least[i]
        seen += len(idle)
    assert seen > 100


def test_sums_are_exact():
    r = random.Random(1)
    key, value = np.array([r.randrange(5) for _ in range(2000)]), np.array([r.randrange(1 << 55) for _ in range(2000)], np.int64)
    assert search._sums(key, value, 6).tolist() == [sum(v for k, v in zip(key.tolist(), value.tolist(), strict=True) if k == i) for i in range(6)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_query_equals_sql(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = sorted(map(tuple, search.op11_threshold_seeded_join(spark, DATA).select("item_id", "rank", "doc_id", "score").collect()))
    assert got == sorted(c.execute(search.SQL).fetchall()) and len(got) == 400
