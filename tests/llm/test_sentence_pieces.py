"""Merge rounds against the library, and against one merge at a time on vocabularies of all kinds."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from attesta.llm import sentence_pieces as sp
from attesta.llm import tokens
from attesta.llm.common import slices

TRICKY = ["", " ", "  ", "a", "▁", "▁▁ a", " ▁ ", "<s> a</s><unk> <0x41>", "\x00a\x00", "é 中文😀 \U0001f468‍👩", "a" * 300, "ab" * 150, " " * 50 + "x", "x" + " " * 33, " 　x﻿", "ﬁ ① Å Å", "a\r\n\tb\n\n  c ", "�\U0010ffff"]
TRICKY += [" " * k for k in range(70)] + [" " * k + "the" for k in range(40)] + ["x" + " " * k + "\n" + " " * k for k in range(40)]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sp.model_path())


@pytest.fixture(scope="module")
def tool():
    return sp.PieceEncoder(sp.model_path())


def some_texts(library):
    r = random.Random(4)
    kinds = ["abcdefghijklmnopqrstuvwxyz", "ab \n\t▁éñ中文字1230.,!=-_()<>/\\\x00​ ﬁ①αβγабв", "aab ", "  \n", "=-_", "01"]
    out = ["".join(r.choice(r.choice(kinds)) for _ in range(r.randint(1, 60))) for _ in range(1500)]
    return out + ["".join(library.id_to_piece(r.randrange(3, 32000)) for _ in range(20)) for _ in range(300)]


@pytest.mark.parametrize("most", [1, 300, 1 << 20])
def test_ids_of_the_library(library, tool, most):
    texts = [*TRICKY, *some_texts(library), "word " * 20_000, "x" * 20_000, " " * 30_000 + "a" + " " * 30_000, "中" * 5000, "\U0001f600" * 3000]
    tool._clear()
    for s in slices(pa.array(texts), most):
        ids, first = tool.encode(s)
        for i in range(s.rows):
            assert ids[first[i] : first[i + 1]].tolist() == library.encode(texts[s.start + i])


def test_one_hash_and_few_kept_pieces(library, monkeypatch):
    monkeypatch.setattr(tokens.Encoder, "hashes", staticmethod(lambda s, start, end: ((end - start) % 3).astype(np.uint64)))
    monkeypatch.setattr(tokens, "KEPT_PIECES", 50)
    own, texts = sp.PieceEncoder(sp.model_path()), [*TRICKY, *some_texts(library)[:300]]
    for s in slices(pa.array(texts), 400):
        ids, first = own.encode(s)
        for i in range(s.rows):
            assert ids[first[i] : first[i + 1]].tolist() == library.encode(texts[s.start + i])


def test_decoding(library, tool):
    r = random.Random(3)
    back = sp.Decoder(tool.vocabulary)
    for _ in range(4000):
        ids = [r.choice([r.randrange(2, 32000), r.randrange(3, 259), 28705, 259]) for _ in range(r.randint(0, 8))]
        assert back.decode(ids) == library.decode(ids), ids
    for t in TRICKY:
        assert back.decode(library.encode(t)) == library.decode(library.encode(t))


class Toy(sp.Vocabulary):
    """Pieces over a few letters with random scores: merged symbols may make better pairs than those they came from."""

    def __init__(self, r):
        letters = "abc"
        pieces = {*letters}
        while len(pieces) < 22:
            a, b = r.sample(sorted(pieces), 2) if r.random() < 0.7 else [r.choice(sorted(pieces))] * 2
            if len(a + b) <= 6:
                pieces.add(a + b)
        self.texts = sorted(pieces)
        self.size = len(self.texts)
        self.score = {t: r.choice([r.randint(0, 30), r.randint(0, 5)]) for t in self.texts}
        ids = {t: i for i, t in enumerate(self.texts)}
        self.rank = np.unique([-self.score[t] for t in self.texts], return_inverse=True)[1].astype(np.int32)
        found = {(ids[t[:k]], ids[t[k:]]): ids[t] for t in self.texts for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids}
        keys = np.array([a * self.size + b for a, b in found], np.int64)
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], np.array(list(found.values()), np.int32)[order]

    def one_at_a_time(self, word):
        out = list(word)
        while True:
            best = min(((-self.score[a + b], k) for k, (a, b) in enumerate(zip(out, out[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                return out
            out[best[1] : best[1] + 2] = [out[best[1]] + out[best[1] + 1]]


def test_rounds_equal_one_merge_at_a_time():
    r = random.Random(8)
    for _ in range(150):
        v = Toy(r)
        words = ["".join(r.choice("abc") for _ in range(r.randint(1, 25))) for _ in range(25)] + ["a" * r.randint(1, 30)]
        ids = np.array([v.texts.index(c) for w in words for c in w], np.int32)
        found, count = sp.merge_rounds(v, ids, np.array([len(w) for w in words]))
        parts = np.split(found, np.cumsum(count)[:-1])
        assert [[v.texts[i] for i in p] for p in parts] == [v.one_at_a_time(w) for w in words]
    assert sp.merge_rounds(v, np.zeros(0, np.int32), np.zeros(0, np.int64))[0].tolist() == []


def test_other_models_are_refused(tmp_path, library):
    raw = library.serialized_model_proto()
    settings = dict(sp._fields(raw))[3]
    other = settings.replace(b"\x18\x01", b"\x18\x00")  # no space before the text
    assert other != settings
    (tmp_path / "m.model").write_bytes(raw.replace(settings, other))
    with pytest.raises(ValueError):
        sp.Vocabulary(str(tmp_path / "m.model"))


def test_tables(spark, library):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(3, TRICKY[3]), (3, "other"), (None, "a b"), (900, None), (901, "long text here " * 20_000)]
    df = spark.createDataFrame([(d, t, [1], "x") for d, t in rows], "doc_id long, text string, ids array<int>, n_tokens string")
    want = Counter()
    for d, t in rows:
        ids = library.encode(t or "")
        want[d, len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode(ids).encode())] += 1
    assert Counter(tuple(r) for r in sp.digests(df).collect()) == want
    table = sp.encoded(df)
    assert Counter((r.doc_id, tuple(r.ids)) for r in table.collect()) == Counter((d, tuple(library.encode(t or ""))) for d, t in rows)
    assert Counter((r.doc_id, r.text) for r in sp.decoded(table).collect()) == Counter((d, library.decode(library.encode(t or ""))) for d, t in rows)
    none = df.where("false")
    assert sp.digests(none).count() == sp.decoded(sp.encoded(none)).count() == 0
