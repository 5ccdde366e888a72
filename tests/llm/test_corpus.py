"""The corpus operators against brute force, on odd small tables and on the smallest test tables."""

import hashlib
import html.parser
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attesta.llm import decontamination, language, near_duplicates, packing, pages, personal, quality, sharding, suffix_dedup, token_files, tokens
from attesta.llm.common import importable, same_spans, slices, span_hashes
from attesta.llm.components import components
from attesta.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")

WORDS = ["alpha", "beta", "gamma", "delta", "ñandú", "été", "über", "of", "the", "x,", "end.\nNew", "a\tb", "中文", "1,2"]


def random_docs(seed=3, n=70):
    r = random.Random(seed)
    make = lambda k: " ".join(r.choice(WORDS) for _ in range(k))
    shared = [make(30) for _ in range(4)]
    out = []
    for i in range(n):
        t = " ".join(r.choice([make(r.randint(1, 40)), r.choice(shared), "a" * r.randint(0, 130), make(3) + "  "]) for _ in range(r.randint(0, 4)))
        out.append((r.choice([i, i, i, i, i // 3]), r.choice([t, t, t, t, out[-1][1] if out else t, ""])))
    out += [(500, None), (None, "a text without an id " * 9), (None, None), (501, ""), (502, "   \n\t "), (503, "word " * 60_000), (504, "x" * 50_000), out[5], out[5]]
    return out


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with those of the operators."""
    rows = [(d, t, "en" if i % 3 else None, "src", None if t is None else len(t), i, "c", [1]) for i, (d, t) in enumerate(random_docs())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long, row string, bands array<int>")


@pytest.fixture(scope="module")
def empty(spark, odd):
    return spark.createDataFrame([], odd.schema)


def plain(odd):
    return [(r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()]


def test_batches_are_held_to_a_size(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    kept = spark.conf.get(name)
    try:
        for given, want in (("64m", "8388608b"), ("1m", "1m")):
            spark.conf.set(name, given)
            importable(spark)
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, kept)


# ---- 5: shards -----------------------------------------------------------------------------------------------------


def brute_shards(rows, k=40):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len(r[1].encode()) + 16, zlib.crc32(r[1].encode())))
    total, before, counts, out = sum(len(t.encode()) + 16 for _, t in order), 0, Counter(), []
    for d, t in order:
        size = len(t.encode()) + 16
        shard = min(k - 1, (2 * before + size) * k // (2 * total))
        out.append((d, size, zlib.crc32(t.encode()), shard, counts[shard]))
        counts[shard] += 1
        before += size
    return out


def test_shards(odd, empty):
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = sorted((tuple(r) for r in sharding.balanced_shards(odd, pieces=7).collect()), key=key)
    assert got == sorted(brute_shards(plain(odd)), key=key)
    assert sharding.balanced_shards(empty).count() == 0


# ---- 7: quality ----------------------------------------------------------------------------------------------------


def brute_counts(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_statistics(spark, odd, empty):
    names = quality.COUNTS[:5]
    got = Counter((r.doc_id, *(r[c] for c in names)) for r in quality.statistics(odd).collect())
    assert got == Counter((d, *brute_counts(t)) for d, t in plain(odd))
    lines = ["a\n\na\n", "x # b\nx # b\n x # b", "\n\n", "é <b>\r\né <b>\r\n", ("one two three four five six seven eight nine " * 3).strip()]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r.doc_id: tuple(r[c] for c in names) for r in quality.statistics(df).collect()} == {i: brute_counts(t) for i, t in enumerate(lines)}
    assert quality.statistics(empty).count() == 0


def test_lines_that_a_polynomial_takes_as_equal():
    """The Thue-Morse word and its complement have one hash under every polynomial modulo 2**64."""
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(4096))
    two = one.translate(str.maketrans("ab", "ba"))
    for sep in ("\n", " \n"):
        (s,) = slices(pa.array([f"{one}{sep}{two}{sep}{one}"]), 1 << 20)
        assert quality.counts(s)["n_dup_lines"].tolist() == [brute_counts(f"{one}{sep}{two}{sep}{one}")[3]]
    data = np.frombuffer((one + two).encode(), np.uint8)
    at = np.array([0, 4096, 0])
    h = span_hashes(data, at, np.array([4096, 8192, 4096]))
    assert h[0] != h[1] and h[0] == h[2]


def test_span_hashes():
    """Equal spans agree and others don't, at any place and length."""
    r = random.Random(2)
    data = np.frombuffer(bytes(r.choice(b"ab") for _ in range(300)), np.uint8)
    start = np.array([r.randint(0, 280) for _ in range(4000)])
    end = np.array([min(300, s + r.randint(0, 20)) for s in start])
    of = defaultdict(set)
    for a, b, h in zip(start, end, span_hashes(data, start, end), strict=True):
        of[data[a:b].tobytes()].add(int(h))
    assert all(len(x) == 1 for x in of.values()) and len(set().union(*of.values())) == len(of)
    pick = np.array([r.randrange(4000) for _ in range(4000)])
    same = [data[a:b].tobytes() == data[c:d].tobytes() for a, b, c, d in zip(start, end, start[pick], end[pick], strict=True)]
    assert same_spans(data, start, end, data, start[pick], end[pick]).tolist() == same


def test_rules(spark, odd, empty):
    r = random.Random(1)
    good = [(i, " ".join(r.choice("abcdefgh") * r.randint(2, 9) + str(r.randint(0, 99)) for _ in range(60)), 1) for i in range(120)]
    bad = [(i, " ".join("junk### $$$" for _ in range(40)), 0) for i in range(120, 160)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(None, 0), (1, None), (9999, 0)], "doc_id long, quality int")
    kept = {x.doc_id: x.kept for x in quality.judged(docs, labels).collect()}
    assert kept == {i: q == 1 for i, _, q in good + bad}
    assert sorted(x.doc_id for x in quality.accepted(docs, labels).collect()) == list(range(120))
    # without usable labels the base test decides
    none = labels.where("false")
    assert quality.judged(odd, none).where("kept = base_failed").count() == 0
    out = quality.accepted(odd, none)
    assert out.columns == odd.columns
    assert out.count() == quality.judged(odd, none).where("kept").count()
    assert quality.judged(empty, labels).count() == quality.accepted(empty, labels).count() == 0


def test_learning_is_greedy_and_pruned():
    rng = np.random.default_rng(0)
    x = rng.random((600, len(quality.RATIOS)))
    bad = (x[:, 0] > 0.7) & (x[:, 2] <= 0.4)
    rules = quality.learn(x, bad)
    hit = np.zeros(len(x), bool)
    for rule in rules:
        hit |= quality._holds(rule, x)
    assert (hit == bad).mean() > 0.97
    assert quality.learn(x, np.zeros(600, bool)) == []


# ---- 8, 10: tokens -------------------------------------------------------------------------------------------------

TRICKY = ["", "  a  b ", "don't it's 'street,x' A   b  \n\n x\n y ", "　x ퟿   a 1,2.3 ##$% $5 -- é,è ñ'll \x1c \x85 \x00,\x00", "<|endoftext|> a<|endoftext|>", "a <|endoftext|> b", "a  <|endoftext|>  b\n<|endoftext", "x<|endo", "ftext|>", " ", "\n a", "x  ,y '  's", "a b  c", "中文 字 。 x"]


def reference_ids(t, tool=[]):  # noqa: B006
    if not tool:
        from tokenizers import Tokenizer

        tool.append(Tokenizer.from_file(tokens.tokenizer_path()))
    return tool[0].encode(t, add_special_tokens=False).ids


def test_encoder():
    texts = [*TRICKY, *(t for _, t in random_docs() if t and len(t) < 5000)]
    tool = tokens.Encoder(tokens.tokenizer_path())
    for s in slices(pa.array(texts), 300):
        ids, first = tool.encode(s)
        for i in range(s.rows):
            assert ids[first[i] : first[i + 1]].tolist() == reference_ids(texts[s.start + i])


def test_encoder_tells_pieces_of_one_hash_apart(monkeypatch):
    """Every piece has the same hash: ids are still those of the library, from kept pieces and from others."""
    monkeypatch.setattr(tokens.Encoder, "hashes", staticmethod(lambda s, start, end: ((end - start) % 3).astype(np.uint64)))
    texts = [*TRICKY, *(t for _, t in random_docs() if t and len(t) < 5000), "a" * 400 + " b" + "c" * 300, "abcdefgh_x_ijklmnop abcdefgh_y_ijklmnop"]
    tool = tokens.Encoder(tokens.tokenizer_path())
    for s in slices(pa.array(texts * 2), 300):
        ids, first = tool.encode(s)
        for i in range(s.rows):
            assert ids[first[i] : first[i + 1]].tolist() == reference_ids((texts * 2)[s.start + i])


def test_encoder_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_PIECES", 20)
    tool = tokens.Encoder(tokens.tokenizer_path())
    texts = [t for _, t in random_docs() if t and len(t) < 5000]
    for s in slices(pa.array(texts), 200):
        ids, first = tool.encode(s)
        assert [ids[first[i] : first[i + 1]].tolist() for i in range(s.rows)] == [reference_ids(t) for t in texts[s.start : s.stop]]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(odd, empty):
    rows = packing.pieces(odd, length=256, with_ids=True).collect()
    assert all(r.ids_crc32 == crc(r.ids) and r.length == len(r.ids) <= 256 for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    last = max(by)
    for k, part in by.items():
        part.sort(key=lambda r: r.offset)
        assert [r.offset for r in part] == np.concatenate([[0], np.cumsum([r.length for r in part])[:-1]]).tolist()
        assert k == last or sum(r.length for r in part) == 256
    assert sorted(by) == list(range(last + 1))
    # whole documents again, in order of the line
    line, docs = sorted(rows, key=lambda r: (r.sequence_id, r.offset)), []
    for r in line:
        if r.start == 0:
            docs.append((r.doc_id, []))
        assert r.start == len(docs[-1][1])
        docs[-1][1].extend(r.ids)
    want = Counter((d, crc([*reference_ids(t), 1])) for d, t in plain(odd))
    assert Counter((d, crc(i)) for d, i in docs) == want
    assert packing.pieces(empty).count() == 0
    whole = packing.sequences(odd, length=256).collect()
    assert {r.sequence_id: len(r.ids) for r in whole} == {k: sum(x.length for x in v) for k, v in by.items()}


@pytest.mark.parametrize("size", [64 << 20, 3000])
def test_token_files(spark, odd, empty, monkeypatch, size):
    monkeypatch.setattr(token_files, "SHARD_BYTES", size)
    # the doc_id whose mixed value is 0, as is the null key's
    clash = odd.limit(1).withColumn("doc_id", F.lit(0).cast("long"))
    odd = odd.union(clash)
    files = token_files.TokenFiles.write(odd)
    got = sorted((tuple(r) for r in files.get(odd).collect()), key=lambda r: r[1])
    start, want = 0, []
    for d, t in sorted(plain(odd), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())):
        ids = [*reference_ids(t), 0]
        want.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    for shard in files.bases:  # rows one by one, and ids a few at a time, are the same
        with token_files._In(f"{files.folder}/shard-{shard:05d}.docs") as f, token_files._In(f"{files.folder}/shard-{shard:05d}.bin") as g:
            row = np.arange(0, int(f.array("<u8", 1, 0)[0]), 2)
            whole = token_files._spans(f, row)
            ids = [x.tolist() for x in token_files._payloads(g, 2, *whole[2:])]
            with monkeypatch.context() as m:
                m.setattr(token_files, "SPARSE", 0)
                m.setattr(token_files, "READ_BYTES", 100)
                assert [x.tolist() for x in token_files._spans(f, row)] == [x.tolist() for x in whole]
                assert [x.tolist() for x in token_files._payloads(g, 2, *whole[2:])] == ids
    absent = spark.createDataFrame([(10**6,), (-1,), (7,)], "doc_id long")
    assert {r.doc_id for r in files.get(absent).collect()} <= {7}
    assert files.get(spark.createDataFrame([(501,)], "doc_id long"), with_ids=True).first().ids == [0]
    nulls = files.get(spark.createDataFrame([(None,)], "doc_id long")).collect()
    assert len(nulls) == odd.where("doc_id is null").count() and {r.doc_id for r in nulls} == {None}
    without = token_files.TokenFiles.write(odd.where("doc_id is not null"))
    assert without.get(spark.createDataFrame([(None,)], "doc_id long")).count() == 0
    assert token_files.TokenFiles.write(empty).get(empty).count() == 0


def test_look_up_reads_little(spark, tmp_path):
    """One key's look-up reads a few dozen bytes of its index part, and only its span of the shard."""
    keys = np.unique(np.random.default_rng(2).integers(0, 2**63, 100_000).astype(np.uint64))
    path = tmp_path / "index-00000.mph"
    path.write_bytes(token_files._index_bytes(keys, keys % np.uint64(7), np.arange(len(keys)), np.ones(len(keys), int)))
    read = 0

    class Counted(token_files._In):
        def array(self, kind, n, at):
            nonlocal read
            read += n * np.dtype(kind).itemsize
            return super().array(kind, n, at)

    token_files._In, kept = Counted, token_files._In
    try:
        held = token_files._held(str(path), keys[500:501])
    finally:
        token_files._In = kept
    assert held["row"].tolist() == [500] and held["shard"].tolist() == [int(keys[500] % np.uint64(7))]
    assert read < 1000


def test_perfect_hash():
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
        tool = token_files.PerfectHash.of(token_files.PerfectHash.build(keys))
        assert sorted(tool.slots(keys).tolist()) == list(range(len(keys)))


# ---- 2: personal data ----------------------------------------------------------------------------------------------

PERSONAL = [
    "mail a.b@c.de@x.yz or john.doe+1@mail.example.com, 1.2.3.4.5 and 256.1.1.1 or 10.0.0.1x", "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 79927398713", "+1 (017) 555-7713 +12 +1(2", "@@a@b@c.d.e..f",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end', "name [at] example [dot] com", "DE89 3704 0044 0532 0130 00 and 078-05-1120", "1" * 3000 + "." + "2" * 3000, "", "é" * 5 + " x@y.zz",
]


def brute_base(t):
    def card(x):
        d = [int(c) for c in re.sub("[^0-9]", "", x)]
        return 12 <= len(d) <= 19 and sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(reversed(d))) % 10 == 0

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", card),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(re.sub("[^0-9]", "", x)) <= 15),
    }
    found = [(m.start(), k, m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, t) if ok(m[0])]
    found.sort(key=lambda x: (x[0], list(kinds).index(x[1])))
    return [f"{k}:{a}:{b}" for a, k, b in found]


def test_base_spans(spark, odd, empty):
    r = random.Random(2)
    noise = ["".join(r.choice("ab1.@+ -()2") for _ in range(r.randint(0, 60))) for _ in range(400)]
    for t in PERSONAL + noise:
        got = sorted((s for s in personal.base_matches(t) if s.base), key=lambda s: (s.start, personal.KINDS.index(s.kind)))
        assert [f"{s.kind}:{s.start}:{s.end}" for s in got] == brute_base(t), t
    docs = spark.createDataFrame(list(enumerate(PERSONAL)), "doc_id long, text string")
    model = personal.fit(docs)
    for x in personal.found_spans(docs, model).collect():
        base = brute_base(PERSONAL[x.doc_id])
        assert x.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(x.spans.split(",")) or not base
    assert "secret:9:49" in personal.found_spans(docs, model).where("doc_id = 4").first().spans
    assert personal.found_spans(odd, personal.fit(odd)).count() == odd.count()
    assert personal.found_spans(empty, personal.fit(empty)).count() == 0


def test_added_spans_overlap_nothing():
    r = random.Random(7)
    every = personal.Model(np.concatenate([np.zeros(personal.features(np.zeros((1, 9), int)).shape[1] - 1), [9.0]]), 0.5)  # accepts all
    for _ in range(200):
        t = " ".join(r.choice(["123-45-6789", "(212) 555-0100", "a1B2" * 6, "x@y.org", "joe [at] ex.com", "DE44 5001 0517 5407 3249 31", "+1 212 555 0100", "4111 1111 1111 1111", "w"]) for _ in range(r.randint(0, 12)))
        base, found = personal.spans(t, every)
        want = list(base)
        for s in sorted((s for s in personal.candidates(t) if s.kind in personal.ADDED), key=lambda s: (s.start, s.start - s.end, personal.KINDS.index(s.kind))):
            if all(s.end <= x.start or x.end <= s.start for x in want):
                want.append(s)
        assert found == sorted(want, key=lambda s: (s.start, personal.KINDS.index(s.kind)))
    assert len(personal.spans("123-45-6789 x@y.org " * 20_000, every)[1]) == 40_000  # linear


def test_masking(spark, odd):
    docs = spark.createDataFrame([(1, "é a@b.cc x", 10), (2, None, None)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in personal.masked(docs, personal.fit(docs)).orderBy("doc_id").collect()] == [(1, "é <EMAIL> x", 11), (2, None, None)]
    out = personal.masked(odd, personal.fit(odd))
    assert out.schema == odd.schema and out.count() == odd.count()


def test_reliabilities_follow_the_votes():
    rng = np.random.default_rng(4)
    truth = rng.random(3000) < 0.4
    vote = lambda p: np.where(rng.random(3000) < p, np.where(truth, 1, -1), np.where(truth, -1, 1))
    cells = np.stack([np.zeros(3000, int), vote(0.95), vote(0.9), vote(0.85), vote(0.5), vote(0.8), vote(0.5), np.zeros(3000, int), np.zeros(3000, int)], 1)
    p = personal.posterior(cells, np.ones(3000))
    assert ((p > 0.5) == truth).mean() > 0.95
    q = 1 / (1 + np.exp(-personal.features(cells) @ personal.classifier(cells, np.ones(3000), p)))
    assert ((q > 0.5) == truth).mean() > 0.95


# ---- 3: pages ------------------------------------------------------------------------------------------------------

SHELL = '<!doctype html><html><head><title>t</title><style>p{{}}</style><script>var x="<p>no</p>";</script></head><body><div class="site-header">Site</div><ul class="nav-menu"><li><a href="/">Home</a></ul><!-- <p>no</p> --><div class="content"><h2>{head}</h2><div class="post-body">{body}</div><div class="share">Share</div></div><div id="comments"><p>reader says</p></div><div class="cookie-notice">We use cookies</div><footer>f</footer></body></html>'


def test_page_kinds():
    both = lambda p: pages.main_text(p, None)[0]
    assert both("<nav>n</nav><article><h1>A &amp; b&#233;</h1><p>one\n two<p>three<aside>no</aside><form>no<input></form></article><p>out") == "A & bé\none two\nthree"
    assert both("<main><header>no? yes inside</header><p>x</p></main><header>site</header>").endswith("x")
    assert both("<article><p>a<b>b</b> c<br>d<ul><li>e<li>f</ul><script>no") == "ab c\nd\ne\nf"
    assert both("<article><p>cut <b>of") == "cut of"
    assert both("<article><p>cut <a hre") == "cut"
    assert both("") == both("<p></p>") == ""
    assert both(SHELL.format(head="Title", body="<p>First long paragraph of text here.</p><p>Second &lt;one&gt;.</p>")) == "Title\nFirst long paragraph of text here.\nSecond <one>."


def test_templates(spark):
    r = random.Random(8)
    bodies = ["".join(f"<p>{' '.join(r.choice(WORDS) for _ in range(25))}</p>" for _ in range(r.randint(2, 5))) for _ in range(40)]
    rows = [(i, f"http://h{i % 2}.example/{i}", SHELL.format(head=f"Head {i}", body=b), "x") for i, b in enumerate(bodies)] + [(None, None, None, "x"), (99, "no url", "<p>alone</p>", "x"), (99, "no url", "<p>alone</p>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = pages.extracted(df).collect()
    assert len(out) == len(rows)
    got = {x.page_id: x for x in out}
    for i, b in enumerate(bodies):
        assert got[i].text == "\n".join([f"Head {i}", *(" ".join(p.split()) for p in re.findall("<p>(.*?)</p>", b, re.S))])
        assert got[i].by_template and got[i].n_chars == len(got[i].text)
    assert (got[None].text, got[99].text) == ("", "alone")
    assert pages.extracted(spark.createDataFrame([], df.schema)).count() == 0


def brute_template(htmls):
    """The template of a host's pages from explicit occurrence vectors."""
    seen = [pages.occurrences(h) for h in htmls]
    classes = defaultdict(set)
    for t in {t for s in seen for t in s.tokens if t}:
        vector = tuple(s.tokens[t][0] if t in s.tokens else 0 for s in seen)
        support = sum(v > 0 for v in vector)
        if support >= max(2, len(htmls) / 2):
            classes[vector].add(t)
    slots, frequent = set(), set().union(*classes.values())
    for vector, names in sorted(classes.items(), key=lambda x: (-sum(v > 0 for v in x[0]), min(t.count("/") for t in x[1]))):
        up = {t.rpartition("/")[0] for t in names}
        if len(names) > 1 and set(vector) <= {0, 1} and up <= slots | names | {""}:
            slots |= names
    texts = defaultdict(set)
    for s in seen:
        for t, (beside, *_) in s.texts.items():
            texts[t].add(beside)
    least = max(3, len({s.whole for s in seen}) / 2)
    constant = {t for t, b in texts.items() if len(b) >= least}
    mass = Counter(slots)
    for t in slots:  # running text below a slot that isn't constant
        found = [b for h in htmls for b in pages.blocks(h) if not b.gone and "/".join(b.path + ("",)).startswith(t + "/")]
        mass[t] = sum(len(b.text) - b.links for b in found if pages.text_at(b)[0] not in constant or "/".join(b.path) not in frequent)
    gone = {t for t in slots if 2 * sum(t in s.tokens and s.tokens[t][2] for s in seen) >= sum(t in s.tokens for s in seen)}
    some = {t: m for t, m in mass.items() if t not in gone and pages._name(t) not in ("p", "li", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6")}
    best = max(some.values(), default=0)
    of = [t for t, m in some.items() if best and m >= pages.MASS * best]
    main = max(of, key=lambda t: ({"article": 2, "main": 1}.get(pages._name(t), 0), t.count("/"), some[t], t), default=None)
    return main, constant


def test_templates_equal_explicit_vectors(spark):
    r = random.Random(5)
    rows, want = [], {}
    for h in range(30):
        parts = [f'<div class="{r.choice("abcde")}"><p>{r.choice(["same", f"t{r.randint(0, 9)}"])}</div>' for _ in range(6)]
        n = r.randint(1, 9)
        made = []
        for _ in range(n):
            body = "".join(p for p in parts if r.random() < 0.8)
            tag = r.choice(["article", "div", "main"])
            made.append(f"<html><body><div class=top><p>{'notice ' * r.choice([3, 80])}</div>{body}<{tag}><p>{' '.join(r.choice(WORDS) for _ in range(r.randint(1, 30)))}</{tag}></body></html>")
        made += r.choice([[], made[:2]])  # equal pages
        rows += [(f"http://h{h}.example/{i}", m) for i, m in enumerate(made)]
        want[f"h{h}.example"] = brute_template(made)
    got = {x.host: (x.main, set(x.constant)) for x in pages.templates(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got == {h: v for h, v in want.items() if v[0] is not None}


def test_templates_decide(spark):
    """A template tells where the text is also without article elements; it finds constant texts of any length, and no teaser."""
    r = random.Random(12)
    text = lambda k: " ".join(r.choice(WORDS).strip() for _ in range(k)).replace("\n", " ").replace("\t", " ")
    notice, rows, want = "we tell everyone this " * 60, [], {}
    for i in range(24):
        a, b = text(40), text(60)
        tag = ("article", "div")[i % 2]
        own = f'<div class=top><h1>H{i}</h1></div><{tag} class=body><p>{a}</p><div class=x>{notice}</div><p>{b} <span class="advert">buy {"now " * r.choice([1, 900])}</span></p></{tag}>'
        if i % 2:
            own += "<article><p>Teaser</p></article>"
        rows.append((i, f"http://{tag}.example/{i}", f"<html><body><ul class=menu><li>m</ul>{own}<footer>f</footer></body></html>"))
        want[i] = (a, b)
    rows += [(100 + i, "http://article.example/copy", rows[0][2]) for i in range(30)]  # copies of one page
    got = {x.page_id: x for x in pages.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, (a, b) in want.items():
        assert got[i].by_template
        assert [x for x in got[i].text.split("\n") if x != f"H{i}"] == [" ".join(a.split()), " ".join(b.split())], (i, got[i].text[:300])
    assert {got[100 + i].text for i in range(30)} == {got[0].text}
    long = "<div><p>" + "word " * 300 + "</p></div>"
    assert pages.main_text(f"<body><div class=content>{long}</div><article><p>Teaser</p></article></body>", None)[0] == ("word " * 300).strip()


RUNNING = ("Some running text of the article that goes on for a while. " * 5).strip()


@pytest.mark.parametrize(
    "page",
    [
        '<div id="page" class="site no-sidebar"><article><p>{}</p></article></div>',
        '<div class="content has-sidebar"><article><p>{}</p></article><div class=sidebar><p>x y</p></div></div>',
        '<div class="content has-sidebar"><p>{}</p></div><div class=sidebar><p>x y</p></div>',
        '<form id="aspnetForm" action="/"><div><p>{}</p></div><footer>f</footer></form>',
        '<div class="sidebar"><div><p>{}</p></div></div><footer>f</footer>',
        '<div role="form"><main><p>{}</p></main></div>',
        '<div class="modal"><article><p>{}</p></article></div>',
        '<article><p title="a hidden gem">{}</p></article>',
        '<article><p title="class=ad">{}</p></article>',
        '<article><div data-id="sidebar" data-hidden><p>{}</p></div></article>',
        '<div><article><p>{}</p></article><div id="sidebar" width="100"><p>no</p></div></div>',
        "<div><article><p>{}</p></article><div id='sidebar' id='main' class=x><p>no</p></div></div>",
        '<article><p class="share-price">{}</p></article>',
        '<article><p class="form-of-life">{}</p></article>',
        '<article><div class="search-results"><p id="related-work">{}</p></div></article>',
        '<article><p>{}</p></article><div id="comments"><article class="comment-body"><p>reader reader</p></article></div>',
        '<div class=body><p>{}</p></div><div id=comments><p>' + "a reader says " * 300 + "</p></div>",
        '<article><p>{}</p></article><section class="comment-list"><article><p>' + "a reader says " * 300 + "</p></article></section>",
        '<article><p>{}</p><div class="ad"><p>' + "buy this " * 300 + "</p></div></article>",
        '<div class="ad"><article><p>advert</p></article></div><article><p>{}</p></article>',
        '<article><p>{}</p><div class="cookie-notice">We use cookies</div><ul class="nav-menu"><li>m</ul><div class="sidebarLeft">x</div></article>',
        '<article><p>{}</p><p hidden>h</p><p aria-hidden = "true">h</p><p style="display: none">h</p></article>',
    ],
)
def test_marks_are_evidence(page):
    assert pages.main_text(page.format(RUNNING), None)[0] == RUNNING


def test_marked_words_in_a_sentence_stay():
    text = lambda p: pages.main_text(f"<article><p>{RUNNING}</p><p>{p}</p></article>", None)[0].split("\n")[1]
    assert text('a <span class="menu-item">b</span> c') == "a b c"
    assert text('a <a title="Hidden treasures" href=x>b</a> c') == "a b c"
    assert text('a <em class="share-price">b</em> <i id="form-of-life">c</i>') == "a b c"
    assert text('a <span class="advert">b</span> c') == "a c"


def test_attributes():
    assert pages.attributes(' CLASS="a b" id=x/y  hidden data-id=\'q"q\' title = "id=5 class=z" class=second checked/') == {"class": "a b", "id": "x/y", "hidden": "", "data-id": 'q"q', "title": "id=5 class=z", "checked": ""}
    assert pages.attributes("") == pages.attributes("  / ") == {}
    assert pages.attributes('title="a &amp; b" width=100') == {"title": "a & b", "width": "100"}


class Parsed(html.parser.HTMLParser):
    """Text of the one article of a page, by an independent parser: blocks end at block elements and at line breaks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.off, self.lines, self.line = 0, 0, [], []

    def _end(self):
        if text := " ".join("".join(self.line).split()):
            self.lines.append(text)
        self.line = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "aside", "nav") or dict(attrs).get("class") == "ad":
            self.off += 1
        if tag in pages.BLOCKS or tag == "br":
            self._end()
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        if tag in pages.BLOCKS:
            self._end()
        self.inside -= tag == "article"
        self.off -= tag in ("script", "style", "aside", "nav")

    def handle_data(self, data):
        if self.inside and not self.off:
            self.line.append(data)


def test_pages_equal_another_parser():
    r = random.Random(21)
    words = [*WORDS, "&amp;", "&eacute;", "&#8212;", "a&nbsp;b", "5 &lt; 6", "<b>bold</b>", "<i title='x>y'>it</i>", "<a href='/q?a=1&amp;b=2'>link</a>", "<br>", "<!-- <p>no</p> -->"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    for _ in range(300):
        body = "".join(r.choice(['<p class="lead">{}</p>', "<h2 id=h>{}</h2>", "<ul><li>{}</li><li>x</li></ul>", "<blockquote>{}</blockquote>", "<div data-role='menu'>{}</div>", "<aside>{}</aside>", "<script>if (a<b) '<p>'</script>"]).format(say(r.randint(1, 20))) for _ in range(r.randint(1, 8)))
        page = f"<html><head><title>t</title></head><body><nav>{say(5)}</nav><div id=wrap class='page has-sidebar'><article><p>{'running text ' * 9}</p>{body}</article></div><footer>{say(4)}</footer></body></html>"
        other = Parsed()
        other.feed(page)
        assert pages.main_text(page, None)[0].split("\n") == other.lines


def test_marked_inline_elements():
    text = lambda p: pages.main_text(f"<article>{p}</article>", None)[0]
    assert text(f'<p>a <span class="advert">{"x " * 3000}<span>y</span> z</span> b</p>') == "a b"
    assert text('<p>a <span class="advert">unclosed</p><p>next</p>') == "a\nnext"
    assert text('<p>a <span class="share"><b>x</b></span>b</p>') == "a b"
    assert text("<p>a <button>x</button> b</p>") == "a b"
    assert text("<p>" + '<span class="ad">' * 5000 + "</p><p>b</p>") == "b"
    assert pages.main_text("<article><p>" + "w " * 2_000_000 + "</p></article>", None)[0] == ("w " * 2_000_000).strip()


def test_calibration_takes_all_rows(spark):
    r = random.Random(9)
    rows = [(r.choice("ab"), r.random(), r.random(), r.random() * 6, float(r.random() < 0.7)) for _ in range(5001)] + [("c", 0.25, 1.0, 1.0, 1.0)]
    seen = spark.createDataFrame(rows, "best string, entropy double, margin double, length double, right double")
    want = {k: float(np.quantile([x[1] for x in rows if x[0] == k], 0.995)) for k in "abc"}
    assert language.quantiles(seen, "best", "entropy") == pytest.approx(want)
    for n in (1, 2, 3, 70, 201, 999, 1000, 1001):
        assert language.quantiles(spark.createDataFrame([("a", float(k)) for k in range(n)], "best string, entropy double"), "best", "entropy") == pytest.approx({"a": 0.995 * (n - 1)})
    x, y = np.array([(1.0, m, k) for _, _, m, k, _ in rows]), np.array([z[-1] for z in rows])
    b = np.array([0.0, 1.0, 0.0])
    for _ in range(30):
        q = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (y - q) - 0.1 * (b - [0, 1, 0]))
    assert language.logistic(seen) == pytest.approx(b)
    assert language.logistic(seen.limit(0)).tolist() == [0.0, 1.0, 0.0] and language.quantiles(seen.limit(0), "best", "entropy") == {}


# ---- 4: repeated strings -------------------------------------------------------------------------------------------


def brute_removed(rows, n=50):
    seen, out = {}, Counter()
    for d, t in sorted(((d, t.encode()) for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0)):
        gone = bytearray(len(t))
        for k in range(len(t) - n + 1 if d is not None else 0):
            x = t[k : k + n]
            if seen.setdefault(x, d) < d:
                gone[k : k + n] = b"\1" * n
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[d, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()] += 1
    return out


def test_repeated_strings(odd, empty, monkeypatch):
    want = brute_removed(plain(odd))
    with monkeypatch.context() as m:
        m.setattr(suffix_dedup, "BLOCK_BYTES", 20_000)  # many blocks
        assert Counter(tuple(r) for r in suffix_dedup.deduplicated(odd).collect()) == want
    for share in (suffix_dedup.WIDE, 0.0, 0.2, 2.0):  # some, all, many and no anchors are wide
        assert Counter(tuple(r) for r in suffix_dedup.deduplicated(odd, wide_share=share).collect()) == want
    assert suffix_dedup.deduplicated(empty).count() == 0


def test_blocks_fit_a_worker():
    # measured: a worker holds some 22 times a block; two workers share what 3000 MB leave beside a heap of 60 %
    assert 22 * suffix_dedup.BLOCK_BYTES <= 0.4 * 3_000_000_000 / 2
    values, first = np.arange(12).reshape(6, 2), np.array([0, 0, 2, 2, 5, 6])
    rows = suffix_dedup._cut(values, first, np.flatnonzero(np.diff(first)))
    assert [np.frombuffer(x, np.int64).tolist() for x in rows.to_pylist()] == [[0, 1, 2, 3], [4, 5, 6, 7, 8, 9], [10, 11]]
    found, sizes = suffix_dedup._joined(rows.slice(1), "<i8")
    assert found.tolist() == list(range(4, 12)) and sizes.tolist() == [6, 2]
    assert suffix_dedup._cut(values[:0], np.zeros(3, np.int64), np.zeros(0, np.int64)).to_pylist() == []


def test_previous_factors():
    r = random.Random(3)
    for _ in range(120):
        b = bytes(r.choice(b"ab") for _ in range(r.randint(0, 40)))
        same = lambda i, j, b=b: next((k for k in range(len(b) - max(i, j)) if b[i + k] != b[j + k]), len(b) - max(i, j))
        order = sorted(range(len(b)), key=lambda i: b[i:])
        common = np.array([0, *(same(i, j) for i, j in zip(order, order[1:], strict=False))][: len(b)], np.int64)
        doc = [r.randint(0, 9) for _ in b]
        for value in (order, [doc[i] for i in order]):  # by place, and by documents that have several suffixes
            want = [max([0] + [same(i, j) for j, w in zip(order, value, strict=True) if w < v]) for i, v in zip(order, value, strict=True)]
            assert suffix_dedup.factors(common, np.array(value, np.int64)).tolist() == want
            assert [x >= 3 for x in want] == (suffix_dedup.factors(common, np.array(value, np.int64), 3) >= 3).tolist()


def test_common_prefixes():
    r = random.Random(4)
    rows = sorted(bytes(r.choice(b"a\0") for _ in range(16)) for _ in range(300))
    key = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 16).view(">u8").astype(np.uint64)
    want = [0, *(next((k for k in range(16) if a[k] != b[k]), 16) for a, b in zip(rows, rows[1:], strict=False))]
    assert suffix_dedup.common_prefixes(key).tolist() == want


# ---- 6: near duplicates --------------------------------------------------------------------------------------------


def brute_classes(rows, n=5, least=0.8):
    rows = [(d, t) for d, t in rows if d is not None]
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] == rows[j][1] or (sets[i] and len(sets[i] & sets[j]) >= (least - 1e-9) * len(sets[i] | sets[j])):
                a, b = find(rows[i][0]), find(rows[j][0])
                parent[max(a, b)] = min(a, b)
    return {d: find(d) for d, _ in rows}


@pytest.mark.parametrize("chunk", [400, 6])
def test_near_duplicates(spark, empty, monkeypatch, chunk):
    monkeypatch.setattr(near_duplicates, "CHUNK_DOCS", chunk)
    r = random.Random(6)
    made = [" ".join(r.choice(WORDS) + str(r.randint(0, 50)) for _ in range(r.randint(1, 80))) for _ in range(15)]
    rows = []
    for i in range(120):
        w = r.choice(made).split()
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = r.choice(WORDS)
        rows.append((i, " ".join(w)))
    rows += [(200, ""), (201, None), (202, " \n"), (203, "one two"), (204, "one  two"), (205, "one two three"), (None, made[0]), (200, "")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, class_id int")
    want = brute_classes([(d, t or "") for d, t in rows])
    assert dict(near_duplicates.classes(df).collect()) == want
    kept = near_duplicates.one_each(df)
    assert sorted(x.doc_id for x in kept.where("doc_id is not null").collect()) == sorted(set(want.values()))
    assert kept.columns == df.columns and kept.where("doc_id is null").count() == 1
    assert near_duplicates.classes(empty).count() == near_duplicates.one_each(empty).count() == 0


def test_large_families_are_cut_into_units(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "CHUNK_DOCS", 5)
    monkeypatch.setattr(near_duplicates, "HUBS", 2)
    base = [f"w{i}" for i in range(60)]
    rows = []
    r = random.Random(11)
    for i in range(60):
        w = list(base)
        for k in range(r.choice([0, 1, 1, 2, 2, 3])):
            w[r.randrange(60)] = f"own{i}-{k}"
        rows.append((i, " ".join(w)))
    # a part of its own that only hangs on the family by bands
    other = [*base[:40], *(f"z{i}" for i in range(20))]
    rows += [(100 + i, " ".join([*other[: 50 + i], f"y{i}"])) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert dict(near_duplicates.classes(df).collect()) == brute_classes(rows)


def test_near_duplicates_on_odd_rows(spark, odd):
    """Very long texts, nulls, repeated rows and rows that share a doc_id: the classes of texts are those of brute force."""
    rows = plain(odd)
    some = {}
    for d, t in rows:
        if d is not None:
            some.setdefault(t, d)
            some[t] = min(some[t], d)
    firsts = Counter(some.values())
    own = [(d, t) for t, d in some.items() if firsts[d] == 1]  # texts whose doc_id stands for one text
    want = brute_classes(own)
    texts = odd.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    got = near_duplicates.classes(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in texts)
    alone = {d for d, t in own if want[d] == d and list(want.values()).count(d) == 1}
    assert alone <= {r.class_id for r in got}
    kept = near_duplicates.one_each(odd)
    assert kept.columns == odd.columns and kept.where("doc_id is not null").groupBy("doc_id", "text").count().where("count > 1").count() == 0


@pytest.mark.parametrize("chunk", [400, 3])
def test_texts_under_one_doc_id_are_one_document(spark, monkeypatch, chunk):
    monkeypatch.setattr(near_duplicates, "CHUNK_DOCS", chunk)
    a, b = ([f"{x}{i}" for i in range(80)] for x in "ab")
    near = lambda w, k: " ".join([*w[:k], "other", *w[k + 1 :]])
    rows = [(5, " ".join(a)), (5, " ".join(b)), *((6 + i, near(a, 0 if i % 2 else 79)) for i in range(2)), *((20 + i, near(b, 0 if i % 2 else 79)) for i in range(2)), (30, " ".join(b)), (40, "on its own"), (40, "and this")]
    got = near_duplicates.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter((d, 40 if d == 40 else 5) for d, _ in rows)


def test_repeats_of_shared_shingles_lose_no_link(spark):
    rows = []
    for i in range(40):
        a = [f"a{i}-{k}" for k in range(240)]
        block = [f"b{i}-{k}" for k in range(60)]
        rows += [(2 * i, " ".join(a + block)), (2 * i + 1, " ".join([f"c{i}-{k}" for k in range(16)] + a[16:] + block * 30))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    assert all(want[2 * i + 1] == 2 * i for i in range(40))
    assert dict(near_duplicates.classes(df).collect()) == want


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = np.arange(0, 200), np.arange(80, 300)
    wa, wb = rng.integers(1, 6, 300).astype(float), rng.integers(1, 6, 300).astype(float)
    row = np.concatenate([np.zeros(len(a), int), np.ones(len(b), int)])
    sig = near_duplicates.signatures(row, np.concatenate([keys[a], keys[b]]), np.concatenate([wa[a], wb[b]]), 2, 4096)
    x, y = np.zeros(300), np.zeros(300)
    x[a], y[b] = wa[a], wb[b]
    both = np.flatnonzero((x > 0) & (y > 0))
    exact = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in both)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.03


@pytest.mark.parametrize("held", [1 << 20, 20])
def test_components(spark, held):
    r = random.Random(9)
    edges = {(max(a, b), min(a, b)) for a, b in ((r.randint(0, 300), r.randint(0, 300)) for _ in range(220)) if a != b} | {(i + 1, i) for i in range(400, 460)}
    parent = {v: v for e in edges for v in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    found = components(spark.createDataFrame(sorted(edges), "a long, b long").repartition(5), held=held).collect()
    got = dict(found)
    assert len(found) == len(got)
    assert got == {v: find(v) for v in parent if find(v) != v}
    assert components(spark.createDataFrame([], "a long, b long"), held=held).count() == 0


# ---- 1: decontamination --------------------------------------------------------------------------------------------


def edit_ends(p, t):
    prev = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        cur = [i]
        for j, d in enumerate(t, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (c != d)))
        prev = cur
    return prev


def test_myers():
    r = random.Random(1)
    for _ in range(200):
        p, t = ("".join(r.choice("abc") for _ in range(r.randint(a, 70))) for a in (1, 0))
        assert [d for _, d in decontamination.myers(p, t)] == edit_ends(p, t)[1:]


def test_decontamination(spark, odd, empty):
    r = random.Random(4)
    sentence = lambda k: " ".join(r.choice(WORDS[:7]) + str(r.randint(0, 9)) for _ in range(k))
    items = [(i, sentence(r.randint(6, 25))) for i in range(12)] + [(50, None), (51, ""), (52, "short"), (None, sentence(9))]
    docs = []
    for i in range(80):
        body = sentence(r.randint(5, 40))
        if i % 2:
            x = list(r.choice(items[:12])[1].upper() if i % 4 == 1 else r.choice(items[:12])[1])
            for _ in range(r.randint(0, 9)):
                k = r.randrange(len(x))
                x[k : k + 1] = r.choice([["z"], [], [x[k], "q"]])
            body = f"{sentence(4)}\n {''.join(x)} {body}"
        docs.append((i, body))
    docs += [(100, None), (101, ""), (None, items[0][1])]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    tool = decontamination.Matcher([(i, t) for i, t in items if i is not None])
    want = set()
    for d, t in docs:
        for k, (i, p) in enumerate(tool.items):
            best = min(edit_ends(p, decontamination.normal(t or "")))
            if best <= len(p) // 10:
                want.add((d, i, best))
    for block in (10**6, 300):
        found = decontamination.matched(df, bench, block=block).collect()
        assert {(x.doc_id, x.item_id, x.distance) for x in found} == want and len(found) == len(want)
    text = dict(docs)
    for x in found:
        if x.distance == 0:
            assert decontamination.normal(text[x.doc_id][x.start : x.end]) == decontamination.normal(dict(items)[x.item_id])
    leaked = {d for d, _, _ in want}
    assert {x.doc_id for x in decontamination.clean(df, bench).collect()} == {d for d, _ in docs} - leaked
    assert decontamination.matched(empty, bench).count() == decontamination.matched(odd, bench.where("false")).count() == 0
    assert decontamination.clean(odd, bench.where("false")).count() == odd.count()


def least_distance(pattern, text):
    """The least edit distance of ``pattern`` and any stretch of ``text``, by rows over the pattern."""
    p = np.frombuffer(pattern.encode("utf-32-le"), np.uint32)
    step = np.arange(len(p) + 1)
    row, best = step.copy(), len(p)
    for c in np.frombuffer(text.encode("utf-32-le"), np.uint32):
        new = np.concatenate([[0], np.minimum(row[:-1] + (p != c), row[1:] + 1)])
        row = np.minimum.accumulate(new - step) + step
        best = min(best, int(row[-1]))
    return best


def holds(p, text):
    """The least distance of an item in a text, both normal; a short item stands between words or not at all."""
    if len(p) < 10:
        return 0 if re.search(rf"(?<!\w){re.escape(p)}(?!\w)", text) else len(p)
    return least_distance(p, text)


def test_short_items_are_whole_words(spark):
    docs = spark.createDataFrame([(1, "the other day"), (2, "Other days"), (3, "breathe in."), (4, "over (THE) sea"), (5, "c++ or c+"), (6, "the quick brown fox")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "the"), (2, "c++"), (3, "in")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.matched(docs, bench).collect()} == {(1, 1), (4, 1), (5, 2), (3, 3), (6, 1)}
    assert decontamination.clean(docs, bench).count() == 6
    assert {r.doc_id for r in decontamination.clean(docs, bench.unionByName(spark.createDataFrame([(9, "quick brown")], bench.schema))).collect()} == {1, 2, 3, 4, 5}


def test_decontamination_on_odd_rows(spark, odd):
    """Very long texts, nulls, ties and repeated rows against items that some of them hold."""
    rows = plain(odd)
    long = max((t for _, t in rows), key=len)
    some = [t for _, t in rows if 60 < len(t) < 2000]
    items = [(0, some[0][5:60]), (1, "word " * 12), (2, some[3][:40].upper()), (3, some[3][:40]), (4, "x" * 9), (5, "a text without an id")]
    found = decontamination.matched(odd, spark.createDataFrame(items, "item_id long, text string"))
    got = Counter((r.doc_id, r.item_id, r.distance) for r in found.collect())
    want = Counter()
    for d, t in rows:
        text = " ".join(t.lower().split())
        for i, item in items:
            p = " ".join(item.lower().split())
            # periodic long texts: a stretch of some periods shows what all of it does
            best = holds(p, text if len(text) < 5000 or len(p) < 10 else text[:2000])
            if best <= len(p) // 10:
                want[d, i, best] += 1
    assert got == want and any(d == 503 for d, *_ in want) and len(long) > 100_000
    leaked = {d for d, *_ in want if d is not None}
    kept = decontamination.clean(odd, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == odd.columns
    held = {(d, t) for d, t in rows if not any(least_distance(" ".join(x.lower().split()), " ".join(t.lower().split())[:2000]) <= len(" ".join(x.split())) // 10 for _, x in items if len(x) >= 10)}
    assert {(r.doc_id, r.text or "") for r in kept.collect()} == held and leaked


def test_the_budget_is_a_tenth_of_every_item():
    r = random.Random(12)
    letters = "abcdefghij "
    made = lambda n: decontamination.normal("".join(r.choice(letters) for _ in range(n + 20)))[:n].strip()
    items = [(n, made(n)) for n in [*range(3, 60, 4), 90, 103, 233, 394]]
    tool = decontamination.Matcher(items)
    for i, p in items:
        for edits in {0, len(p) // 20, len(p) // 10, len(p) // 10 + 1}:
            x = list(p)
            for k in range(edits):  # spread over the item, so that few pieces stay whole
                at = (2 * k + 1) * len(p) // (2 * edits)
                x[at] = r.choice(["Z", "", x[at] + "z"])
            text = f"{made(30)} {''.join(x)} {made(30)}"
            want = {(j, d) for j, q in items if (d := min(edit_ends(q, decontamination.normal(text)))) <= len(q) // 10 and holds(q, decontamination.normal(text)) == d}
            assert {(m.item, m.distance) for m in tool.matches(text)} == want, (i, edits)


# ---- 9: language ---------------------------------------------------------------------------------------------------


def test_kneser_ney_sums_to_one(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("abc ") for _ in range(200)) for _ in range(5)]
    parts, _ = language._grams(*language.symbols(texts))
    counts = Counter(zip(*(p.tolist() for p in parts), strict=True))
    rows = [(lang, a << 32 | b, c << 32 | d, n) for i, ((a, b, c, d), n) in enumerate(sorted(counts.items())) for lang in (("x", "y") if i % 2 else ("x",))]
    m = language.opened(language.store(spark.createDataFrame(rows, "lang string, first long, last long, n long").withColumn("n_aside", F.lit(0)))[0])
    alphabet = np.array([*sorted({ord(c) for c in "abc "}), ord("q")], np.uint32)  # and one that no text has
    for context in ("abc", "aaa", "\0\0\0", "zzz", "c a"):
        logs = m.logs([*(np.full(len(alphabet), ord(c), np.uint32) for c in context), alphabet])
        assert np.exp(logs).sum(0) == pytest.approx(1, abs=1e-4)


def brute_kneser_ney(texts, alphabet):
    """p(symbol | context) of interpolated Kneser-Ney from dictionaries: raw counts at the highest order, below it the number of
    different symbols that stand before a gram; one discount an order."""
    lead = "\0\0\0"
    counts = [Counter(x[i - 3 : i + 1] for x in (lead + t for t in texts) for i in range(3, len(x)))]
    while len(counts) < 4:
        counts.insert(0, Counter(g[1:] for g in counts[0]))
    d = []
    for c in counts:
        one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d.append(min(0.9, max(0.1, one / (one + 2 * two) if one + two else 0.5)))

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / alphabet
        c, below = counts[k - 1], p(gram[1:])
        total = sum(v for g, v in c.items() if g[:-1] == gram[:-1])
        if not total:
            return below
        kinds = sum(g[:-1] == gram[:-1] for g in c)
        return max(c[gram] - d[k - 1], 0) / total + d[k - 1] * kinds / total * below

    return p


def test_kneser_ney_equals_dictionaries(spark):
    r = random.Random(8)
    texts = {"x": ["".join(r.choice("aabc ") for _ in range(r.randint(1, 60))).strip() or "a" for _ in range(8)], "y": ["".join(r.choice("bcdd ") for _ in range(r.randint(1, 60))).strip() or "b" for _ in range(5)]}
    rows = [(k, t, lang) for k, (t, lang) in enumerate((t, lang) for lang, ts in texts.items() for t in ts)]
    df = spark.createDataFrame([(10 * k + 3, t, lang) for k, t, lang in rows], "doc_id long, text string, lang string")
    ids = {x.doc_id: x.aside for x in language.learnable(df).withColumn("aside", language.aside()).collect()}
    for without, stored in enumerate(language.store(language.gram_counts(df))):
        model = language.opened(stored)
        used = {lang: [" ".join(t.split()) for k, t, x in rows if x == lang and 10 * k + 3 in ids and not (without and ids[10 * k + 3])] for lang in texts}
        alphabet = 1 + len({c for ts in used.values() for t in ts for c in t})
        brute = {lang: brute_kneser_ney(ts, alphabet) for lang, ts in used.items()}
        grams = sorted({x[i - 3 : i + 1] for ts in used.values() for x in ("\0\0\0" + t for t in ts) for i in range(3, len(x))})
        grams += ["".join(r.choice("abcdq ") for _ in range(4)) for _ in range(150)]
        logs = model.logs([np.array([ord(g[k]) for g in grams], np.uint32) for k in range(4)])
        for k, lang in enumerate(model.langs):
            assert np.exp(logs[:, k]) == pytest.approx([brute[lang](g) for g in grams], rel=1e-3)


@needs_data
def test_languages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = QUERIES["op9_kneser_ney"](spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == docs.count() and (held.lang_pred == held.lang).mean() > 0.97
    assert all(o == (zlib.crc32(str(d).encode()) % 5 == 0) for d, o in zip(got.doc_id, got.held_out, strict=True))
    assert got.score.between(0, 1).all()


def test_language_cases(spark, odd, empty):
    got = language.predicted(odd).collect()
    assert len(got) == odd.count()
    texts = Counter("und" if t is None or not any(c.isalpha() for c in t) else "en" for t in (r.text for r in odd.collect()))
    assert Counter(r.lang_pred for r in got) == texts
    assert language.predicted(empty).count() == 0
    assert {r.lang_pred for r in language.predicted(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_the_model_keeps_every_gram(spark):
    r = np.random.default_rng(9)
    rows = [(i, "".join(map(chr, r.integers(0x4E00, 0x9000, 30_000))), "zz") for i in range(50)]
    learned = language.learnable(spark.createDataFrame([(i, "a", "zz") for i, _, _ in rows], "doc_id long, text string, lang string"))
    ids = {x.doc_id for x in learned.select("doc_id").collect()}
    grams = {t[k : k + 4] for i, x, _ in rows if i in ids for t in ["\0\0\0" + x] for k in range(len(x))}
    assert len(grams) > 1_000_000
    model = language.opened(language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert len(model.grams[-1][0].keys) == len(grams)


# ---- whole queries and the pipeline --------------------------------------------------------------------------------


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_whole_query(spark, name):
    df = QUERIES[name](spark, DATA)
    one_per_doc = name not in ("op1_pigeonhole_myers", "op3_template_classes", "op8_concat_cut")
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    found = df.collect()
    assert len(found) == n if one_per_doc else found
    assert len(df.columns) == len(set(df.columns))


@needs_data
def test_repeated_strings_of_the_test_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in QUERIES["op4_longest_previous_factor"](spark, DATA).collect()) == brute_removed(docs)


@needs_data
def test_near_duplicates_of_the_test_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert dict(QUERIES["op6_probminhash"](spark, DATA).collect()) == brute_classes(docs)


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    import duckdb

    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
        answer = c.execute(ORACLE_SQL[name])
        columns, want = [x[0] for x in answer.description], answer.fetchall()
    df = QUERIES[name](spark, DATA)
    assert Counter(tuple(r) for r in df.select(*columns).collect()) == Counter(want)


@needs_data
def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    have = {r.doc_id: r.text for r in docs.collect()}
    labels, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("labels", "benchmark"))
    judged = {r.doc_id for r in quality.judged(docs, labels).where("kept").collect()}
    classes = brute_classes([(d, t) for d, t in have.items() if d in judged])
    firsts = {d for d in judged if classes[d] == d}
    items = [(r.item_id, r.text) for r in bench.collect()]
    tool = decontamination.Matcher(items)
    clean = {d for d in firsts if not tool.matches(have[d])}
    out = c.run(spark, DATA).collect()
    assert {r.doc_id for r in out} == clean
    assert sum(r.length for r in out) == sum({r.doc_id: r.doc_tokens for r in out}.values())
    assert max(r.offset + r.length for r in out) <= 2048


def test_pipeline_stages_on_odd_tables(spark, odd, empty, tmp_path):
    import corpus_pipeline as c

    spark.createDataFrame([(3, 1, 0), (None, 0, 0), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "some item that is long enough to count here"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd, empty):
        for _, stage in c.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            out.count()
        c.STAGES[-1][1](spark, docs, str(tmp_path)).count()
