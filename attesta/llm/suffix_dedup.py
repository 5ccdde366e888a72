"""Removal of repeated passages by longest-previous-factor arrays over suffix order, keeping the first occurrence.

A byte is removed if it lies in a string of ``LENGTH`` bytes that also starts in a document with a smaller doc_id, that is,
if the longest previous factor of that string's suffix, over documents before it, has at least ``LENGTH`` bytes.

No machine can sort all suffixes of a corpus, and none has to: two equal strings of 50 bytes select the same grams of
``GRAM`` bytes inside them (the least hash of their windows), so suffixes only meet around equal anchors.

0. Texts are dealt once by hashed doc_id into blocks (the same shuffle serves all passes).  Of equal texts only the first
   takes part; a later copy is removed whole.
1. Blocks send the hashes of their anchors, each once; buckets of hashes answer which occur in more than one document.
2. Blocks send the context of each shared anchor (26 bytes before, 50 from it on), each distinct one once with the least
   doc_id that has it.  A bucket sorts the suffixes of its contexts, takes their common prefixes and, by the previous and the
   next smaller document in that order, their longest previous factors.  It answers with a bit for each string whose factor
   reaches ``LENGTH``.
3. Blocks apply the answers to all documents that hold the context.

What a bucket gets of one passage is at most one row a block, however many documents hold it.  At a passage's ends, though,
every document has a context of its own around the same anchor.  An anchor that most blocks have is therefore *wide*: around
it blocks send strings instead of contexts, each distinct one once as a hash of 128 bits, dealt by that hash (the factor
of such a string is all of it or nothing), so that no group grows with the number of documents that hold a passage.  Defined results: a null or
empty text has 0 bytes and the hash of no bytes; texts of fewer than ``LENGTH`` bytes lose nothing; rows with equal doc_id do
not remove one another; rows without doc_id neither remove nor lose anything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import U64, Slice, SpanHash, documents, mix, partitions, slices, texts

LENGTH, GRAM = 50, 24
#: Bytes of text, and contexts, that a kernel takes at once: its arrays then stay in a processor's cache.
SLICE, CHUNK = 64 << 10, 8192
#: Bytes of text in a block, at most about; a bucket gets what two blocks send on the average.  A worker holds up to some 20 times
#: as much, where most contexts are shared, so this and not the size of the corpus decides its memory.
BLOCK_BYTES = 8 << 20
#: An anchor is wide if so many of the blocks have it.
WIDE = 0.9


def _slide(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick over x[i : i + n] for each i (beyond the end: what there is)."""
    done = 1
    while done < n:
        step = min(done, n - done)
        y = x.copy()
        y[:-step] = pick(x[:-step], x[step:])
        x, done = y, done + step
    return x


def anchors(s: Slice, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the selected grams: in each string of ``length`` bytes the grams of the least hash."""
    n = len(s.data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    end = np.repeat(s.at[1:], np.diff(s.at))
    place = np.arange(n)
    top = U64(0xFFFFFFFFFFFFFFFF)
    value = np.full(n, top)
    k = n - gram + 1
    starts = place[:k]
    value[:k] = SpanHash(s.data).of(starts, starts + gram)
    value[place + gram > end] = top
    width = length - gram + 1
    least = _slide(value, width, np.minimum)
    least[place + length > end] = 0
    # the largest of the minima of the windows that hold a gram is the gram's own value exactly if one of them selects it
    most = _slide(least[::-1], width, np.maximum)[::-1]
    at = np.flatnonzero((most == value) & (value != top))
    return at, mix(value[at])  # least values crowd at the low end; mixed again, they spread over the buckets


class Contexts:
    """Contexts of anchors: ``bytes`` (n x (width - 1 + length)), what of them lies inside the document, and their hash."""

    def __init__(self, s: Slice, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> None:
        before = length - gram
        self.row = np.searchsorted(s.at, at, "right") - 1
        self.left = np.minimum(at - s.at[self.row], before)
        self.right = np.minimum(s.at[self.row + 1] - at, length)
        width = before + length
        around = np.concatenate([np.zeros(before, np.uint8), s.data, np.zeros(length, np.uint8)])
        self.bytes = np.lib.stride_tricks.sliding_window_view(around, width)[at]
        span = np.arange(-before, length)
        short = np.flatnonzero((self.left < before) | (self.right < length))
        outside = (span[None, :] < -self.left[short, None]) | (span[None, :] >= self.right[short, None])
        self.bytes[short] = np.where(outside, np.uint8(0), self.bytes[short])
        first = np.arange(len(at)) * width
        self.hash = np.zeros(len(at), U64)
        for i in range(0, len(at), CHUNK):
            part = slice(i, i + CHUNK)
            at0 = first[part] - i * width
            self.hash[part] = mix(SpanHash(self.bytes[part].ravel()).of(at0, at0 + width) ^ mix((self.left[part] * 64 + self.right[part]).astype(U64)))


def valid(left: np.ndarray, right: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Which strings of ``length`` bytes lie inside: column o is the string that starts o bytes before the anchor."""
    o = np.arange(length - gram + 1)
    return (o[None, :] <= left[:, None]) & (length - o[None, :] <= right[:, None])


def factors(common: np.ndarray, value: np.ndarray, least: int = 1) -> np.ndarray:
    """Longest previous factors of suffixes in suffix order: ``common`` holds the length of the prefix that each shares with the
    one before it, ``value`` its place (or document).  The longest prefix that a suffix shares with one of smaller value it
    shares with the previous or the next smaller one in this order; the prefix is the least of ``common`` on the way there.
    All suffixes look for theirs at once, each by the pointers of those that it passes.  A factor below ``least`` may be told too
    short (its search ends where ``common`` falls below)."""
    n = len(value)
    out = np.zeros(n, np.int64)
    for side in (1, -1):
        v = value[::side]
        low = (common if side == 1 else np.append(common[1:], 0)[::-1]).astype(np.int64)
        if n:
            low[0] = 0
        smaller = np.arange(-1, n - 1)
        live = np.flatnonzero(low >= least)
        while len(live := live[v[smaller[live]] >= v[live]]):
            at = smaller[live]
            low[live], smaller[live] = np.minimum(low[live], low[at]), smaller[at]
            live = live[low[live] >= least]
        low[low < least] = 0
        out = np.maximum(out, low[::side])
    return out


def common_prefixes(key: np.ndarray) -> np.ndarray:
    """The number of bytes that each row of big-endian words (n x words) shares with the row before it."""
    out = np.zeros(len(key), np.int64)
    if len(key) > 1:
        differ = key[1:] ^ key[:-1]
        word = (differ != 0).argmax(1)
        x = differ[np.arange(len(differ)), word]
        out[1:] = 8 * word + sum((x >> U64(8 * k) == 0).astype(np.int64) for k in range(8))
        out[1:][~differ.any(1)] = 8 * key.shape[1]
    return out


def matched(context: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray, doc: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For each context and string in it whether a smaller document of its group has the string: the strings' suffixes, cut
    at ``length`` bytes, are sorted by group and bytes, and their longest previous factor over documents reaches ``length``."""
    ok = valid(left, right, length, gram)
    i, o = np.nonzero(ok)
    before = length - gram
    words = -(-length // 8)
    string = np.zeros((len(i), 8 * words), np.uint8)
    string[:, :length] = context[i[:, None], (before - o)[:, None] + np.arange(length)[None, :]]
    key = string.view(">u8").astype(U64).reshape(len(i), words)
    order = np.lexsort((doc[i], *(key[:, w] for w in range(words - 1, -1, -1)), o, group[i]))  # equal strings stand at equal places of their contexts
    key, g, p = key[order], group[i][order], o[order]
    common = np.minimum(common_prefixes(key), length)
    common[1:][(g[1:] != g[:-1]) | (p[1:] != p[:-1])] = 0
    ok[i[order], o[order]] = factors(common, doc[i][order], length) >= length
    return ok


def earlier(name: np.ndarray, anchor: np.ndarray, doc: np.ndarray, sides: np.ndarray, raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For each context, sorted by anchor, name and document, a bit for each of its strings that a smaller document has too."""
    new = np.concatenate([[True], (name[1:] != name[:-1]) | (anchor[1:] != anchor[:-1])])
    one = np.flatnonzero(new)  # equal contexts once, with their least document
    which = np.cumsum(new) - 1
    left, right = sides[one] >> 6, sides[one] & 63
    inside = valid(left, right, length, gram)
    found = np.zeros(inside.shape, bool)
    g = anchor[one]
    twin = np.zeros(len(one), bool)  # contexts that share their anchor with another one
    twin[1:] |= g[1:] == g[:-1]
    twin[:-1] |= g[1:] == g[:-1]
    twin = np.flatnonzero(twin)
    if len(twin):
        found[twin] = matched(raw[one[twin]], left[twin], right[twin], g[twin], doc[one[twin]], length, gram)
    later = doc > doc[one][which]
    bits = np.zeros(len(name), "<u4")
    for o in range(found.shape[1]):
        bits |= (found[:, o][which] | (later & inside[:, o][which])).astype("<u4") << np.uint32(o)
    return bits


class Strings:
    """The strings of ``length`` bytes around anchors of a slice, each place once: where they start, their document and hashes."""

    def __init__(self, s: Slice, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> None:
        row = np.searchsorted(s.at, at, "right") - 1
        start = at[:, None] - np.arange(length - gram + 1)[None, :]
        inside = (start >= s.at[row][:, None]) & (start + length <= s.at[row + 1][:, None])
        self.start = np.unique(start[inside])
        self.row = np.searchsorted(s.at, self.start, "right") - 1
        self.one, self.two = (SpanHash(s.data, other).of(self.start, self.start + length) if len(self.start) else np.zeros(0, U64) for other in (False, True))


def _least(one: np.ndarray, two: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by string and document, for each entry in that order the least document of its string)."""
    order = np.lexsort((doc, two, one))
    o, t = one[order], two[order]
    head = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (t[1:] != t[:-1])])) if len(o) else np.zeros(0, np.int64)
    return order, np.repeat(doc[order][head], np.diff(np.append(head, len(o))))


# ---- passes --------------------------------------------------------------------------------------------------------


def _binary(values: list[np.ndarray]) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())


def _cut(values: np.ndarray, first: np.ndarray, used: np.ndarray) -> pa.Array:
    """The bytes of values[first[b] : first[b + 1]] for each b of ``used``, all of those that have any; nothing is copied."""
    values = np.ascontiguousarray(values)
    width = values.nbytes // max(1, len(values))
    at = (np.append(first[used], len(values)) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(used), [None, pa.py_buffer(at), pa.py_buffer(values.ravel())])


def _joined(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(the values of all rows of a binary column, how many each row has), where they lie."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size = np.dtype(kind).itemsize
    values = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind) if data is not None and len(column) else np.zeros(0, kind)
    return values, np.diff(at) // size


def _by_bucket(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by bucket, first of each bucket in that order)."""
    bucket = ((h >> U64(40)).astype(np.int64) * buckets) >> 24
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _table(group: pa.Table) -> pa.RecordBatch | None:
    return group.combine_chunks().to_batches()[0] if group.num_rows else None


class _Block:
    """The documents of a block that take part, slice by slice."""

    def __init__(self, docs: pa.Table, firsts: set[int], length: int, gram: int) -> None:
        self.batch, self.firsts, self.length, self.gram = _table(docs), firsts, length, gram

    def __iter__(self) -> Iterator[tuple[Slice, np.ndarray, np.ndarray, np.ndarray]]:
        """(slice, doc_ids, places, hashes of anchors)."""
        if self.batch is None:
            return
        ids = self.batch.column("doc_id")
        takes = np.array([d is not None and d in self.firsts for d in ids.to_pylist()], bool)
        ids = np.asarray(ids.fill_null(0), np.int64)
        for s in slices(self.batch.column("text"), SLICE):
            at, h = anchors(s, self.length, self.gram)
            mine = takes[s.start + np.searchsorted(s.at, at, "right") - 1]
            yield s, ids[s.start : s.stop], at[mine], h[mine]


def _firsts(messages: pa.Table) -> set[int]:
    return set(messages.column("doc_id").drop_null().to_pylist())


def deduplicated(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, wide_share: float = WIDE, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row."""
    size = texts(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(2 * partitions(docs.sparkSession), -(-size // BLOCK_BYTES))
    buckets = blocks // 2
    width = length - gram + 1
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block")
    dealt = texts(docs).select(block, "doc_id", "text").groupBy("block")
    firsts = texts(docs).where("doc_id is not null").groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id")).select(block, "doc_id")

    # 1: which anchors are shared
    def offer(docs_: pa.Table, messages: pa.Table) -> pa.Table:
        found, rows = [], []
        for s, ids, at, h in _Block(docs_, _firsts(messages), length, gram):
            found.append(h)
            rows.append(ids[np.searchsorted(s.at, at, "right") - 1])
        h, d = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((found, U64), (rows, np.int64)))
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        last = np.append(head[1:], len(h)) - 1
        several = (d[last] != d[head]).astype(np.uint8) if len(head) else np.zeros(0, np.uint8)
        h = h[head]
        order, first = _by_bucket(h, buckets)
        low, several = (h[order] & U64(0xFFFFFFFF)).astype("<u4"), several[order]
        used = np.flatnonzero(np.diff(first))
        own = docs_.column("block")[0].as_py() if docs_.num_rows else -1
        return pa.table({"bucket": pa.array(used.astype(np.int32)), "block": pa.array(np.full(len(used), own, np.int32)), "low": _cut(low, first, used), "several": _cut(several, first, used)})

    offered = dealt.cogroup(firsts.groupBy("block")).applyInArrow(offer, "bucket int, block int, low binary, several binary")

    def share(group: pa.Table) -> pa.Table:
        batch = _table(group)
        low = [np.frombuffer(x.as_py(), "<u4") for x in batch.column("low")]
        source = np.repeat(np.arange(len(low)), [len(x) for x in low])
        value = np.concatenate(low)
        several = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in batch.column("several")])
        order = np.argsort(value, kind="stable")
        v = value[order]
        head = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        size = np.diff(np.append(head, len(v)))
        shared = np.repeat((size > 1) | (np.maximum.reduceat(several[order], head) > 0), size)
        broad = np.zeros(len(value), bool)
        broad[order] = np.repeat(size >= max(2, wide_share * blocks), size)
        at = np.sort(order[shared])
        cut = np.searchsorted(source[at], np.arange(len(low) + 1))
        used = np.flatnonzero(np.diff(cut))
        parts = [at[cut[k] : cut[k + 1]] for k in used]
        return pa.table({"block": batch.column("block").take(pa.array(used)), "bucket": batch.column("bucket").take(pa.array(used)), "low": _binary([value[x] for x in parts]), "wide": _binary([value[x[broad[x]]] for x in parts]), "doc_id": pa.nulls(len(used), pa.int64())})

    shared = offered.groupBy("bucket").applyInArrow(share, "block int, bucket int, low binary, wide binary, doc_id long")

    # 2: which strings of shared contexts have an earlier match
    def wanted(messages: pa.Table, which: str) -> np.ndarray:
        parts = [np.frombuffer(x, "<u4").astype(U64) | (U64(b) << U64(32)) for b, x in zip(messages.column("bucket").to_pylist(), messages.column(which).to_pylist(), strict=True) if x is not None]
        return np.sort(np.concatenate(parts)) if parts else np.zeros(0, U64)

    def code(h: np.ndarray) -> np.ndarray:
        return (h & U64(0xFFFFFFFF)) | ((((h >> U64(40)).astype(np.int64) * buckets) >> 24).astype(U64) << U64(32))

    def among(x: np.ndarray, kept: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(kept, x), max(0, len(kept) - 1))
        return kept[at] == x if len(kept) else np.zeros(len(x), bool)

    def contexts(docs_: pa.Table, messages: pa.Table) -> pa.Table:
        want, broad, parts, strings = wanted(messages, "low"), wanted(messages, "wide"), [], []
        for s, ids, at, h in _Block(docs_, _firsts(messages), length, gram):
            wide = among(code(h), broad)
            if wide.any():
                x = Strings(s, at[wide], length, gram)
                strings.append((x.one, x.two, ids[x.row]))
            hit = among(code(h), want) & ~wide
            c = Contexts(s, at[hit], length, gram)
            parts.append((c.hash, h[hit], ids[c.row], c.left, c.right, c.bytes))
        if not parts:
            parts = [(np.zeros(0, U64), np.zeros(0, U64), *[np.zeros(0, np.int64)] * 3, np.zeros((0, width - 1 + length), np.uint8))]
        name, h, d, left, right, raw = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        order = np.lexsort((d, name))
        head = order[np.concatenate([[True], name[order][1:] != name[order][:-1]])] if len(order) else order  # the least document of each context
        order, first = _by_bucket(h[head], buckets)
        at = head[order]
        used = np.flatnonzero(np.diff(first))
        own = docs_.column("block")[0].as_py() if docs_.num_rows else -1
        columns = {"name": name[at], "anchor": h[at], "doc": d[at], "sides": (left[at] * 64 + right[at]).astype("<u2"), "raw": raw[at]}
        out = {"bucket": pa.array(used.astype(np.int32)), "block": pa.array(np.full(len(used), own, np.int32)), "strings": pa.array(np.zeros(len(used), bool))}
        for k, v in columns.items():
            out[k] = _cut(v, first, used)
        if not strings:
            return pa.table(out)
        one, two, d = (np.concatenate(x) for x in zip(*strings, strict=True))
        order, _ = _least(one, two, d)
        one, two, d = one[order], two[order], d[order]
        head = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        one, two, d = one[head], two[head], d[head]  # the least document of each string
        order, first = _by_bucket(one, buckets)
        used = np.flatnonzero(np.diff(first))
        cut = lambda v: _cut(v[order], first, used)
        none = _binary([np.zeros(0, np.uint8)] * len(used))
        more = {"bucket": pa.array(used.astype(np.int32)), "block": pa.array(np.full(len(used), own, np.int32)), "strings": pa.array(np.ones(len(used), bool)), "name": cut(one), "anchor": cut(two), "doc": cut(d), "sides": none, "raw": none}
        return pa.concat_tables([pa.table(out), pa.table(more)])

    nothing = F.lit(None)
    messages = shared.unionByName(firsts.select("block", nothing.cast("int").alias("bucket"), nothing.cast("binary").alias("low"), nothing.cast("binary").alias("wide"), "doc_id"))
    sent = dealt.cogroup(messages.groupBy("block")).applyInArrow(contexts, "bucket int, block int, strings boolean, name binary, anchor binary, doc binary, sides binary, raw binary")

    def match_strings(batch: pa.RecordBatch) -> pa.Table:
        (one, sizes), (two, _), (doc, _) = (_joined(batch.column(c), k) for c, k in (("name", "<u8"), ("anchor", "<u8"), ("doc", "<i8")))
        source = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((doc, two, one))
        common = np.zeros(len(order), np.int64)  # all of a string or nothing: its hash stands for its bytes
        common[1:][(one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])] = length
        at = np.sort(order[factors(common, doc[order], length) >= length])
        cut = np.searchsorted(source[at], np.arange(batch.num_rows + 1))
        used = np.flatnonzero(np.diff(cut))
        parts = [at[cut[j] : cut[j + 1]] for j in used]
        return pa.table({"block": batch.column("block").take(pa.array(used)), "doc_id": pa.nulls(len(used), pa.int64()), "name": _binary([one[x] for x in parts]), "anchor": _binary([two[x] for x in parts]), "bits": pa.nulls(len(used), pa.binary())})

    def match(group: pa.Table) -> pa.Table:
        batch = _table(group)
        told = np.asarray(batch.column("strings"))
        found = [f(batch if mine.all() else batch.filter(pa.array(mine))) for f, mine in ((match_contexts, ~told), (match_strings, told)) if mine.any()]
        return pa.concat_tables(found)

    def match_contexts(batch: pa.RecordBatch) -> pa.Table:
        name, sizes = _joined(batch.column("name"), "<u8")
        source = np.repeat(np.arange(len(sizes)), sizes)
        anchor, doc = _joined(batch.column("anchor"), "<u8")[0], _joined(batch.column("doc"), "<i8")[0]
        sides, raw = _joined(batch.column("sides"), "<u2")[0].astype(np.int64), _joined(batch.column("raw"), "u1")[0].reshape(-1, width - 1 + length)
        order = np.lexsort((doc, name, anchor))
        g = anchor[order]
        bits = np.zeros(len(name), "<u4")
        a = 0
        while a < len(order):  # whole groups of an anchor at a time
            b = int(np.searchsorted(g, g[min(a + CHUNK, len(g)) - 1], "right"))
            part = order[a:b]
            bits[part] = earlier(name[part], anchor[part], doc[part], sides[part], raw[part], length, gram)
            a = b
        at = np.flatnonzero(bits)
        cut = np.searchsorted(source[at], np.arange(len(sizes) + 1))
        used = np.flatnonzero(np.diff(cut))
        out = {"block": batch.column("block").take(pa.array(used)), "doc_id": pa.nulls(len(used), pa.int64())}
        for k, v in (("name", name), ("anchor", anchor), ("bits", bits)):
            out[k] = _binary([v[at[cut[j] : cut[j + 1]]] for j in used])
        return pa.table(out)

    answers = sent.groupBy("bucket").applyInArrow(match, "block int, doc_id long, name binary, anchor binary, bits binary")
    blank = lambda *names: [nothing.cast("binary").alias(c) for c in names]
    answers = answers.select("*", nothing.cast("int").alias("bucket"), *blank("wide"))
    answers = answers.unionByName(firsts.select("block", "doc_id", nothing.cast("int").alias("bucket"), *blank("name", "anchor", "bits", "wide")))
    answers = answers.unionByName(shared.where(F.octet_length("wide") > 0).select("block", "doc_id", "bucket", "wide", *blank("name", "anchor", "bits")))

    # 3: removal
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text

    def remove(docs_: pa.Table, messages: pa.Table) -> pa.Table:
        batch, firsts_ = _table(docs_), _firsts(messages)
        if batch is None:
            return pa.table([pa.array([], t) for t in types], names)

        def read(c: str, kind: str, strings: bool = False) -> np.ndarray:
            rows = zip(messages.column(c).to_pylist(), messages.column("bits").to_pylist(), strict=True)
            return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x, b in rows if x is not None and (b is None) == strings)])

        name, anchor, bits = read("name", "<u8"), read("anchor", "<u8"), read("bits", "<u4")
        broad, gone_one, gone_two = wanted(messages, "wide"), read("name", "<u8", True), read("anchor", "<u8", True)
        order = np.argsort(name)
        name, bits, anchor = name[order], bits[order], np.unique(anchor)
        every = list(_Block(docs_, firsts_, length, gram))
        # anchors that several documents of this block have
        h = np.concatenate([x[3] for x in every])
        d = np.concatenate([ids[np.searchsorted(s.at, at, "right") - 1] for s, ids, at, _ in every])
        o = np.lexsort((d, h))
        h, d = h[o], d[o]
        several = np.unique(h[1:][(h[1:] == h[:-1]) & (d[1:] != d[:-1])])
        parts, strings = [], []
        for s, ids, at, hh in every:
            wide = among(code(hh), broad)
            strings.append((Strings(s, at[wide], length, gram), ids))
            hit = (among(hh, anchor) | among(hh, several)) & ~wide
            c = Contexts(s, at[hit], length, gram)
            parts.append((c.hash, ids[c.row], at[hit], c.left, c.right))
        own = np.concatenate([p[0] for p in parts])
        docs_of = np.concatenate([p[1] for p in parts])
        o = np.lexsort((docs_of, own))
        first = np.concatenate([[True], own[o][1:] != own[o][:-1]]) if len(o) else np.zeros(0, bool)
        unique, least = own[o][first], docs_of[o][first]
        # strings around wide anchors: an answer stands for a document before all of this block's
        one, two = (np.concatenate([getattr(x, c) for x, _ in strings] + [g]) for c, g in (("one", gone_one), ("two", gone_two)))
        owner = np.concatenate([ids[x.row] for x, ids in strings] + [np.full(len(gone_one), np.iinfo(np.int64).min)])
        o, first_doc = _least(one, two, owner)
        string_gone = np.zeros(len(one), bool)
        string_gone[o] = first_doc < owner[o]
        rows, done = [], 0
        for (s, ids, _, _), (ctx, dd, at, left, right), (x, _) in zip(every, parts, strings, strict=True):
            change = np.zeros(len(s.data) + 1, np.int32)
            start = x.start[string_gone[done : done + len(x.start)]]
            done += len(x.start)
            change += np.bincount(start, minlength=len(change)).astype(np.int32)
            change -= np.bincount(start + length, minlength=len(change)).astype(np.int32)
            for k in range(0, len(ctx), CHUNK):
                c, lo, hi = ctx[k : k + CHUNK], left[k : k + CHUNK], right[k : k + CHUNK]
                later = dd[k : k + CHUNK] > least[np.searchsorted(unique, c)]
                place = np.minimum(np.searchsorted(name, c), max(0, len(name) - 1))
                told = np.where(name[place] == c, bits[place], 0).astype(np.int64) if len(name) else np.zeros(len(c), np.int64)
                i, off = np.nonzero(valid(lo, hi, length, gram) & (later[:, None] | ((told[:, None] >> np.arange(width)[None, :]) & 1 == 1)))
                start = at[k : k + CHUNK][i] - off
                change += np.bincount(start, minlength=len(change)).astype(np.int32)
                change -= np.bincount(start + length, minlength=len(change)).astype(np.int32)
            removed = np.cumsum(change[:-1]) > 0
            for r in range(s.rows):
                a, b = int(s.at[r]), int(s.at[r + 1])
                key = batch.column("doc_id")[s.start + r].as_py()
                if key is not None and key not in firsts_ and b - a >= length:
                    removed[a:b] = True
                out = removed[a:b]
                n = int(out.sum())
                kept = s.data[a:b][~out].tobytes() if n else s.data[a:b].tobytes()
                spans = int(out[:1].sum() + (out[1:] & ~out[:-1]).sum()) if n else 0
                rows.append((key, b - a, n, spans, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return dealt.cogroup(answers.groupBy("block")).applyInArrow(remove, schema)


def op4_longest_previous_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every whole text of documents once repeated strings of 50 bytes are removed from later documents."""
    return deduplicated(documents(spark, sf_dir))
