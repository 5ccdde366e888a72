"""Encoding and decoding with a SentencePiece model (byte pairs with byte fallback), by merge rounds over flat arrays.

A text gets a space before it (unless it is empty), every space is the symbol U+2581, and the texts of a slice are cut where a run
of spaces begins.  No piece of the vocabulary lies across such a place, so the cuts change nothing, and each distinct cut text is
encoded once in a worker (``tokens.Encoder`` keeps it).  New ones are encoded together: their characters are one flat array of
symbols; in a round every word finds its least pair rank, merges all its pairs of that rank from the left, and the array is closed
up; words without a pair leave it.

The library merges one pair at a time, the best score first and the leftmost of equals.  Merging all pairs of a rank at once is the
same unless a merged symbol makes a pair that is not worse; a word where that happens merges only its leftmost pair in that round.
Runs of spaces, whose pieces all have one score, are such words: they are looked up by their length.

Defined results: null and empty texts have no ids; U+2581 in a text is a space; a character that the vocabulary lacks is the ids of
its UTF-8 bytes; rows with equal doc_id are rows of their own; an empty table gives no rows.  A model with other settings (another
algorithm, a normaliser, user-defined pieces) raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from attesta.llm.common import Slice, documents, slices, texts
from attesta.llm.tokens import ENCODED_BYTES, Encoder

SPACE = "▁"
_MARK = SPACE.encode()
#: The rank of a pair that is not in the vocabulary.
_NONE = np.iinfo(np.int32).max


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message in the wire format of protocol buffers."""

    def number() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = raw[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    i = 0
    while i < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            value: int | bytes = number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            value, i = raw[i : i + size], i + size
        yield key >> 3, value


class Vocabulary:
    """The pieces of a model: their texts, ranks by falling score (equal scores share one), and pairs that merge."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        self.size, self.texts = n, [p.id_to_piece(i) for i in range(n)]
        model = dict(_fields(p.serialized_model_proto()))  # 2: the training's settings, 3: the normaliser's
        trained, normal = dict(_fields(model[2])), dict(_fields(model[3]))
        self.bytes = np.full(256, -1, np.int32)
        self.control, plain, scores = set(), {}, np.zeros(n)
        for i, t in enumerate(self.texts):
            if p.is_byte(i):
                self.bytes[int(t[1:-1], 16)] = i
            elif p.is_control(i):
                self.control.add(i)
            elif p.is_unknown(i):
                self.unknown = i
            else:
                plain[t], scores[i] = i, p.get_score(i)
        kinds = {dict(_fields(v)).get(3, 1) for f, v in _fields(p.serialized_model_proto()) if f == 1}
        # 4: user-defined, 5: unused
        if trained.get(3) != 2 or not trained.get(35) or trained.get(24) or kinds & {4, 5} or normal.get(2) or not normal.get(3, 1) or normal.get(4, 1) or not normal.get(5, 1) or (self.bytes < 0).any():
            raise ValueError(f"{path}: not a model of byte pairs with byte fallback, a space before the text and no normaliser")
        self.unknown_text = trained[44].decode() if 44 in trained else " ⁇ "
        rank = np.zeros(n, np.int32)
        own = np.array(sorted(plain.values()))
        rank[own] = np.unique(-scores[own], return_inverse=True)[1]
        self.rank = rank
        self.ids = np.full(0x110000, -1, np.int32)
        for t, i in plain.items():
            if len(t) == 1:
                self.ids[ord(t)] = i
        pairs = {(a, b): i for t, i in plain.items() for k in range(1, len(t)) if (a := plain.get(t[:k])) is not None and (b := plain.get(t[k:])) is not None}
        keys = np.array([a * n + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], np.array(list(pairs.values()), np.int32)[order]
        if any(len(t) > 1 and any(self.ids[ord(c)] < 0 for c in t) for t in plain):
            raise ValueError(f"{path}: a piece has a character that is no piece")
        #: Whether no piece has a space after another character; and whether runs of spaces merge after everything else, alone.
        self.apart = not any(SPACE in t.lstrip(SPACE) for t in plain)
        blank = {i for t, i in plain.items() if len(t) > 1 and not t.strip(SPACE)}
        joined = any(t.startswith(2 * SPACE) and t.strip(SPACE) for t in plain)
        words = [scores[i] for t, i in plain.items() if len(t) > 1 and i not in blank]
        self.blanks = max((len(self.texts[i]) for i in blank), default=1)
        self.runs_last = self.apart and not joined and all(scores[i] < min(words, default=0) for i in blank) and len({scores[i] for i in blank}) < 2

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged piece) of each pair of symbols; symbols below 0 are no pieces."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        piece = np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.merged[at], -1)
        return np.where(piece >= 0, self.rank[piece], _NONE), piece


def merge_rounds(v: Vocabulary, symbols: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, their number in each word) after all merges; ``count``: symbols of each word before, at least one."""
    n = len(count)
    sym, word = symbols.astype(np.int32), np.repeat(np.arange(n, dtype=np.int32), count)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    rank, piece = np.full(len(sym), _NONE, np.int32), np.full(len(sym), -1, np.int32)  # of each symbol's pair with the next one
    new = np.arange(len(sym))  # symbols whose pairs are to be looked up

    def look(at: np.ndarray) -> None:
        at = at[at >= 0]
        inside = at[at + 1 < len(sym)]
        inside = inside[word[inside] == word[inside + 1]]
        rank[at], piece[at] = _NONE, -1
        rank[inside], piece[inside] = v.pairs(sym[inside], sym[inside + 1])

    while len(sym):
        look(np.concatenate([new, new - 1]))
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        low = np.minimum.reduceat(rank, first)
        size = np.diff(np.append(first, len(sym)))
        if (low == _NONE).any():
            out = np.repeat(low == _NONE, size)
            done.append((word[out], sym[out]))
            sym, word, rank, piece = sym[~out], word[~out], rank[~out], piece[~out]
            low, size = low[low != _NONE], size[low != _NONE]
            if not len(sym):
                break
        own = np.repeat(low, size)
        at = np.flatnonzero(rank == own)
        # of pairs that overlap the first, the third, ...
        begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
        at = at[(np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))) % 2 == 0]
        last = np.append(word[at[1:]] != word[at[:-1]], True)
        if not last.all():  # words with several merges
            some = np.flatnonzero(~last)
            here, made = at[some], piece[at[some]]
            after = v.pairs(made, np.where(word[np.minimum(here + 2, len(sym) - 1)] == word[here], sym[np.minimum(here + 2, len(sym) - 1)], -1))[0]
            before = np.where((some > 0) & (at[some - 1] == here - 2), piece[at[some - 1]], sym[here - 1])
            before = np.where((here > 0) & (word[here - 1] == word[here]), before, -1)
            worse = (after > own[here]) & (v.pairs(before, made)[0] > own[here])
            if not worse.all():
                odd = np.isin(word[at], word[here[~worse]])
                at = at[~odd | np.concatenate([[True], word[at[1:]] != word[at[:-1]]])]
        sym[at] = piece[at]
        stays = np.ones(len(sym), bool)
        stays[at + 1] = False
        new = at - np.arange(len(at))  # one symbol fewer for each merge to the left
        sym, word, rank, piece = sym[stays], word[stays], rank[stays], piece[stays]
    if not done:
        return np.zeros(0, np.int32), np.zeros(n, np.int64)
    words, found = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(words, kind="stable")
    return found[order], np.bincount(words, minlength=n)


def run_starts(s: Slice) -> np.ndarray:
    """Byte positions at which a document or a run of spaces begins."""
    at = np.zeros(len(s.data) + 1, bool)
    at[1:-1] = (s.data[1:] == 0x20) & (s.data[:-1] != 0x20)
    at[s.at] = True
    return np.flatnonzero(at[:-1])


class PieceEncoder(Encoder):
    """``encode(slice)``: (ids of all its documents, first id of each document)."""

    def __init__(self, path: str) -> None:
        self.vocabulary = v = Vocabulary(path)
        self.dtype = np.dtype("<u2") if v.size <= 1 << 16 else np.dtype("<u4")
        self.special: list[bytes] = []
        self.split = True
        self.cuts = run_starts if v.apart else (lambda s: np.unique(s.at[:-1][s.at[:-1] < s.at[1:]]))
        self._clear()
        self.runs: list[list[int]] = [[]]  # ids of so many spaces, by themselves
        self.periodic = False
        if v.runs_last:
            top = 2 * v.blanks
            ids, count = self._merged([SPACE * k for k in range(1, top + 1)])
            self.runs += [p.tolist() for p in np.split(ids, np.cumsum(count)[:-1])]
            self.periodic = all(self.runs[k] == self.runs[v.blanks] + self.runs[k - v.blanks] for k in range(v.blanks + 1, top + 1))

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        v = self.vocabulary
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int32)
        known = v.ids[points]
        ids, count = merge_rounds(v, np.where(known >= 0, known, -1 - points), np.fromiter(map(len, words), np.int64, len(words)))
        if (ids < 0).any():  # characters that are no pieces, as their bytes
            odd = ids < 0
            points = -1 - ids[odd]
            raw = np.frombuffer("".join(map(chr, points.tolist())).encode(), np.uint8)
            times = np.ones(len(ids), np.int64)
            times[odd] += (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            count = np.bincount(np.repeat(np.arange(len(count)), count), weights=times, minlength=len(count)).astype(np.int64)
            ids = np.repeat(ids, times)
            ids[ids < 0] = v.bytes[raw]
        return ids, count

    def _run(self, k: int) -> list[int]:
        whole, rest = divmod(k, self.vocabulary.blanks)
        return self.runs[k] if k < len(self.runs) else self.runs[self.vocabulary.blanks] * whole + self.runs[rest]

    def found(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.periodic:
            ids, count = self._merged([p.replace(" ", SPACE) for p in pieces])
            return ids.astype(self.dtype), count
        rests = [p.lstrip(" ") for p in pieces]
        spaces = [len(p) - len(r) for p, r in zip(pieces, rests, strict=True)]
        ids, count = self._merged([SPACE + r for r in rests])
        if max(spaces, default=1) > 1:
            parts = np.split(ids, np.cumsum(count)[:-1])
            alone = int(self.vocabulary.ids[ord(SPACE)])
            for i, k in enumerate(spaces):
                if k > 1:  # the last space is the word's, or one of the run if nothing took it
                    taken = int(parts[i][0]) != alone
                    parts[i] = np.array([*self._run(k - taken), *parts[i][0 if taken else 1 :].tolist()], np.int32)
            ids, count = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids.astype(self.dtype), count

    def encode(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        raw = s.data.tobytes()
        rows = [raw[a:b].replace(_MARK, b" ") for a, b in zip(s.at[:-1], s.at[1:], strict=True)] if _MARK in raw else None
        data = np.frombuffer(b"".join(rows), np.uint8) if rows is not None else s.data
        at = np.concatenate([[0], np.cumsum(list(map(len, rows)))]).astype(np.int64) if rows is not None else s.at
        some = at[1:] > at[:-1]
        data = np.insert(data, at[:-1][some], 0x20)  # the space before a text
        return self.by_pieces(Slice(s.start, s.stop, at + np.concatenate([[0], np.cumsum(some)]), data))


class Decoder:
    """``decode(ids)``: the text, as the library has it."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        v = vocabulary
        self.byte = {int(i): b for b, i in enumerate(v.bytes)}
        self.control, self.whole = v.control, {*map(int, v.bytes), v.unknown}
        self.parts = [bytes([self.byte[i]]) if i in self.byte else b"" if i in v.control else v.unknown_text.encode() if i == v.unknown else t.replace(SPACE, " ").encode() for i, t in enumerate(v.texts)]

    def decode(self, ids: list[int]) -> str:
        k = 0
        while k < len(ids) and ids[k] in self.control:
            k += 1
        raw = b"".join(map(self.parts.__getitem__, ids[k:]))
        lead = k < len(ids) and ids[k] not in self.whole and raw.startswith(b" ")  # the one that encoding puts there
        try:
            return raw[lead:].decode()
        except UnicodeDecodeError:  # bytes that are no character: each is U+FFFD
            return self._checked(ids[k:])[lead:]

    def _checked(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in [*ids, -1]:
            if i in self.byte:
                run.append(self.byte[i])
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[:n]).decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    out.append("�")
                del run[:n]
            if i >= 0:
                out.append(self.parts[i].decode())
        return "".join(out)


@lru_cache(maxsize=2)
def tools(path: str) -> tuple[PieceEncoder, Decoder]:
    """One encoder and one decoder a worker process."""
    encoder = PieceEncoder(path)
    return encoder, Decoder(encoder.vocabulary)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, _ = tools(path)
        for batch in batches:
            for s in slices(batch.column("text"), ENCODED_BYTES):
                ids, first = tool.encode(s)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s.start, s.rows), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of every row of (doc_id, ids); null ids have a null text."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, tool = tools(path)
        for batch in batches:
            found = [None if ids.as_py() is None else tool.decode(ids.as_py()) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, in one pass and without a shuffle."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, back = tools(path)
        decimal = [b"%d" % i for i in range(tool.vocabulary.size)]
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for s in slices(batch.column("text"), ENCODED_BYTES):
                ids, first = tool.encode(s)
                rows = [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
                columns = [pa.array(np.diff(first)), pa.array([sha(b",".join(map(decimal.__getitem__, r))) for r in rows]), pa.array([sha(back.decode(r).encode()) for r in rows])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s.start, s.rows), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return digests(documents(spark, sf_dir))
