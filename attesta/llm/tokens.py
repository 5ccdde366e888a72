"""Encoding with a tokenizer of the tokenizers library, fast enough to run over a corpus.

A byte-level vocabulary splits a text before it merges.  Two kinds of place always lie between two pieces of that split:
before a space that a character other than white space follows, and between a letter and a punctuation mark after it.  So
texts are cut there, by vectorised comparisons over their bytes; each distinct piece is encoded once in a worker, its ids
are kept in flat arrays under a sorted 64-bit hash, and a document is the concatenation of its pieces' ids.  A kept piece is
used only where a second word agrees too, made of its length and its first and last eight bytes (all of a piece of up to 16
bytes); other pieces of that hash, and pieces of more than ``LONGEST`` bytes, are encoded where they stand.  Pieces of common scripts go to the library's merging model directly, others through the whole tokenizer.  A vocabulary of another
kind takes whole texts, and so does a text that holds the string of a special token, for which the library gives that token's id.
``tests/llm`` holds the ways against each other.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

from attesta.llm.common import Slice, SpanHash, mix, slices

#: Bytes of text encoded at once: fewer, larger slices find more pieces equal before they are looked up.
ENCODED_BYTES = 1 << 20
#: Pieces that a worker keeps (about 35 bytes each), and ids of them; beyond that it starts anew.
KEPT_PIECES, KEPT_IDS = 1_000_000, 1 << 23
#: Bytes of a piece that is kept: constructed strings whose hashes agree are longer.
LONGEST = 256
#: Characters from here on take the library's own way, for classes of later Unicode versions may differ.
_PLAIN = "ɐ"

_LETTER, _PUNCTUATION, _AFTER_SPACE = np.zeros(256, bool), np.zeros(256, bool), np.ones(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
#: White space, and bytes with which white space beyond ASCII can begin.
_AFTER_SPACE[[*range(0x21), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False


def _byte_characters() -> dict[int, str]:
    """The visible character by which a byte-level vocabulary writes each byte: itself, or the next free one from 256."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


def cuts(s: Slice) -> np.ndarray:
    """Byte positions at which pieces start."""
    d = s.data
    at = np.zeros(len(d) + 1, bool)
    at[:-2] |= (d[:-1] == 0x20) & _AFTER_SPACE[d[1:]]
    at[1:-1] |= _LETTER[d[:-1]] & _PUNCTUATION[d[1:]]
    at[s.at] = True
    return np.flatnonzero(at[:-1])


def marks(s: Slice, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A word from the length and the first and last eight bytes of each piece, or what there is of them."""
    around = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(8, np.uint8), s.data, np.zeros(8, np.uint8)]), 8)
    rest = (8 * (8 - np.minimum(end - start, 8))).astype(np.uint64)  # bits of a word that aren't the piece's
    head, tail = (around[at].view("<u8").ravel().astype(np.uint64, copy=False) for at in (start + 8, end))
    return mix(mix(head << rest) + (tail >> rest) * np.uint64(0x9E3779B97F4A7C15) + (end - start).astype(np.uint64))


class Encoder:
    """``encode(slice)``: (ids of all its documents, first id of each document)."""

    cuts = staticmethod(cuts)

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        with open(path, encoding="utf-8") as f:
            kind = (spec := json.load(f)).get("pre_tokenizer") or {}
        #: Splits a piece as the library does; None for a vocabulary that splits in another way.
        self.split = regex.compile(public_tokenizers.PATTERN).findall if kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not spec.get("normalizer") else None
        self.special = [x["content"].encode() for x in spec.get("added_tokens") or ()]
        self.characters = str.maketrans(_byte_characters())
        self.merge = self.tokenizer.model.tokenize
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.place = np.zeros(0, np.int32)  # of a key in first and count
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.marks = np.zeros(0, np.uint64)
        self.flat = np.zeros(1 << 16, self.dtype)
        self.used = 0

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> list[int]:
        if max(piece) >= _PLAIN:
            return self.whole([piece])[0]
        spelled = piece.encode().decode("latin-1").translate(self.characters)
        if piece.isalpha() or piece[0] == " " and piece[1:].isalpha():
            return [t.id for t in self.merge(spelled)]
        out, i = [], 0
        for part in self.split(piece):
            n = len(part.encode())
            out += [t.id for t in self.merge(spelled[i : i + n])]
            i += n
        return out

    def found(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, their number in each)."""
        found = list(map(self._piece, pieces))
        count = np.fromiter(map(len, found), np.int32, len(found))
        return np.fromiter(chain.from_iterable(found), self.dtype, int(count.sum())), count

    def _store(self, pieces: list[str]) -> np.ndarray:
        """Places of the pieces' ids."""
        ids, count = self.found(pieces)
        total = len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), self.dtype)])
        self.flat[self.used : self.used + total] = ids
        place = np.arange(len(count), dtype=np.int32) + len(self.first)
        self.first = np.concatenate([self.first, self.used + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.used += total
        return place

    def _learn(self, keys: np.ndarray, place: np.ndarray, own: np.ndarray) -> None:
        at = np.searchsorted(self.keys, keys)
        self.keys, self.place, self.marks = np.insert(self.keys, at, keys), np.insert(self.place, at, place), np.insert(self.marks, at, own)

    @staticmethod
    def hashes(s: Slice, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return SpanHash(s.data).of(start, end)

    def encode(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        raw = s.data.tobytes()
        whole = np.full(s.rows, self.split is None)
        for word in self.special if self.split else ():
            i = raw.find(word)
            while i >= 0:  # also where a string lies across two documents, which does no harm
                whole[np.searchsorted(s.at, i, "right") - 1] = True
                i = raw.find(word, i + len(word))
        if not whole.any():
            return self.by_pieces(s)
        parts, count = [], []
        for i in range(s.rows):
            a, b = int(s.at[i]), int(s.at[i + 1])
            parts.append(np.array(self.whole([raw[a:b].decode()])[0], self.dtype) if whole[i] else self.by_pieces(Slice(i, i + 1, s.at[i : i + 2] - a, s.data[a:b]))[0])
            count.append(len(parts[-1]))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(count)]).astype(np.int64)

    def by_pieces(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        start = self.cuts(s)
        if not len(start):
            return np.zeros(0, self.dtype), np.zeros(s.rows + 1, np.int64)
        end = np.concatenate([start[1:], [len(s.data)]])
        mark = marks(s, start, end)
        if len(self.first) > KEPT_PIECES or self.used > KEPT_IDS:
            self._clear()
        raw: bytes | None = None

        def texts(at: np.ndarray) -> list[str]:
            nonlocal raw
            raw = raw if raw is not None else s.data.tobytes()
            return [raw[a:b].decode() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]

        keys, example, back = np.unique(self.hashes(s, start, end), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = np.flatnonzero(((self.keys[at] != keys) if len(self.keys) else np.ones(len(keys), bool)) & ((end - start)[example] <= LONGEST))
        if len(new):
            self._learn(keys[new], self._store(texts(example[new])), mark[example[new]])
        place = np.zeros(len(keys), np.int32)
        own = np.ones(len(start), bool)  # pieces that are encoded where they stand
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            place = self.place[at]
            own = (self.keys[at] != keys)[back] | (mark != self.marks[at][back])
        place = place[back]
        if own.any():
            place[own] = self._store(texts(np.flatnonzero(own)))
        count = self.count[place].astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.repeat(self.first[place] - sums[:-1], count) + np.arange(sums[-1])]
        return ids, sums[np.searchsorted(start, s.at)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    return Encoder(path)


def encoded(batch: pa.RecordBatch, path: str, end_id: int) -> Iterator[tuple[Slice, np.ndarray, np.ndarray]]:
    """For each slice of a batch with a column ``text``: the slice, its documents' ids each with ``end_id`` after them, and
    where each document's ids start."""
    tool = encoder(path)
    for s in slices(batch.column("text"), ENCODED_BYTES):
        ids, first = tool.encode(s)
        yield s, np.insert(ids, first[1:], np.array(end_id, ids.dtype)), first + np.arange(len(first))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
