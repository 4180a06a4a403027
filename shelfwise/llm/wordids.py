"""Token ids of many texts through a memory of their pieces.

A tokenizer that never joins characters across certain places of a text may be
run on the pieces between them, and a piece that comes again need not be run
again.  The texts of an Arrow column are cut in numpy, Arrow numbers the
distinct pieces, and only those the worker has not met reach the tokenizer; the
ids of all texts are then gathered by offsets.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textbytes import span_hash, text_buffer

MEMORY_PIECES = 1_000_000  # distinct pieces kept between slices (some 50 bytes each)
MEMORY_IDS = 8_000_000     # and their ids
LONG_PIECE = 64            # bytes beyond which a piece is not looked for in the memory
BATCH = 20_000             # pieces handed to a tokenizer at a time


def _set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, z in ranges:
        out[a:z + 1] = True
    return out


# Bytes of visible ASCII, of ASCII letters and ASCII marks, and
# the first bytes of the characters among which Unicode has white space.
VISIBLE = _set((0x21, 0x7E))
LETTER = _set((0x41, 0x5A), (0x61, 0x7A))
MARK = _set((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
SPACE_LEAD = _set((0xC2, 0xC2), (0xE1, 0xE3))
# two-byte letters: U+00C0 to U+017F, but for the signs of times and division
LATIN_LEAD = _set((0xC3, 0xC5))


def _solid_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The character that ends before each place is surely no white space."""
    one = data[at - 1]
    two, three = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    unsure = SPACE_LEAD[two] | (SPACE_LEAD[three] & (two >= 0x80) & (two < 0xC0))
    return VISIBLE[one] | ((one >= 0x80) & ~unsure)


def word_cuts(data: np.ndarray) -> np.ndarray:
    """Places of a plain space between two characters that are no white space."""
    at = np.flatnonzero(data[1:-1] == 0x20) + 1 if len(data) > 2 else np.zeros(0, np.int64)
    after = data[at + 1]
    return at[(VISIBLE[after] | ((after >= 0x80) & ~SPACE_LEAD[after])) & _solid_before(data, at)]


def mark_cuts(data: np.ndarray) -> np.ndarray:
    """Places where a mark follows a letter, or a line's end a character that
    is no white space.  A byte-level pre-tokenizer that takes runs of letters,
    of digits, of marks and of white space each by themselves (but for one
    leading space, and the likes of 's) never joins characters there."""
    at = np.flatnonzero(MARK[data[1:]]) + 1
    two = data[np.maximum(at - 2, 0)]
    one = data[at - 1]
    latin = LATIN_LEAD[two] & (one >= 0x80) & ~((two == 0xC3) & ((one == 0x97) | (one == 0xB7)))
    line = np.flatnonzero(data[1:] == 0x0A) + 1
    return np.concatenate((at[LETTER[one] | latin], line[_solid_before(data, line)]))


class PieceEncoder:
    """``encode``: pieces (texts) to lists of ids.  ``fine``: cut at marks as
    well as at words.  ``whole``: strings whose texts are not cut.  ``joined``:
    the bytes of a list of ids; a piece whose ids give other bytes is not
    ``faithful``."""

    def __init__(self, encode: Callable, vocabulary: int, fine: bool, whole: tuple[str, ...] = (),
                 joined: Callable | None = None):
        self.run, self.fine, self.whole, self.joined = encode, fine, whole, joined
        self.vocabulary = vocabulary
        self.dtype = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")
        self.forget()

    def forget(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        # by place: the ids and the bytes of each piece, in two long arrays
        self.ids, self.bytes = np.zeros(0, self.dtype), np.zeros(0, np.uint8)
        self.start, self.size, self.at, self.length = (np.zeros(0, np.int64) for _ in range(4))
        self.faithful = np.zeros(0, bool)

    def _recall(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray, h: np.ndarray):
        """Place of each piece, -1 if unknown: same hash, length and bytes."""
        if not len(self.keys):
            return np.full(len(h), -1)
        near = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        place = np.where(self.keys[near] == h, self.place[near], -1)
        hit = np.flatnonzero((place >= 0) & (self.length[place] == length))
        n = length[hit]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        same = (data[np.repeat(begin[hit], n) + step]
                == self.bytes[np.repeat(self.at[place[hit]], n) + step])
        wrong = np.bincount(np.repeat(np.arange(len(hit)), n), ~same, len(hit)) > 0
        out = np.full(len(h), -1)
        out[hit[~wrong]] = place[hit[~wrong]]
        return out

    def _learn(self, fresh: list[bytes]) -> np.ndarray:
        """Places of new pieces."""
        lists = []
        for a in range(0, len(fresh), BATCH):
            lists += self.run([x.decode() for x in fresh[a:a + BATCH]])
        size = np.array([len(x) for x in lists], np.int64)
        length = np.array([len(x) for x in fresh], np.int64)
        ids = np.fromiter((i for x in lists for i in x), self.dtype, int(size.sum()))
        place = len(self.size) + np.arange(len(fresh))
        self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(size) - size))
        self.at = np.concatenate((self.at, len(self.bytes) + np.cumsum(length) - length))
        self.size, self.ids = np.concatenate((self.size, size)), np.concatenate((self.ids, ids))
        self.length = np.concatenate((self.length, length))
        self.bytes = np.concatenate((self.bytes, np.frombuffer(b"".join(fresh), np.uint8)))
        if self.joined is not None:
            same = [self.joined(x) == p for x, p in zip(lists, fresh)]
            self.faithful = np.concatenate((self.faithful, np.array(same, bool)))
        return place

    def _number(self, distinct: pa.Array) -> np.ndarray:
        """Place of each of the distinct pieces, learning those unknown."""
        if len(self.size) > MEMORY_PIECES or len(self.ids) > MEMORY_IDS:
            self.forget()
        data, edge = text_buffer(distinct)
        begin, length = edge[:-1], np.diff(edge)
        short = np.flatnonzero(length <= LONG_PIECE)
        out = np.full(len(length), -1)
        h = np.zeros(len(length), np.uint64)
        # spans of short pieces, in order
        h[short] = span_hash(data, begin[short], edge[1:][short])
        out[short] = self._recall(data, begin[short], length[short], h[short])
        fresh = np.flatnonzero(out < 0)
        if len(fresh):
            out[fresh] = self._learn(distinct.take(pa.array(fresh)).to_pylist())
            keep = fresh[length[fresh] <= LONG_PIECE]
            keep = keep[np.argsort(h[keep], kind="stable")]
            at = np.searchsorted(self.keys, h[keep])
            self.keys = np.insert(self.keys, at, h[keep])
            self.place = np.insert(self.place, at, out[keep])
        return out

    def codes(self, data: np.ndarray, offsets: np.ndarray, uncut: np.ndarray | None = None):
        """(code of each piece, text of each piece) of texts in one buffer."""
        at = word_cuts(data)
        if self.fine:
            at = np.concatenate((at, mark_cuts(data)))
        if uncut is not None and uncut.any():
            at = at[~uncut[np.searchsorted(offsets, at, side="right") - 1]]
        edges = offsets[:-1][np.diff(offsets) > 0]
        # places and edges are few: a mark for each byte, read off in order
        begins = np.zeros(len(data) + 1, bool)
        begins[at], begins[edges] = True, True
        begins[len(data)] = True
        at = np.flatnonzero(begins)
        if len(at) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pieces = pa.Array.from_buffers(pa.binary(), len(at) - 1,
                                       [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
        numbered = pc.dictionary_encode(pieces)
        return (self._number(numbered.dictionary)[numbered.indices.to_numpy()],
                np.searchsorted(offsets, at[:-1], side="right") - 1)

    def gather(self, code: np.ndarray) -> np.ndarray:
        """The ids of the pieces, one after the other."""
        size = self.size[code]
        begin = np.cumsum(size) - size
        return self.ids[np.repeat(self.start[code] - begin, size) + np.arange(int(size.sum()))]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); a null text has none."""
        data, offsets = text_buffer(texts)
        uncut = None
        for s in self.whole:
            has = pc.match_substring(texts, s).fill_null(False).to_numpy(zero_copy_only=False)
            uncut = has if uncut is None else uncut | has
        code, text = self.codes(data, offsets, uncut)
        count = np.bincount(text, self.size[code], len(texts)).astype(np.int64)
        return self.gather(code), count


def kept(key: str, make: Callable):
    """What ``make`` returned first in this worker process.

    This module reaches a worker by value, anew with each task, so what lasts
    between tasks is kept in a module of the worker's own."""
    name = "_shelfwise_worker_memory"
    memory = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if key not in memory:
        memory[key] = make()
    return memory[key]


def byte_bpe(path: str | None, special: bool) -> PieceEncoder:
    """A byte-level BPE of the tokenizers library; ``None`` is the public one.
    ``special``: strings of special tokens in a text are ordinary text;
    otherwise they get their own ids, as in a plain call."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark has one task per core already
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")

    def make():
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = special
        names = () if special else tuple(
            t.content for t in tok.get_added_tokens_decoder().values())
        spell = byte_spelling(tok)
        return PieceEncoder(
            lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)],
            tok.get_vocab_size(), True, names, lambda ids: b"".join([spell[i] for i in ids]))

    return kept(f"bytes {path} {special}", make)


def byte_spelling(tok) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary: visible characters of
    Latin-1 stand for their own byte, the 68 others for U+0100 onwards."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    byte = {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}
    out = [b""] * tok.get_vocab_size()
    for entry, i in tok.get_vocab().items():
        out[i] = (bytes(byte[c] for c in entry) if all(c in byte for c in entry)
                  else entry.encode())
    return out


def piece_bpe(path: str | None) -> PieceEncoder:
    """A sentencepiece model that adds a leading space; ``None`` is the public
    one.  Every text must begin with that space already: it is left to the
    model to add.  Cut at words if no entry goes on after a space."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")

    def make():
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        entries = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        spell = [bytes([int(e[3:5], 16)]) if model.is_byte(i) else e.replace("▁", " ").encode()
                 for i, e in enumerate(entries)]
        cut = not any("▁" in e.lstrip("▁") for e in entries)
        return PieceEncoder(lambda texts: model.encode([t[1:] for t in texts], num_threads=1),
                            len(entries), False, () if cut else ("",),
                            lambda ids: b"".join([spell[i] for i in ids]))

    return kept(f"pieces {path}", make)
