"""Vectorised byte-level helpers shared by the Arrow-batch operators.

A batch of texts is handled as one byte buffer with document offsets, so the
per-word and per-position work is a few numpy passes over the buffer instead
of a Python loop.  Nothing here keeps state between batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# An odd multiplier (so it has an inverse mod 2**64) for the
# polynomial prefix hash, and the constants of the splitmix64 finaliser.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)

# Powers are kept for this many bytes; longer stretches restart the prefix.
SPAN = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_B
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) mod 2**64 (of the inverse base if asked)."""
    key = int(inverse)
    have = _POW.get(key)
    if have is None or len(have) < n:
        base = np.uint64(pow(int(BASE), -1, 1 << 64)) if inverse else BASE
        have = _POW[key] = _powers(base, max(n, 1 << 16))
    return have[:n]


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is an empty one."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        if not (pa.types.is_string(col.type) or pa.types.is_binary(col.type)):
            col = col.cast(pa.string())
        kind = np.int32
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    n = len(col)
    buffers = col.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[col.offset:col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def is_space(data: np.ndarray) -> np.ndarray:
    """The white space of the contracts: 0x20 and 0x09..0x0D."""
    return (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; every other byte as it is."""
    return np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(0x20), data)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document index) of every maximal run of non-space bytes;
    runs never cross documents."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~is_space(data)
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]      # a document edge ends and begins a word
    begin[inner] = solid[inner]
    stop[inner - 1] = solid[inner - 1]
    start = np.flatnonzero(begin)
    end = np.flatnonzero(stop) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    return start, end, doc


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for ordered, non-overlapping spans.

    sum((byte + 1) * BASE**(position in the span)) mod 2**64, then mixed: the
    bytes are weighted by their place in their own span, so equal spans hash
    alike wherever they stand."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    length = end - start
    at = np.repeat(start - np.concatenate(([0], np.cumsum(length)[:-1])), length) \
        + np.arange(int(length.sum()))
    place = at - np.repeat(start, length)
    terms = (data[at].astype(np.uint64) + np.uint64(1)) * powers(int(length.max()) + 1)[place]
    sums = np.add.reduceat(terms, np.concatenate(([0], np.cumsum(length)[:-1])))
    return mix64(sums + length.astype(np.uint64) * MIX_B)
