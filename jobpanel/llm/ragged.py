"""Ragged text in numpy: words, word hashes and runs inside Arrow string columns.

A batch of texts is one byte buffer with row offsets. Words are runs of the bytes
0-9, a-z and 0x80-0xFF after A-Z are lower-cased, which is the class of
characters `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` in UTF-8. A word's hash is a
polynomial over random byte weights modulo 2^64, so equal words have equal hashes
everywhere. Work goes in pieces of bounded size, whatever a text's length.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20

U64 = np.uint64
_MIX = U64(0xD6E8FEB86659FD93)
_ODD = U64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset:column.offset + len(column) + 1]
    buffer = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return buffer[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[pa.Array]:
    """Consecutive row ranges of at most `limit` bytes, or one longer row; memory goes back at the end."""
    _, offsets = text_bytes(column)
    start, n = 0, len(column)
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        yield column.slice(start, end - start)
        start = end
    release()


@functools.cache
def _trim() -> object:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def release() -> None:
    """Gives freed memory back to the system: workers live on between stages, idle."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(31))
    h = h * _MIX
    return h ^ (h >> U64(32))


@functools.cache
def _byte_weights() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=U64)[LOWER]


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of them; kept between calls up to one piece."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE_BYTES + 1024)
        inverse = U64(pow(int(_ODD), -1, 1 << 64))
        made = [np.cumprod(np.concatenate(([U64(1)], np.full(size - 1, b, dtype=U64)))) for b in (_ODD, inverse)]
        if size > 2 * PIECE_BYTES:
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def word_spans(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; a word never crosses a row."""
    inside = IS_WORD[buffer]
    edge = np.empty(len(inside) + 1, dtype=bool)
    edge[0], edge[-1] = True, True
    if len(inside):
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    keep = inside[starts] if len(starts) else np.empty(0, bool)
    return starts[keep], ends[keep]


def word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word, lower-cased."""
    out = np.empty(len(starts), dtype=U64)
    weights = _byte_weights()
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + PIECE_BYTES, side="right")))
        piece = buffer[base:int(ends[to - 1])]
        up, down = _powers(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, dtype=U64)
        np.cumsum(weights[piece] * up[:len(piece)], out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64))
        at = to
    return out


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column and the n + 1 word offsets of its rows."""
    buffer, offsets = text_bytes(column)
    starts, ends = word_spans(buffer, offsets)
    return word_hashes(buffer, starts, ends), np.searchsorted(starts, offsets)


def owners(offsets: np.ndarray) -> np.ndarray:
    """Row of every element of a ragged array."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


@functools.cache
def _gram_weights(n: int) -> np.ndarray:
    return np.random.default_rng(21).integers(1, 1 << 62, n, dtype=U64) << U64(1) | U64(1)


def grams(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of words that lie in one row, their first words' positions and their rows."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    row = owners(offsets)
    starts = np.flatnonzero(row[:count] == row[n - 1:]) if n > 1 else np.arange(count)
    total = np.full(len(starts), U64(n))
    for k, weight in enumerate(_gram_weights(n)):
        total += mix(hashes[starts + k] + U64(k)) * weight
    return mix(total), starts, row[starts]
