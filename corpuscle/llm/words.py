"""Words, windows and their hashes, straight from the UTF-8 bytes of an Arrow column.

The functions run inside ``mapInArrow`` tasks.  A batch is worked on in pieces of a few megabytes of text (a longer
document is a piece of its own), so memory does not grow with the batch.  Every separator is an ASCII byte, which
never occurs inside a longer UTF-8 sequence; words can therefore be cut in bytes.

A word is hashed as a polynomial over random byte values modulo 2**64, then mixed; windows of words likewise over the
mixed word hashes.  Equal words always get equal hashes, unequal ones collide with a probability near 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1_000_000

SPACES = bytes([0x20, *range(0x09, 0x0E)])
NOT_SPACE = np.array([b not in SPACES for b in range(256)])
LETTERS_AND_DIGITS = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

_random = np.random.default_rng(20240607)
_BYTE_VALUE = _random.integers(0, 2**64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 12), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 4 * PIECE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def before(mask: np.ndarray) -> np.ndarray:
    """Running count: item i is the sum of the first i values."""
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


@dataclass
class Piece:
    """Some consecutive documents of a batch: rows ``first`` to ``first + n``, their bytes, and where each begins."""
    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """Cut a string column into pieces of at most ``limit`` bytes, or one document.  A null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield Piece(first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
        first = last


@dataclass
class Words:
    """Words of a piece: byte ranges, hashes, and for each document the index of its first word (one more at the end)."""
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * powers(_BASE, n), out=total[1:])
    value = (total[end] - total[start]) * powers(_INVERSE, n + 1)[start]
    return mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(piece: Piece, inside: np.ndarray = NOT_SPACE, hashed: bool = True) -> Words:
    """Maximal runs of bytes with ``inside[byte]``, never across documents."""
    is_word = inside[piece.data]
    begins, ends = is_word.copy(), is_word.copy()
    begins[1:] &= ~is_word[:-1]
    ends[:-1] &= ~is_word[1:]
    edges = piece.offsets[:-1]
    edges = edges[(edges > 0) & (edges < len(is_word))]
    begins[edges] = is_word[edges]
    ends[edges - 1] = is_word[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    value = range_hash(piece.data, start, end) if hashed else np.zeros(0, np.uint64)
    return Words(start, end, value, np.searchsorted(start, piece.offsets))


def windows(w: Words, size: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(index of first word, hash) of every run of ``size`` words inside one document."""
    n = len(w.start)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    base = (0xC2B2AE3D27D4EB4F + 16 * salt) | 5
    if size <= 12:
        value = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            value = value * np.uint64(base) + w.hash[k:n - size + 1 + k]
    else:
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(w.hash * powers(base, n), out=total[1:])
        value = (total[size:] - total[:-size]) * powers(pow(base, -1, 2**64), n)[:n - size + 1]
    document = w.document
    at = np.flatnonzero(document[:n - size + 1] == document[size - 1:])
    return at, mix(value[at] + np.uint64(size))


def covered(n: int, at: np.ndarray, size) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``size`` words that begins at one of ``at``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.subtract.at(step, at + size, 1)
    return np.cumsum(step[:-1]) > 0


def per_document(w: Words, mask: np.ndarray) -> np.ndarray:
    """How many words of each document are marked."""
    return np.diff(before(mask)[w.first])
