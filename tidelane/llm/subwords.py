"""Text columns as byte buffers for numpy: slices of an Arrow column, words and character n-grams by position."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = 32
SLICE_BYTES = 1 << 21  # text handled at once; a longer text is a slice of its own

SPACED = np.arange(256, dtype=np.uint8)  # the six ASCII spaces become one
SPACED[[9, 10, 11, 12, 13]] = SPACE
FOLDED = SPACED.copy()  # lower case; ASCII that is no letter separates words
FOLDED[[b for b in range(128) if not chr(b).isalpha()]] = SPACE
FOLDED[65:91] = np.arange(97, 123)


@dataclass
class Slice:
    lo: int  # rows lo to hi - 1 of the column
    hi: int
    buf: np.ndarray  # a space, then each text followed by a space
    starts: np.ndarray  # of each text in buf
    lengths: np.ndarray


def row_ranges(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(lo, hi) of consecutive rows whose texts have about ``limit`` bytes."""
    total = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(total):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + limit, side="right")))
        yield lo, hi
        lo = hi


def slices(column: pa.Array, table: np.ndarray = SPACED, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of a string column, mapped by ``table``, in slices of about ``limit`` bytes."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for lo, hi in row_ranges(column, limit):
        part = column.slice(lo, hi - lo).to_pylist()
        raw = b" " + b" ".join([(x or "").encode() for x in part]) + b" "
        lengths = sizes[lo:hi]
        yield Slice(lo, hi, table[np.frombuffer(raw, np.uint8)], 1 + np.cumsum(lengths + 1) - lengths - 1, lengths)


def grams(buf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, usable) at each position: the n bytes from there packed into an integer (n <= 8); usable where no
    space is inside the gram, so that one at either end marks the edge of a word."""
    m = max(0, len(buf) - n + 1)
    keys = np.zeros(m, np.uint64)
    for j in range(n):
        keys = (keys << np.uint64(8)) | buf[j : j + m]
    usable = np.ones(m, bool)
    for j in range(1, n - 1):
        usable &= buf[j : j + m] != SPACE
    return keys, usable


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs between spaces."""
    inside = np.concatenate(([False], buf != SPACE, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(keys: np.ndarray, salt: int = 0) -> np.ndarray:
    """Well-spread 64-bit hashes of integer keys."""
    x = (keys ^ np.uint64(salt)) * _ODD
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_NEAR = 64  # places in a word whose terms are looked up
_TERMS = mixed(np.arange(_NEAR << 8, dtype=np.uint64), 17)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, equal for equal words: a mixed sum of one term for each byte and its place in
    the word, whatever the word's length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) - np.repeat(first, sizes)
    code = place << 8 | buf[place + np.repeat(starts, sizes)]
    terms = _TERMS[np.minimum(code, len(_TERMS) - 1)]
    far = np.flatnonzero(place >= _NEAR)
    terms[far] = mixed(code[far].astype(np.uint64), 17)
    return mixed(np.add.reduceat(terms, first) + sizes.astype(np.uint64) * _ODD, 5)
