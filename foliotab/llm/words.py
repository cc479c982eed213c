"""Words, lines and n-grams of whole Arrow batches as numpy arrays.

A word is a maximal run of bytes other than space and TAB to CR (0x09-0x0D); UTF-8 has none of
these inside a character, so words can be cut on bytes. Hashes are 64-bit polynomial sums over
random byte values, so that the hash of any stretch comes from one running sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE, _INVERSE = 0x9E3779B97F4A7C13, pow(0x9E3779B97F4A7C13, -1, 1 << 64)
_BYTE_VALUE = np.random.default_rng(20240117).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def pieces(texts: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column into runs of whole texts of about ``most`` bytes: first and last row, bytes, offsets.

    Nulls are empty texts. A text longer than ``most`` is a run of its own; it is never cut.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a per-position array over each text."""
    sums = np.zeros(len(marks) + 1, np.float64 if marks.dtype.kind == "f" else np.int64)
    np.cumsum(marks, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


class Words:
    """Words of the texts of one piece: byte bounds, hashes, and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data, self.offsets = LOWER[data] if lower else data, offsets
        inside = ~SPACE[data]
        begins, ends = inside.copy(), inside.copy()
        if len(data):
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            at = offsets[:-1][offsets[:-1] < len(data)]
            begins[at] = inside[at]
            at = offsets[1:][offsets[1:] > 0] - 1
            ends[at] = inside[at]
        self.inside = inside
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.count = np.diff(self.first)
        self._sums: np.ndarray | None = None

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each stretch of bytes."""
        n = len(self.data)
        if self._sums is None:
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE_VALUE[self.data] * _power(_BASE, n), out=self._sums[1:])
        return mix((self._sums[ends] - self._sums[starts]) * _power(_INVERSE, n + 1)[starts])

    def hashes(self) -> np.ndarray:
        return self.spans(self.starts, self.ends)

    def text_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive values, in order."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = (out + hashes[j:j + n]) * np.uint64(0xA0761D6478BD642F)
    return mix(out)
