"""Words, word hashes and shingle hashes of whole Arrow batches, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once: arrays of some 20 times as many bytes stand in a worker. Longer texts are still taken whole.
SLICE = 512 << 10

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Letters and digits and all bytes beyond ASCII; what else there is parts words where asked for.
PLAIN = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """Powers from 0 on; those of a slice stay at hand, those of a longer text go with it."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE + 1), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= SLICE + 1:
            _powers[base] = have
    return have[:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; a null is an empty text."""
    a = column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts with ``most`` bytes together, or one longer text."""
    at = 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end
        at = end


class Words:
    """Words of some texts: ``start``, ``end`` (bytes), ``doc`` (text number) and 64-bit ``hash``; A-Z count as a-z.

    Words are split at white space, or consist of the bytes that ``letters`` holds.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, letters: np.ndarray | None = None):
        n = len(data)
        self.data = low = _LOWER[data]
        if letters is not None and n:
            # Capitals U+00C0 to U+00DE, but the multiplication sign, count as small ones.
            high = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
            low[high] += 0x20
        solid = ~_SPACE[low] if letters is None else letters[low]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        inner = offsets[1:-1]
        before[inner[inner < n]] = False
        after[inner[inner > 0] - 1] = False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.per_doc = np.bincount(self.doc, minlength=len(offsets) - 1) if len(offsets) > 1 else np.zeros(0, int)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[low] * _power(_BASE, n), out=run[1:])
        self.hash = mix64((run[self.end] - run[self.start]) * _power(_INVERSE, n + 1)[self.start] + (self.end - self.start).astype(np.uint64))


def words(column: pa.Array, most: int = SLICE, letters: np.ndarray | None = None) -> Iterator[tuple[int, int, Words]]:
    """``(first text, end, Words)`` for slices of a column; whole texts."""
    data, offsets = flat(column)
    for a, b in slices(offsets, most):
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], letters)


_STEP = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, hash)`` of every run of ``size`` words; a text with fewer words has one run of them all."""
    steps = [np.uint64(pow(int(_STEP[k % 5]), 1 + k // 5, 1 << 64)) for k in range(size)]
    n = len(w.hash)
    doc, value = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n >= size:
        m = n - size + 1
        total = w.hash[:m] * steps[0]
        for k in range(1, size):
            total = total + w.hash[k : k + m] * steps[k]
        inside = w.doc[:m] == w.doc[size - 1 :]
        doc, value = w.doc[:m][inside], mix64(total[inside])
    short = np.flatnonzero((w.per_doc > 0) & (w.per_doc < size))
    if len(short):
        first = np.searchsorted(w.doc, short)
        total = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = w.per_doc[short] > k
            total[has] += w.hash[first[has] + k] * steps[k]
        doc, value = np.concatenate([doc, short]), np.concatenate([value, mix64(total + w.per_doc[short].astype(np.uint64))])
        order = np.argsort(doc, kind="stable")
        doc, value = doc[order], value[order]
    return doc, value


class Lookup:
    """Numbers of known 64-bit hashes, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.r_[keys, np.uint64(0)]
        self.mask = np.uint64((1 << max(8, int(len(keys) * 4 - 1).bit_length())) - 1)
        self.slot = np.full(int(self.mask) + 1, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), keys & self.mask
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free][::-1]] = left[free][::-1]
            out = self.slot[at] != left
            left, at = left[out], (at[out] + np.uint64(1)) & self.mask

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash, -1 for unknown ones."""
        at = h & self.mask
        got = self.slot[at]
        miss = np.flatnonzero((got >= 0) & (self.keys[got] != h))
        while len(miss):
            at[miss] = (at[miss] + np.uint64(1)) & self.mask
            got[miss] = self.slot[at[miss]]
            miss = miss[(got[miss] >= 0) & (self.keys[got[miss]] != h[miss])]
        return got
