"""Words, word hashes and window hashes of many texts at once, on NumPy arrays over Arrow buffers.

A word is a run of bytes of one class; both classes used here are unions of ASCII sets
and "all bytes from 0x80", so working on UTF-8 bytes finds the same words as working
on code points.

A word's hash adds up its blocks of eight bytes, each mixed with a pseudo-random number for its place;
a window's hash mixes those of its two halves, down to words. Every step but the
sum is a 64-bit mixing that is not linear, so no pattern of words or letters makes two texts' hashes agree; different
words or windows agree by chance alone, with a probability of 2**-64 or little more for a pair. A second
family of hashes, of other numbers, is independent of the first: who decides by both is wrong with 2**-128.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_STEP = U64(0x9E3779B97F4A7C15)

# For the first and the second family of hashes.
_SEEDS = (U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB))
_LEFT = (U64(0x8EBC6AF09C88C6E3), U64(0x589965CC75374CC3))
_RIGHT = (U64(0xC2B2AE3D27D4EB4F), U64(0x1D8E4E27C47D124F))

#: Bytes of a word: everything but space and 0x09-0x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of a word: digits, a-z and all that is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: The first k bytes of a little-endian block, for k from 0 to 8.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


class Words:
    """Words of a list of texts. start, end: byte offsets; doc: the text's index; h: hash."""

    def __init__(self, texts: pa.Array, table: np.ndarray = NOT_SPACE, lower: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, at, raw = texts.buffers()
        n = len(texts)
        self.n_docs = n
        offsets = np.frombuffer(at, np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
        raw = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and n else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.raw = raw
        padded = np.zeros(len(raw) + 8, np.uint8)
        data = padded[:-8]
        data[:] = LOWER[raw] if lower else raw
        self.data = data
        self._blocks = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))  # eight bytes from each place on
        inside = table[data]
        edge = self.offsets[:-1][np.diff(self.offsets) > 0]
        first, last = inside.copy(), inside.copy()
        if len(data):
            first[1:] &= ~inside[:-1]
            first[edge] |= inside[edge]
            last[:-1] &= ~inside[1:]
            before = edge[edge > 0] - 1
            last[before] |= inside[before]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        bounds = np.searchsorted(self.start, self.offsets)
        self.bounds = bounds  # words of text i: bounds[i] .. bounds[i + 1]
        self.count = np.diff(bounds)
        self.doc = np.repeat(np.arange(n), self.count)
        self.h = self.hashes(0, len(self))
        self._second: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, lo: int, hi: int, family: int = 0) -> np.ndarray:
        """Of the words lo .. hi - 1; of words that start within 1 MB at a time, so a long text needs little more memory."""
        out = [np.zeros(0, U64)]
        while lo < hi:
            to = min(hi, int(np.searchsorted(self.start, self.start[lo] + (1 << 20))))
            out.append(self.hash_of(np.arange(lo, to), family))
            lo = to
        return np.concatenate(out)

    def hash_of(self, words: np.ndarray, family: int = 0) -> np.ndarray:
        """Of some words, given by their numbers."""
        start, size = self.start[words], self.end[words] - self.start[words]
        seed = _SEEDS[family]
        total = mix((self._blocks[start] & _MASKS[np.minimum(size, 8)]) ^ seed)
        more = np.flatnonzero(size > 8)
        if len(more):
            n = (size[more] - 1) // 8  # blocks after the first
            first = np.cumsum(n) - n
            k = np.arange(int(n.sum())) - np.repeat(first, n) + 1
            rest = np.repeat(size[more], n) - 8 * k
            block = self._blocks[np.repeat(start[more], n) + 8 * k] & _MASKS[np.minimum(rest, 8)]
            total[more] += np.add.reduceat(mix(block ^ mix(k.astype(U64) * _STEP + seed)), first)
        return mix(total + size.astype(U64) * _STEP)

    @property
    def second(self) -> np.ndarray:
        """Hashes of the second family."""
        if self._second is None:
            self._second = self.hashes(0, len(self), 1)
        return self._second

    def windows(self, n: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each window of n words, and whether its words are of one text. Lengths: len(self) - n + 1."""
        return window_hashes(self.second if family else self.h, n, family), self.whole(n)

    def windows_at(self, starts: np.ndarray, n: int, family: int = 0) -> np.ndarray:
        """Hashes of the windows of n words that start at some words, found from these words alone."""
        if not len(starts):
            return np.zeros(0, U64)
        inside = cover(starts, n, len(self))
        own = np.flatnonzero(inside)  # a window's words stay neighbours
        return window_hashes(self.hash_of(own, family), n, family)[(np.cumsum(inside) - 1)[starts]]

    def whole(self, n: int) -> np.ndarray:
        m = max(0, len(self) - n + 1)
        return self.doc[:m] == self.doc[n - 1 : n - 1 + m]


def longer(h: np.ndarray, half: int, n: int, family: int = 0) -> np.ndarray:
    """Hashes of windows of n words from those of ``half`` words, n / 2 <= half < n, along the last axis."""
    m = max(0, h.shape[-1] - (n - half))
    return mix(h[..., :m] * _LEFT[family] + h[..., n - half : n - half + m] * _RIGHT[family] + U64(n))


def window_hashes(h: np.ndarray, n: int, family: int = 0) -> np.ndarray:
    """Hash of each run of n consecutive hashes, along the last axis."""
    if n == 1:
        return mix(h + U64(1))
    half = (n + 1) // 2
    return longer(window_hashes(h, half, family), half, n, family)


def minima(values: np.ndarray, w: int, one: np.ndarray) -> np.ndarray:
    """Winnowing: which values are the smallest of some window of w values. one: whether the window that starts there is of one text."""
    m = len(values) - w + 1
    picked = np.zeros(len(values), bool)
    if m <= 0:
        return picked
    least = values[:m].copy()
    for k in range(1, w):
        np.minimum(least, values[k : k + m], out=least)
    for k in range(w):
        picked[k : k + m] |= (values[k : k + m] == least) & one[:m]
    return picked


def cover(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n positions lie in some run [start, start + length)."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def member(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is in a sorted table, and where."""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values, at


def slices(texts: pa.Array, most: int = 3 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes of text each, one row at least."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def joined_words(w: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    own = np.flatnonzero(keep)
    length = w.end[own] - w.start[own] + 1
    to = np.cumsum(length)
    out = np.append(w.raw, np.uint8(32))[np.arange(to[-1] if len(to) else 0) + np.repeat(w.start[own] - (to - length), length)]
    out[to - 1] = 32
    edge = np.append(0, to)[np.searchsorted(own, w.bounds)]
    inner = np.ones(len(out), bool)  # no space after a text's last word
    last = edge[1:][np.diff(edge) > 0] - 1
    inner[last] = False
    at = edge - np.searchsorted(last, edge)
    return pa.Array.from_buffers(pa.large_string(), w.n_docs, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(out[inner].tobytes())]).cast(pa.string())


def lean(f):
    """A function of batches whose worker gives unused memory back when a task ends: workers outlive tasks, and executors' memory is shared with the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return run


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    c = batch.column(batch.schema.get_field_index(name))
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
