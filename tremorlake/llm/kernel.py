"""Vectorised text kernels shared by the training-data operators.

A *word* is a maximal run of ASCII letters, digits, underscores or non-ASCII
bytes, after case folding. Folding lowers each character whose lower case has
the same UTF-8 length, so byte offsets in folded text are offsets in the
original. Nulls count as empty text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_WORD = np.zeros(256, bool)
for _r in (range(48, 58), range(65, 91), range(97, 123), (95,), range(128, 256)):
    _WORD[list(_r)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SEGMENT = 1 << 20
_pow: np.ndarray = np.ones(1, np.uint64)
_inv: np.ndarray = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        for name, base in (("_pow", _P), ("_inv", _PINV)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            globals()[name] = np.multiply.accumulate(x)
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of two hashes."""
    return mix(a * np.uint64(0x9DDFEA08EB382D69) + (b ^ np.uint64(0xC2B2AE3D27D4EB4F)))


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; row i is bytes[offsets[i]:offsets[i+1]]."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and len(column) else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def fold(data: np.ndarray) -> np.ndarray:
    """Case-folded copy of UTF-8 bytes, of the same length."""
    out = _LOWER[data]
    if data.size and int(data.max()) >= 0xC4:
        text = data.tobytes().decode("utf-8", "replace")
        text = "".join(c if c.isascii() else low if len(low := c.lower()) == 1 and len(low.encode()) == len(c.encode()) else c for c in text)
        b = text.lower().encode() if text.isascii() else text.encode()
        if len(b) == data.size:
            return _LOWER[np.frombuffer(b, np.uint8)]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = data[after]
    up = after[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]
    out[up] += 0x20
    return out


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, first) of the words; row i has the words first[i]:first[i+1]."""
    n = data.size
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(offs), np.int64)
    low = fold(data)
    is_w = _WORD[low]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    prev = np.empty(n, bool)
    prev[0] = False
    prev[1:] = is_w[:-1]
    start = np.flatnonzero(is_w & (~prev | edge[:-1]))
    nxt = np.empty(n, bool)
    nxt[-1] = False
    nxt[:-1] = is_w[1:]
    end = np.flatnonzero(is_w & (~nxt | edge[1:])) + 1
    h = span_hash(low, start, end)
    return h, start, end, np.searchsorted(start, offs)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ascending, disjoint spans, in segments that bound memory."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        s0 = start[i]
        j = max(i + 1, int(np.searchsorted(end, s0 + _SEGMENT, "right")))
        seg = data[s0 : end[j - 1]]
        p, inv = _tables(max(_SEGMENT, len(seg)) + 1)
        acc = np.empty(len(seg) + 1, np.uint64)
        acc[0] = 0
        np.cumsum((seg.astype(np.uint64) + np.uint64(1)) * p[: len(seg)], out=acc[1:])
        s, e = start[i:j] - s0, end[i:j] - s0
        out[i:j] = mix((acc[e] - acc[s]) * inv[s] + (e - s).astype(np.uint64))
        i = j
    return out


def ngrams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of word n-grams within rows; a row of 1 to n-1 words gives one gram of all its words."""
    count = np.diff(first)
    g = h.copy()
    for k in range(1, n):
        g[: len(h) - k] = combine(g[: len(h) - k], h[k:])
    row = np.repeat(np.arange(len(count)), count)
    full = np.arange(len(h)) + n <= np.repeat(first[1:], count)
    short = np.flatnonzero((count > 0) & (count < n))
    g, row = g[full], row[full]
    if len(short):
        extra = np.array([fold_all(h[first[i] : first[i + 1]]) for i in short], np.uint64)
        g, row = np.concatenate([g, extra]), np.concatenate([row, short])
        o = np.argsort(row, kind="stable")
        g, row = g[o], row[o]
    return g, row


def fold_all(h: np.ndarray) -> int:
    x = h[:1] ^ np.uint64(0x5BD1E995)
    for k in range(1, len(h)):
        x = combine(x, h[k : k + 1])
    return int(x[0])


def release() -> None:
    """Gives freed memory back to the system: workers live on after their task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about `most` bytes of text, a single longer text alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = raw(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j
    release()


class Lookup:
    """Sorted 64-bit keys with a direct index on their top bits; find() gives positions, -1 where absent."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(1, min(26, int(len(keys)).bit_length()))
        self.shift = np.uint64(64 - self.bits)
        edges = np.arange((1 << self.bits) + 1, dtype=np.float64)
        top = (keys >> self.shift).astype(np.int64)
        self.at = np.searchsorted(top, edges[:-1]).astype(np.int32)
        self.at = np.append(self.at, np.int32(len(keys)))

    def find(self, q: np.ndarray) -> np.ndarray:
        out = np.full(len(q), -1, np.int32)
        if not len(self.keys) or not len(q):
            return out
        b = (q >> self.shift).astype(np.int64)
        lo, hi = self.at[b], self.at[b + 1]
        idx = np.flatnonzero(lo < hi)
        lo, hi, q = lo[idx], hi[idx], q[idx]
        while len(idx):
            k = self.keys[lo]
            hit = k == q
            out[idx[hit]] = lo[hit]
            lo += 1
            go = ~hit & (lo < hi) & (k < q)
            idx, lo, hi, q = idx[go], lo[go], hi[go], q[go]
        return out


_CLASS = np.where(_WORD, 1, 2).astype(np.uint8)
_CLASS[:33] = 0


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first) of the case-sensitive words and runs of punctuation; row i has first[i]:first[i+1]."""
    n = data.size
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    c = _CLASS[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    change = np.empty(n + 1, bool)
    change[0] = change[-1] = True
    change[1:-1] = c[1:] != c[:-1]
    change |= edge
    start = np.flatnonzero(change[:-1] & (c > 0))
    end = np.flatnonzero(change[1:] & (c > 0)) + 1
    return span_hash(data, start, end), np.searchsorted(start, offs)


def total(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i+1]] for each row."""
    acc = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return acc[first[1:]] - acc[first[:-1]]
