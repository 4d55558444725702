"""Words and 64-bit hashes of an Arrow batch of texts, as flat numpy arrays.

A word is a run of bytes without ASCII white space: ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Text bytes that one numpy pass takes, unless a single text is longer.
PASS_BYTES = 4 << 20


class Words(NamedTuple):
    """Words of some texts in order: ``buf[start:end]``; text t has words ``first[t]:first[t + 1]``.

    ``buf`` has one space after each word that white space follows, so neighbours within a text
    are also the text's words joined by one space.
    """

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (one more for the end); null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def passes(texts: pa.Array, most: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` bytes, together all texts."""
    if isinstance(texts, pa.ChunkedArray):
        raise TypeError("an array of one chunk is wanted")
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def split(texts: pa.Array, lower: bool = False) -> Words:
    raw, off = text_bytes(texts)
    space = SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    before = np.ones(len(raw), bool)
    before[1:] = space[:-1]
    before |= edge[:-1]
    after = np.ones(len(raw), bool)
    after[:-1] = space[1:]
    after |= edge[1:]
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(~space & after) + 1
    first = np.searchsorted(start, off)
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    at = np.zeros(len(raw) + 1, np.int32 if len(raw) < 2**31 else np.int64)
    np.cumsum(keep, out=at[1:])
    buf = np.where(space, np.uint8(32), LOWER[raw] if lower else raw)[keep]
    start, end = at[start].astype(np.int64), at[end - 1].astype(np.int64) + 1 if len(end) else end
    return Words(buf, start, end, first)


P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each ``buf[start:end]``, as unsigned 64-bit integers."""
    out = np.empty(len(start), np.uint64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    for a in range(0, len(start), 1 << 16):
        out[a : a + (1 << 16)] = _xxh64(padded, start[a : a + (1 << 16)], end[a : a + (1 << 16)], seed)
    return out


def _xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    w8 = np.ndarray((len(buf) - 7,), "<u8", buffer=buf, strides=(1,))
    w4 = np.ndarray((len(buf) - 3,), "<u4", buffer=buf, strides=(1,))
    s = np.uint64(seed)
    p, n = start.astype(np.int64), (end - start).astype(np.int64)
    left = n.copy()
    with np.errstate(over="ignore"):
        h = np.full(len(p), s + P5, np.uint64)
        long = np.flatnonzero(n >= 32)
        if len(long):
            v = [np.full(len(long), x, np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
            live = np.arange(len(long))
            while len(live):
                i = long[live]
                for k in range(4):
                    v[k][live] = _rot(v[k][live] + w8[p[i] + 8 * k] * P2, 31) * P1
                p[i] += 32
                left[i] -= 32
                live = live[left[i] >= 32]
            g = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
            for x in v:
                g = (g ^ (_rot(x * P2, 31) * P1)) * P1 + P4
            h[long] = g
        h += n.astype(np.uint64)
        live = np.flatnonzero(left >= 8)
        while len(live):
            h[live] = _rot(h[live] ^ (_rot(w8[p[live]] * P2, 31) * P1), 27) * P1 + P4
            p[live] += 8
            left[live] -= 8
            live = live[left[live] >= 8]
        live = np.flatnonzero(left >= 4)
        h[live] = _rot(h[live] ^ (w4[p[live]].astype(np.uint64) * P1), 23) * P2 + P3
        p[live] += 4
        left[live] -= 4
        live = np.flatnonzero(left >= 1)
        while len(live):
            h[live] = _rot(h[live] ^ (buf[p[live]].astype(np.uint64) * P5), 11) * P1
            p[live] += 1
            left[live] -= 1
            live = live[left[live] >= 1]
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
    return h


def give_back() -> None:
    """Return freed memory to the system: Python workers live on after a task, and an executor's share is small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of at least ``most`` bytes of ``column``, but for the last."""
    held: list[pa.RecordBatch] = []
    size = 0
    for x in batches:
        held.append(x)
        size += x.column(column).nbytes
        del x
        if size >= most:
            yield held[0] if len(held) == 1 else pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def mix64(x: np.ndarray, salt: int) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def strings(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """``buf[start:end]`` as an Arrow array of strings."""
    size = end - start
    off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    data = buf[spread(start, size)] if len(size) else buf[:0]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data)))


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... start + size - 1 of each, one after the other."""
    total = int(size.sum())
    off = np.cumsum(size) - size
    return np.arange(total) + np.repeat(start - off, size)
