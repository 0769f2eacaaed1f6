"""Vectorised text primitives shared by the corpus operators.

Everything here works on whole Arrow string buffers with numpy: words are runs
of bytes outside ``[\\x20\\x09-\\x0D]``, and hashes are 64-bit, so one batch of
documents costs a fixed number of passes over its bytes and no Python loop per
word. The white space set is ASCII, hence byte-wise scanning of UTF-8 is exact.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
MUL = U(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=U)

#: Bytes of text handled at once; bounds the numpy temporaries (about 10x this).
SLICE_BYTES = 4 << 20


def release() -> None:
    """Gives memory that was freed back to the machine: a worker outlives its task, and its allocators keep what they had."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column; a null text is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_string())
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64, count=n + 1, offset=8 * col.offset)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes together (one at least)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf | np.uint8(32), buf)


def word_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the number of words before each document."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    left = word.copy()
    left[1:] &= ~word[:-1] | edge[1:-1]
    right = word.copy()
    right[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(left), np.flatnonzero(right) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, eight bytes a step."""
    size = ends - starts
    h = size.astype(U) * MUL
    if not len(starts):
        return h
    pad = np.concatenate([buf, np.zeros(16, np.uint8)])
    blocks = np.lib.stride_tricks.as_strided(pad, shape=(len(buf) + 8, 8), strides=(1, 1))
    todo, at = np.arange(len(starts)), 0
    while len(todo):
        part = np.ascontiguousarray(blocks[starts[todo] + at]).view(U)[:, 0]
        part = part & _MASK[np.minimum(size[todo] - at, 8)]
        h[todo] = mix(h[todo] ^ part) * MUL
        at += 8
        todo = todo[size[todo] > at]
    return h


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive items, documents ignored."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    g = h[:m].copy()
    for j in range(1, n):
        g = g * MUL + h[j : j + m]
    return mix(g)


def within(woffs: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the runs of ``grams(h, n)`` lie inside one document."""
    m = total - n + 1
    if m <= 0:
        return np.zeros(0, bool)
    doc = np.repeat(np.arange(len(woffs) - 1), np.diff(woffs))
    return doc[:m] == doc[n - 1 :]


def owners(woffs: np.ndarray) -> np.ndarray:
    """The document of each item."""
    return np.repeat(np.arange(len(woffs) - 1), np.diff(woffs))


def cover(flag: np.ndarray, n: int) -> np.ndarray:
    """Items inside a flagged run of ``n``: ``flag[i]`` marks items i..i+n-1."""
    step = np.zeros(len(flag) + n + 1, np.int32)
    at = np.flatnonzero(flag)
    step[at] += 1
    step[at + n] -= 1
    return np.cumsum(step)[: len(flag)] > 0


def sliding(v: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """``op`` (minimum or maximum) over v[i:i+w], by doubling."""
    width, out = 1, v
    while width * 2 <= w:
        out = op(out[: len(out) - width], out[width:])
        width *= 2
    if width < w:
        more = w - width
        out = op(out[: len(out) - more], out[more:])
    return out


def minimizers(v: np.ndarray, w: int) -> np.ndarray:
    """Winnowing: positions that are the least of some ``w`` neighbours (all ties).

    Any two equal runs of ``w`` values select the same relative positions, so a
    repeat cannot hide from an index that holds only these positions.
    """
    if len(v) < w:
        return np.zeros(len(v), bool)
    low = sliding(v, w, np.minimum)
    wide = np.concatenate([np.zeros(w - 1, v.dtype), low, np.zeros(w - 1, v.dtype)])
    return sliding(wide, w, np.maximum) == v


def runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true."""
    d = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def repeated(key: np.ndarray) -> np.ndarray:
    """Which entries have an equal entry elsewhere."""
    s = np.sort(key)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    return member(key, twice)


def member(key: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which keys are in a sorted table; a bit filter spares most searches."""
    out = np.zeros(len(key), bool)
    if not len(table) or not len(key):
        return out
    bits = max(10, min(24, int(len(table)).bit_length() + 4))
    seen = np.zeros(1 << bits, bool)
    seen[table >> U(64 - bits)] = True
    at = np.flatnonzero(seen[key >> U(64 - bits)])
    found = np.searchsorted(table, key[at])
    out[at] = table[np.minimum(found, len(table) - 1)] == key[at]
    return out


def later(key: np.ndarray) -> np.ndarray:
    """Which entries have an equal entry at a smaller index."""
    out = np.zeros(len(key), bool)
    at = np.flatnonzero(repeated(key))
    if len(at):
        order = np.argsort(key[at], kind="stable")
        k = key[at][order]
        out[at[order[1:][k[1:] == k[:-1]]]] = True
    return out


class PrefixHash:
    """Hashes of arbitrary byte spans from one running polynomial sum."""

    _table = mix(np.arange(1, 257, dtype=U) * MUL)
    _inverse = U(pow(int(MUL), -1, 1 << 64))
    _pow = np.ones(1, U)
    _inv = np.ones(1, U)

    def __init__(self, buf: np.ndarray):
        cls = PrefixHash
        if len(cls._pow) <= len(buf):
            n = max(len(buf) + 1, SLICE_BYTES + 1)
            cls._pow = np.cumprod(np.concatenate([np.ones(1, U), np.full(n, MUL)]), dtype=U)
            cls._inv = np.cumprod(np.concatenate([np.ones(1, U), np.full(n, cls._inverse)]), dtype=U)
        self.sum = np.zeros(len(buf) + 1, U)
        np.cumsum(cls._table[buf] * cls._pow[: len(buf)], dtype=U, out=self.sum[1:])

    def span(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sum[ends] - self.sum[starts]) * PrefixHash._inv[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))

    def runs(self, n: int) -> np.ndarray:
        """Hashes of all runs of n bytes."""
        m = len(self.sum) - n
        return mix((self.sum[n:] - self.sum[:m]) * PrefixHash._inv[:m]) if m > 0 else np.zeros(0, U)
