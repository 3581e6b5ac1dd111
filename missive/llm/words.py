"""Words, word hashes and shingle hashes of Arrow string columns, vectorised in numpy.

A word is a run of bytes other than the six ASCII blanks.  Texts are handled in slices of
a few MB, each text whole; hashes are 64-bit and the same in every process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WORD = np.ones(256, np.uint8)
_WORD[[9, 10, 11, 12, 13, 32]] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * _K2
    h = (h ^ (h >> np.uint64(27))) * _K3
    return h ^ (h >> np.uint64(31))


def slices(col: pa.Array, size: int = 4 << 20):
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``size`` bytes;
    a longer text is a run of its own.  Null texts are empty."""
    col = pc.fill_null(col, "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return
    wide = pa.types.is_large_string(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = int(np.searchsorted(off, off[i] + size, "right")) - 1
        j = min(max(j, i + 1), len(col))
        yield i, j, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def find_words(buf: np.ndarray, off: np.ndarray):
    """Byte starts and ends of all words, and the first word of each text (one more entry
    at the end: the number of words)."""
    n = buf.size
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(off.size, np.int64)
    w = _WORD[buf].view(bool)
    other = np.empty(n, bool)
    other[0], other[1:] = False, w[:-1]
    other[off[:-1][off[:-1] < n]] = False
    starts = np.flatnonzero(w & ~other)
    other[-1], other[:-1] = False, w[1:]
    e = off[1:]
    other[e[e > 0] - 1] = False
    ends = np.flatnonzero(w & ~other) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each word, eight bytes at a time; ``lower`` folds A-Z."""
    padded = np.zeros(buf.size + 8, np.uint8)
    padded[:buf.size] = _LOWER[buf] if lower else buf
    eight = np.ndarray((buf.size + 1,), "<u8", padded, strides=(1,))
    left = ends - starts
    h = mix(left.astype(np.uint64) * _K1)
    at, todo = starts, None
    while left.size:
        piece = eight[at] & _MASK[np.minimum(left, 8)]
        if todo is None:
            h = mix((h ^ piece) + _K1)
        else:
            h[todo] = mix((h[todo] ^ piece) + _K1)
        more = left > 8
        if not more.any():
            break
        todo = np.flatnonzero(more) if todo is None else todo[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def runs(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of k consecutive values (runs that cross texts included)."""
    n = h.size - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    s = h[:n] + np.uint64(salt)
    for j in range(1, k):
        s = s * _K1 + h[j:j + n]
    return mix(s)


def long_runs(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of every run of k consecutive values by doubling: log k passes, for long runs."""
    mul = np.uint64(seed | 1)
    power = {1: h ^ np.uint64(seed)}
    size = 1
    while size * 2 <= k:
        p = power[size]
        n = p.size - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        power[size * 2] = mix(p[:n] * mul + p[size:size + n])
        size *= 2
    n = h.size - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at = None, 0
    for s in sorted(power, reverse=True):
        if k & s:
            p = power[s][at:at + n]
            out = p.copy() if out is None else mix(out * mul + p)
            at += s
    return out


def signed(h: np.ndarray) -> np.ndarray:
    """The same bits as Spark's signed long."""
    return h.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow list column of consecutive runs of ``values``."""
    off = np.zeros(counts.size + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))
