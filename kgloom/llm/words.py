"""Vectorised word splitting and hashing over Arrow string buffers.

A word is a maximal run of ASCII letters and digits and of bytes from 0x80 on
(so accented and non-Latin letters stay inside words). Hashes ignore case for
ASCII and the Latin-1 letters. All work is on whole batches; no text is cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_LOWER = np.zeros(256, np.uint8)
for _c in range(256):
    if _c >= 128 or chr(_c).isalnum():
        _LOWER[_c] = ord(chr(_c).lower()) if _c < 128 else _c
_POW = np.ones(1, U)
_INV = np.ones(1, U)
SLICE = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            _POW = np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, U(_P))]), dtype=U)
            _INV = np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, U(_P_INV))]), dtype=U)
    return _POW, _INV


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def buffers(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null has no bytes."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
        if isinstance(arr, pa.ChunkedArray):
            arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
    if pa.types.is_null(arr.type):
        arr = arr.cast(pa.string())
    if arr.null_count:
        arr = arr.fill_null("")
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document index, start byte, end byte, hash) of every word, in text order."""
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e, np.zeros(0, U)
    low = _LOWER[data]
    up = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    low[up] += 0x20
    inside = low != 0
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = np.empty(len(s), U)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(s):
            j = max(i + 1, int(np.searchsorted(e, s[i] + SLICE, "right")))
            a, b = s[i], e[j - 1]
            pw, inv = _powers(int(b - a) + 1)
            cs = np.zeros(b - a + 1, U)
            np.cumsum(low[a:b].astype(U) * pw[: b - a], out=cs[1:])
            h[i:j] = (cs[e[i:j] - a] - cs[s[i:j] - a]) * inv[s[i:j] - a]
            i = j
        h = mix(h + (e - s).astype(U))
    return np.searchsorted(offsets, s, "right") - 1, s, e, h


def doc_groups(offsets: np.ndarray, size: int = SLICE):
    """Slices of documents of about ``size`` bytes, at least one document each."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def char_positions(data: np.ndarray) -> np.ndarray:
    """For each byte offset, the number of characters before it (length n + 1)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
