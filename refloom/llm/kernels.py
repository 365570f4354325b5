"""Vectorised numpy kernels over UTF-8 buffers, shared by the text operators.

A hash here is 64 bits of a byte string under tables fixed at import, so every
executor computes the same value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
BYTE_B = mix64(BYTE + U64(0x632BE59BD9B4E019))
_LEFT, _RIGHT = U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)
_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """M^0 .. M^(n-1) modulo 2^64, kept between calls."""
    key = "inv" if inverse else "pow"
    got = _powers.get(key)
    if got is None or len(got) < n:
        p = np.full(max(n, 1 << 16), _BASE_INV if inverse else _BASE, dtype=U64)
        p[0] = 1
        got = _powers[key] = np.cumprod(p, dtype=U64)
    return got[:n]


def utf8(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a string array; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    n = len(arr)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(arr: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes of text each; a longer text is alone."""
    lens = np.diff(utf8(arr)[1])
    start, size = 0, 0
    for i, n in enumerate(lens.tolist()):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if len(lens):
        yield start, len(lens)


def window_hash(b: np.ndarray, n: int, table: np.ndarray = BYTE) -> np.ndarray:
    """Hash of each n-byte window, len(b) - n + 1 values, by doubling."""
    if len(b) < n:
        return np.zeros(0, U64)
    have, width, level, k = None, 0, table[b], 1
    while True:
        if n & k:
            have = level if have is None else join_hash(have, level, width)
            width += k
        if width == n:
            return have[: len(b) - n + 1]
        level = join_hash(level, level, k)
        k *= 2


def rolling_hash(b: np.ndarray, n: int, table: np.ndarray = BYTE) -> np.ndarray:
    """Another hash of each n-byte window, from prefix sums: cheaper, for short windows."""
    if len(b) < n:
        return np.zeros(0, U64)
    c = np.zeros(len(b) + 1, U64)
    np.cumsum(table[b] * powers(len(b)), out=c[1:])
    return (c[n:] - c[:-n]) * powers(len(b) + 1, True)[: len(c) - n]


def join_hash(a: np.ndarray, c: np.ndarray, width: int) -> np.ndarray:
    """Hash at i of a's window at i followed by c's at i + width."""
    m = max(0, min(len(a), len(c) - width))
    x = a[:m] * _LEFT
    x += c[width : width + m] * _RIGHT
    x ^= x >> U64(29)
    x *= _M1
    x ^= x >> U64(32)
    return x


def span_hash(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """Hash of each b[start:end]: of its bytes and its length."""
    n = len(b)
    c = np.zeros(n + 1, U64)
    np.cumsum(table[b] * powers(n), out=c[1:])
    return mix64((c[ends] - c[starts]) * powers(n + 1, True)[starts] + (ends - starts).astype(U64) * _LEFT)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that occur twice or more."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    s = np.sort(keys)
    dup = s[1:][s[1:] == s[:-1]]
    if not len(dup):
        return np.zeros(len(keys), bool)
    dup = dup[np.r_[True, dup[1:] != dup[:-1]]]
    bits = U64(max(16, int(len(keys)).bit_length() + 2))
    seen = np.zeros(1 << int(bits), bool)
    seen[dup >> (U64(64) - bits)] = True
    out = seen[keys >> (U64(64) - bits)]
    at = np.flatnonzero(out)
    pos = np.searchsorted(dup, keys[at])
    pos[pos == len(dup)] = 0
    out[at] = dup[pos] == keys[at]
    return out


def sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags within each offsets range, empty ranges too."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return np.diff(c[offsets])


def union_mask(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any [start, end)."""
    d = np.bincount(starts, minlength=n + 1).astype(np.int64)[: n + 1]
    d -= np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(d[:n]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    d = np.diff(np.r_[0, mask.astype(np.int8), 0])
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)
