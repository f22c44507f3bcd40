"""Vectorised text kernels over Arrow string buffers.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. All kernels read the UTF-8 bytes of
a batch directly, so no Python string is made per word. Hashes are 64-bit and the same on every
worker and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (public domain); a bijection on 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


_BYTES = stream(256, 17)
_P = 0xD6E8FEB86659FD93
_P_INV = pow(_P, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = (np.ones(1, U64), np.ones(1, U64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        with np.errstate(over="ignore"):
            _powers = tuple(np.concatenate([np.ones(1, U64), np.cumprod(np.full(size, p, U64))]) for p in (_P, _P_INV))
    return _powers


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if len(col) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``size`` bytes."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        end = min(end, n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row (plus one) the index of its first word."""
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(offsets), np.int64)
    solid = ~(((data - np.uint8(9)) < 5) | (data == 32))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word; ``lower`` folds A-Z first."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.empty(len(data) + 1, U64)
        total[0] = 0
        np.cumsum(_BYTES[_LOWER[data] if lower else data] * up[: len(data)], out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
        return mix(h + (ends - starts).astype(U64) * U64(0x9FB21C651E98DF25))


#: Classes of bytes for word shapes: upper A, lower a, digit 0, beyond ASCII u; punctuation stays.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = 48, 65, 97, 117


def hash_shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's shape: its byte classes with runs of one class (or mark) drawn together."""
    if not len(starts):
        return np.zeros(0, U64)
    kind = _SHAPE[data]
    kind = np.where(kind == 117, np.uint8(97), kind)
    run = np.empty(len(data), bool)
    run[0] = True
    run[1:] = kind[1:] != kind[:-1]
    run[starts] = True
    order = np.cumsum(run)
    up, _ = _power_tables(len(data) + 1)
    at = np.zeros(len(data), np.int64)
    sizes = ends - starts
    inside = np.repeat(order[starts], sizes)
    where = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    at[where] = order[where] - inside
    with np.errstate(over="ignore"):
        value = np.where(run, _BYTES[kind] * up[at], U64(0))
        total = np.concatenate([np.zeros(1, U64), np.cumsum(value)])
        return mix(total[ends] - total[starts] + U64(0x5851F42D4C957F2D))


def hash_runs(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each run of word hashes, in order; ``first`` has every run's first index (plus one end)."""
    if len(first) < 2:
        return np.zeros(0, U64)
    up, down = _power_tables(len(h) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(h) + 1, U64)
        np.cumsum(mix(h ^ U64(0x1234567)) * up[: len(h)], out=total[1:])
        return mix((total[first[1:]] - total[first[:-1]]) * down[first[:-1]] + np.diff(first).astype(U64) * U64(0x9FB21C651E98DF25))


def shingles(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles, in order, and the first index for each row (plus one).

    A row with fewer words, but at least one, has its whole sequence as its one shingle.
    """
    counts = np.diff(first)
    made = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(begin[-1], U64)
    keys = stream(n, 91)
    with np.errstate(over="ignore"):
        if len(h) >= n:
            rolled = np.zeros(len(h) - n + 1, U64)
            for j in range(n):
                rolled += mix(h[j : len(h) - n + 1 + j] ^ keys[j])
            rolled = mix(rolled)
            long = counts >= n
            take = np.repeat(first[:-1][long] - np.concatenate([[0], np.cumsum(made[long])[:-1]]), made[long]) + np.arange(made[long].sum())
            put = np.repeat(long, made)
            out[put] = rolled[take]
        for r in np.flatnonzero((counts > 0) & (counts < n)):
            own = h[first[r] : first[r + 1]]
            whole = np.sum(mix(own ^ keys[: len(own)]), dtype=U64, keepdims=True)
            out[begin[r]] = mix(whole + U64(len(own)) * U64(0xA24BAED4963EE407))[0]
    return out, begin


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
