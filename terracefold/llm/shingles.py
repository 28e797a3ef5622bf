"""Hashed word shingles of whole texts, many documents at a time in numpy.

A text is lower-cased for A-Z and split into words `[^\\x20\\x09-\\x0D]+`; all of that is ASCII, so UTF-8 bytes do.
Word hashes come from one prefix sum over mixed (byte, place) values, shingle hashes from five word hashes; both have
64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SHINGLE = 5
_CHUNK = 1 << 20
_rng = np.random.default_rng(20240229)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)[_LOWER]
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MULT = [np.uint64(int(x) | 1) for x in _rng.integers(1, 2**63 - 1, SHINGLE)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    return x


def _words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes in order, and the number of words before each document start (and in all)."""
    n = len(data)
    ws = _WS[data]
    first = ~ws
    first[1:] &= ws[:-1]
    inner = starts[(starts > 0) & (starts < n)]
    first[inner] = ~ws[inner]
    begin = np.flatnonzero(first)
    last = ~ws
    last[:-1] &= ws[1:]
    last[inner - 1] = ~ws[inner - 1]
    end = np.flatnonzero(last) + 1
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(starts) + 1, np.int64)
    # Each byte counts as a mixed value of itself and its place in the word, so no pattern of letters cancels out.
    place = np.arange(n) - begin[np.maximum(np.cumsum(first) - 1, 0)]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_mix(_BYTE[data] + place.astype(np.uint64) * _STEP), out=sums[1:])
    h = _mix(sums[end] - sums[begin])
    return h, np.searchsorted(begin, np.append(starts, n))


def _sets(data: np.ndarray, starts: np.ndarray):
    h, at = _words(data, starts)
    if len(h) >= SHINGLE:
        s = np.zeros(len(h) - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            s += h[k : len(h) - SHINGLE + 1 + k] * _MULT[k]
        s = _mix(s)
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= SHINGLE:
            yield np.unique(s[a : b - SHINGLE + 1])
        elif b > a:
            v = np.uint64(b - a)
            for k in range(a, b):
                v = np.uint64((int(v) * int(_MULT[0]) + int(h[k])) % 2**64)
            yield _mix(np.array([v], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def shingle_sets(texts: pa.Array):
    """For each text (null: empty) its sorted distinct shingle hashes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, count=texts.offset + n + 1)[texts.offset :]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + _CHUNK, "right")) - 1
        j = min(max(j, i + 1), n)
        yield from _sets(data[offsets[i] : offsets[j]], offsets[i:j] - offsets[i])
        i = j


#: Minhash components: TREES orders of DEPTH components each.
TREES, DEPTH = 12, 8
_PERM_A = (_rng.integers(0, 2**32, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_PERM_B = _rng.integers(0, 2**32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, TREES * DEPTH) uint32 minima; rows of empty sets are all ones."""
    out = np.full((len(sets), TREES * DEPTH), 2**32 - 1, np.uint32)
    some = [k for k, s in enumerate(sets) if len(s)]
    i = 0
    while i < len(some):
        j, size = i, 0
        while j < len(some) and size < 1 << 17:
            size += len(sets[some[j]])
            j += 1
        rows = some[i:j]
        v = (np.concatenate([sets[k] for k in rows]) >> np.uint64(32)).astype(np.uint32)
        at = np.concatenate([[0], np.cumsum([len(sets[k]) for k in rows])[:-1]])
        for c in range(TREES * DEPTH):
            x = v * _PERM_A[c]
            x += _PERM_B[c]
            x ^= x >> np.uint32(16)
            x *= np.uint32(0x85EBCA6B)
            x ^= x >> np.uint32(13)
            out[rows, c] = np.minimum.reduceat(x, at)
        i = j
    return out
