"""Vectorised work on the bytes of many texts at once: words, hashes of words, shingles.

Texts come as an Arrow string array; its buffer is read without making Python strings. All functions
work on pieces of bounded size, so one very long text needs no more than its own bytes and hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_RNG = np.random.default_rng(20240229)
_BASE = int(_RNG.integers(1 << 62, dtype=np.uint64)) * 2 + 1
#: 64-bit value of each byte; A-Z have the values of a-z.
BYTE_VALUES = _RNG.integers(1 << 63, dtype=np.uint64, size=256) * _U(2) + _U(1)
BYTE_VALUES[65:91] = BYTE_VALUES[97:123]
#: Bytes of words: all but space and \x09-\x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
_PLACES = _RNG.integers(1 << 63, dtype=np.uint64, size=16) * _U(2) + _U(1)
_PIECE = 1 << 19
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit (in place where it can)."""
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    h *= _U(0x9FB21C651E98DF25)
    h ^= h >> _U(32)
    return h


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (one more entry than texts); null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type)
    _, where, data = texts.buffers()
    at = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(texts: pa.Array, size: int = 1 << 20, most: int = 1 << 14) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, starts) of runs of at most `most` texts of about `size` bytes; a longer text is alone."""
    raw, at = buffers(texts)
    i, n = 0, len(at) - 1
    while i < n:
        j = min(i + most, max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1))
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def spans(raw: np.ndarray, at: np.ndarray, words: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and the number of all) of runs of word bytes; runs end where texts end."""
    inside = words[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[at] = True
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.zeros(len(raw), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size, inverse = max(n, _PIECE + 4096), pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.r_[_U(1), np.full(size, b % (1 << 64), _U)], dtype=_U) for b in (_BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, A-Z as a-z."""
    out, i = np.empty(len(starts), _U), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _PIECE, "right")))
        lo, hi = starts[i], ends[j - 1]
        up, down = _powers(int(hi - lo))
        total = np.zeros(hi - lo + 1, _U)
        np.cumsum(BYTE_VALUES[raw[lo:hi]] * up[: hi - lo], out=total[1:])
        s = starts[i:j] - lo
        out[i:j] = mix((total[ends[i:j] - lo] - total[s]) * down[s])
        i = j
    return out


def shingle_sets(texts: pa.Array, width: int = 5, size: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, hashes, bounds) for runs of texts: the sorted distinct shingle hashes of text first + i are
    hashes[bounds[i]:bounds[i + 1]]. Fewer than `width` words make one shingle, none make none."""
    for first, last, raw, at in pieces(texts, size):
        starts, ends, word = spans(raw, at)
        h = word_hashes(raw, starts, ends)
        n = np.diff(word)
        whole = np.full(max(0, len(h) - width + 1), width, _U)
        for k in range(width):
            if len(h) >= width:
                whole += h[k : len(h) - width + 1 + k] * _PLACES[k]
        whole = mix(whole)
        sets, bounds = [], [0]
        for i in range(last - first):
            if n[i] >= width:
                own = np.unique(whole[word[i] : word[i + 1] - width + 1])
            elif n[i]:
                part = h[word[i] : word[i + 1]]
                own = mix((part * _PLACES[8 : 8 + n[i]]).sum(dtype=_U, keepdims=True) + _U(n[i]))
            else:
                own = h[:0]
            sets.append(own)
            bounds.append(bounds[-1] + len(own))
        yield first, np.concatenate(sets), np.array(bounds)
