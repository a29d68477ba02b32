"""Hashes of the distinct word shingles of whole texts (numpy, in the task)."""

from __future__ import annotations

import re

import numpy as np

SLICE_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _P, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_POW = _powers(256)


def _slice_words(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    word = ~_IS_SPACE[a]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    letters = a[word]
    first = np.cumsum(size) - size
    place = np.arange(len(letters)) - np.repeat(first, size)
    longest = int(size.max())
    powers = _POW if longest <= len(_POW) else _powers(longest)
    return _mix(np.add.reduceat(_BYTE[letters] * powers[place], first) + size.astype(np.uint64))


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hash of each word ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case."""
    data = (text or b"").lower()
    out, at = [], 0
    while len(data) - at > SLICE_BYTES:
        m = _SPACE.search(data, at + SLICE_BYTES)
        if m is None:
            break
        out.append(_slice_words(data[at:m.start()]))
        at = m.end()
    out.append(_slice_words(data[at:] if at else data))
    return np.concatenate(out) if len(out) > 1 else out[0]


def shingle_hashes(text: bytes | None, words: int = 5) -> np.ndarray:
    """Distinct shingle hashes of a text, ascending (uint64).  With fewer words the
    whole sequence is one shingle; without words there is none."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(words, len(w))
    h = w[:len(w) - k + 1].copy()
    for i in range(1, k):
        h = h * _Q + w[i:len(w) - k + 1 + i]
    # a whole short sequence is never a five-word shingle
    return np.unique(_mix(h + np.uint64(k)))
