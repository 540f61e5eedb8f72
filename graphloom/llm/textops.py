"""Vectorised work on the UTF-8 bytes of many texts at once; nothing here loops over characters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Powers that stay in memory (8 bytes each, two tables); those of longer texts are made again.
MOST_POWERS = 1 << 21
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}

#: Bytes of words: ASCII letters, digits and underscore, and every byte of a character beyond ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
#: Bytes of white-space-delimited words: all but space and U+0009 to U+000D.
FIELD_BYTES = np.ones(256, bool)
FIELD_BYTES[[32, *range(9, 14)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        base = U(_BASE if kind == "up" else _INVERSE)
        while len(have) < n:
            last = have[-1:] * base
            have = np.concatenate([have, have * last])
        if len(have) <= MOST_POWERS:
            _powers[kind] = have
    return have[:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each starts (one more entry at the end). Null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, at - at[0]


def spans(buf: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document number of each maximal run of bytes of ``kind`` that lies in one document."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = kind[buf]
    border = np.zeros(n + 1, bool)
    border[at] = True
    before = np.concatenate([[False], inside])[:-1]
    starts = np.flatnonzero(inside & (~before | border[:-1]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


#: What a byte counts in the second of two independent hashes.
_OTHER = mix(np.arange(256, dtype=U) + U(0x51ED270B))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, from one polynomial prefix sum; ``other`` gives a second, independent one."""
    n = len(buf)
    total = np.zeros(n + 1, U)
    np.cumsum((_OTHER[buf] if other else buf.astype(U) + U(1)) * _power("up", n), out=total[1:])
    h = (total[ends] - total[starts]) * _power("down", n + 1)[starts]
    return mix(h ^ (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def windows(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` consecutive items of one document, and the number of the first item of each."""
    if len(hashes) < size:
        return np.zeros(0, U), np.zeros(0, np.int64)
    m = len(hashes) - size + 1
    first = np.flatnonzero(doc[:m] == doc[size - 1 :])
    h = np.zeros(m, U)
    for k in range(size):
        h = h * U(0x9FB21C651E98DF25) + hashes[k : k + m]
    return mix(h)[first], first


def shingle_sets(column: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, shingle hash, count) of the distinct word shingles of each text, sorted.

    Words are lower-cased runs of ``WORD_BYTES``. A text of fewer than ``size`` words has one shingle of all of them.
    """
    buf, at = flat(pc.utf8_lower(pc.fill_null(column, "")))
    starts, ends, doc = spans(buf, at, WORD_BYTES)
    words = span_hashes(buf, starts, ends)
    h, first = windows(words, doc, size)
    owner = doc[first]
    n_words = np.bincount(doc, minlength=len(column))
    for short in np.flatnonzero((n_words > 0) & (n_words < size)):
        own = words[doc == short]
        value, _ = windows(own, np.zeros(len(own), np.int64), len(own))
        h, owner = np.concatenate([h, mix(value + U(len(own)))]), np.concatenate([owner, [short]])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    if not len(h):
        return owner.astype(np.int64), h, np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]))
    return owner[new], h[new], np.diff(np.concatenate([new, [len(h)]]))
