"""Repeats of at least a given length, from a Burrows-Wheeler transform by threshold-bounded interval expansion.

Suffixes are sorted as far as the threshold needs. Starting from the intervals of single characters, breadth-first
backward extension turns the interval of w into those of cw for each character c before it. The first time an interval
[i, j] of a string of length n + 1 ends at a border j + 1 not seen before, the common prefix at that border is n. So common
prefixes come out by increasing value, each border once; expansion stops at the threshold, and the
borders never reached are those with a common prefix of that length or more.
"""

from __future__ import annotations

import numpy as np


def sorted_suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the first ``depth`` (or more) symbols from each, by prefix doubling."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    span = 1
    bits = max(1, int(rank.max()).bit_length())
    while bits * 2 <= 62 and span < depth:  # pack symbols while two of them fit a word
        rank = (rank << bits) | np.concatenate([rank[span:], np.zeros(min(span, n), np.int64)])[:n]
        span, bits = span * 2, bits * 2
    while True:
        order = np.argsort(rank)
        new = np.empty(n, np.int64)
        ordered = rank[order]
        new[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        if span >= depth or new[order[-1]] == n - 1:
            return order
        rank = new * (n + 1)
        rank[: n - span] += new[span:] + 1
        span *= 2


def unreached_borders(symbols: np.ndarray, n_separators: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order, and which borders between neighbours in it (border i stands before suffix i) have a common
    prefix of ``threshold`` or more. Symbols below ``n_separators`` occur once each and end strings."""
    n = len(symbols)
    order = sorted_suffixes(symbols, threshold)
    bwt = symbols[order - 1]
    bwt[order == 0] = symbols[-1]
    by_symbol = np.argsort(bwt, kind="stable")  # position k of this order is where the extension by that symbol lands
    last_to_first = np.empty(n, np.int64)
    last_to_first[by_symbol] = np.arange(n)
    symbol_at = bwt[by_symbol]
    opens = np.concatenate([[True], symbol_at[1:] != symbol_at[:-1]])  # a new symbol begins
    extends = bwt >= n_separators

    reached = np.zeros(n + 1, bool)
    reached[0] = reached[n] = True
    start = np.flatnonzero(opens)
    end = np.concatenate([start[1:], [n]])
    reached[end] = True
    single = start[end - start == 1]
    low, high = start[end - start > 1], end[end - start > 1]  # high is exclusive
    owner = np.full(n, -1, np.int64)
    for _ in range(1, threshold):
        if not len(single) and not len(low):
            break
        # Strings that occur once extend in one way.
        place = last_to_first[single[extends[single]]]
        place = place[~reached[place + 1]]
        # The others: positions of one string that land side by side with one symbol are one longer string.
        size = high - low
        total = int(size.sum())
        if total * 16 > n:
            owner[:] = -1
            number = np.repeat(np.arange(len(low)), size)
            inside = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
            owner[inside] = number
            owner[~extends] = -1
            landed = owner[by_symbol]
            here = np.flatnonzero(landed >= 0)
            whose = landed[here]
        elif total:
            number = np.repeat(np.arange(len(low)), size)
            inside = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
            ok = extends[inside]
            here, whose = last_to_first[inside[ok]], number[ok]
            by_place = np.argsort(here)
            here, whose = here[by_place], whose[by_place]
        else:
            here = whose = np.zeros(0, np.int64)
        if len(here):
            first = np.concatenate([[True], (here[1:] != here[:-1] + 1) | (whose[1:] != whose[:-1]) | opens[here[1:]]])
            begin = here[first]
            stop = np.concatenate([here[np.flatnonzero(first)[1:] - 1], here[-1:]]) + 1
            fresh = ~reached[stop]
            begin, stop = begin[fresh], stop[fresh]
            reached[stop] = True
        else:
            begin = stop = np.zeros(0, np.int64)
        reached[place + 1] = True
        one = stop - begin == 1
        single = np.concatenate([place, begin[one]])
        low, high = begin[~one], stop[~one]
    return order, ~reached


def repeated_starts(strings: list[bytes], threshold: int) -> list[np.ndarray]:
    """For each string, where substrings of ``threshold`` bytes start that also start elsewhere in the strings."""
    k = len(strings)
    sizes = np.array([len(s) for s in strings], np.int64)
    total = int(sizes.sum()) + k
    symbols = np.empty(total, np.int64)
    ends = np.cumsum(sizes + 1) - 1
    body = np.ones(total, bool)
    body[ends] = False
    symbols[ends] = np.arange(k)
    symbols[body] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + k
    order, shared = unreached_borders(symbols, k, threshold)
    flagged = np.sort(order[shared[:-1] | shared[1:]])
    begins = ends - sizes
    cuts = np.searchsorted(flagged, np.concatenate([begins, [total]]))
    return [flagged[cuts[i] : cuts[i + 1]] - begins[i] for i in range(k)]
