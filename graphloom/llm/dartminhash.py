"""DartMinHash: sparse weighted minwise signatures from hashed darts.

Every element owns the same darts wherever it occurs: a unit-rate Poisson process over (weight, rank), drawn cell
by cell from hashes. A set of total weight T keeps the darts below each element's weight and below rank
theta = darts / T, so about ``darts`` of them whatever its size. A dart's hash names its coordinate; the dart of
lowest rank wins it. Coordinates still empty go on with doubled theta, so every signature is complete. Two sets agree
in a coordinate with the probability of their weighted Jaccard similarity.
"""

from __future__ import annotations

import math

import numpy as np

from .textops import U, mix

#: Rank cells: [0, 2**-FINEST), then doubling up to 1, then of width 1. Weight cells: [0, 1), then doubling.
FINEST = 3


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> U(11)).astype(np.float64) * 2.0**-53


def _rank_cells(top: float):
    """Number, lower end and width of the rank cells that begin below ``top``."""
    low, width, number = 0.0, 2.0**-FINEST, 0
    while low < top:
        yield number, low, width
        low += width
        width = low if low < 1 else 1.0
        number += 1


def _poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """Inverse distribution function, for all of ``u`` at once."""
    count = np.zeros(len(u), np.int64)
    p = total = math.exp(-mean)
    k = 0
    more = u >= total
    while more.any():
        count[more] += 1
        k += 1
        p *= mean / k
        total += p
        if p < 1e-18 and k > mean:
            break
        more = u >= total
    return count


def _darts(sets: np.ndarray, elements: np.ndarray, weights: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Set, rank and hash of the darts with ``low <= rank < high`` (by element) below each element's weight."""
    out = []
    top = float(high.max()) if len(high) else 0.0
    later = bool((low > 0).any())
    for number, start, width in _rank_cells(top):
        live = np.flatnonzero((high > start) & (low < start + width))
        if not len(live):
            continue
        level, bottom, extent = 0, 0.0, 1.0
        while len(live):
            partial = bool((weights[live] < bottom + extent).any())
            seed = elements[live] ^ mix(np.full(1, (number << 8) + level + 1, U))
            # Cells wider than one expected dart are drawn in slices, so that the Poisson draw stays short.
            slices = max(1, math.ceil(extent * width))
            for part in range(slices):
                cell = mix(seed + np.full(1, 0x632BE59BD9B4E019 * (part + 1) & (1 << 64) - 1, U))
                n = _poisson(_uniform(cell), extent * width / slices)
                hit = np.flatnonzero(n)
                k = 0
                while len(hit):
                    h = mix(cell[hit] + np.full(1, 0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1, U))
                    rank = start + width * _uniform(mix(h ^ U(2)))
                    e = live[hit]
                    ok = rank < high[e]
                    if later:
                        ok &= rank >= low[e]
                    if partial:
                        ok &= bottom + extent * (part + _uniform(mix(h ^ U(1)))) / slices < weights[e]
                    e = e[ok]
                    out.append((sets[e], rank[ok], h[ok]))
                    k += 1
                    hit = hit[n[hit] > k]
            bottom += extent
            extent = bottom if level else 1.0
            level += 1
            live = live[weights[live] > bottom]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, U)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def signatures(sets: np.ndarray, elements: np.ndarray, weights: np.ndarray, n_sets: int, k: int) -> np.ndarray:
    """[set, coordinate] signature values; rows of sets without elements are 0.

    ``sets`` numbers the set of each element, ``elements`` are 64-bit hashes, ``weights`` positive.
    """
    result = np.zeros((n_sets, k), U)
    if not len(sets):
        return result
    total = np.bincount(sets, weights, minlength=n_sets)
    step = (k * math.log(k) + 2 * k) / np.where(total > 0, total, 1)
    low, high = np.zeros(n_sets), step.copy()
    active = total > 0
    filled = ~active[:, None].repeat(k, axis=1)
    while active.any():
        mine = active[sets]
        s, rank, h = _darts(sets[mine], elements[mine], weights[mine], low[sets[mine]], high[sets[mine]])
        place = s * k + (mix(h ^ U(3)) % U(k)).astype(np.int64)
        best = np.full(n_sets * k, np.inf)
        np.minimum.at(best, place, rank)
        win = (rank == best[place]) & ~filled.reshape(-1)[place]
        place, h = place[win], h[win]
        result.reshape(-1)[place] = np.iinfo(U).max
        np.minimum.at(result.reshape(-1), place, h)
        filled.reshape(-1)[place] = True
        active = ~filled.all(axis=1)
        low, high = high, high * 2
    return result
