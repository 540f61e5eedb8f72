"""What a worker remembers of strings it has seen: rows of numbers per string, in a bounded number of bytes."""

from __future__ import annotations

import numpy as np

from .textops import mix

#: Sorted runs that wait to be merged into the main one.
RUNS = 8


def expand(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... of size[i] numbers, for each i in turn."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size - begin, size)


class _Run:
    def __init__(self, key: np.ndarray, check: np.ndarray, size: np.ndarray, values: np.ndarray):
        self.key, self.check, self.size, self.values = key, check, size.astype(np.int32), values
        self.begin = np.cumsum(size, dtype=np.int64) - size
        self.hit = np.zeros(len(key), bool)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.key, self.check, self.size, self.values, self.begin, self.hit))

    def chosen(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        size = self.size[rows]
        return self.key[rows], self.check[rows], size, self.values[expand(self.begin[rows], size)]


class Memo:
    """Rows of unsigned 32-bit numbers by the 128-bit hash (key, check) of a string, in sorted arrays.

    Beyond ``limit`` bytes those go that nobody asked for since the last time, then the others.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.runs: list[_Run] = []

    def find(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For sorted distinct keys: which are known, and of those in turn the sizes and values."""
        known = np.zeros(len(key), bool)
        rows, sizes, values = [], [], []
        for run in self.runs:
            if not len(run.key):
                continue
            at = np.minimum(np.searchsorted(run.key, key), len(run.key) - 1)
            own = np.flatnonzero((run.key[at] == key) & (run.check[at] == check) & ~known)
            known[own] = True
            at = at[own]
            run.hit[at] = True
            rows.append(own)
            sizes.append(run.size[at])
            values.append(run.values[expand(run.begin[at], run.size[at])])
        if not rows:
            return known, np.zeros(0, np.int32), np.zeros(0, np.uint32)
        rows, sizes, values = np.concatenate(rows), np.concatenate(sizes), np.concatenate(values)
        order = np.argsort(rows)
        begin = np.cumsum(sizes, dtype=np.int64) - sizes
        return known, sizes[order], values[expand(begin[order], sizes[order])]

    def add(self, key: np.ndarray, check: np.ndarray, size: np.ndarray, values: np.ndarray) -> None:
        """Remember rows of sorted distinct keys that are not known yet."""
        run = _Run(key, check, size, values)
        if run.nbytes > self.limit // 2:
            return
        self.runs.append(run)
        if len(self.runs) > RUNS or sum(r.nbytes for r in self.runs) > self.limit:
            self._merge()

    def _merge(self) -> None:
        over = sum(r.nbytes for r in self.runs) > self.limit
        parts = [r.chosen(np.flatnonzero(r.hit) if over else np.arange(len(r.key))) for r in self.runs]
        hits = [np.zeros(len(p[0]), bool) if over else r.hit for p, r in zip(parts, self.runs, strict=True)]
        self.runs = []
        key, check, size, values = (np.concatenate(x) for x in zip(*parts, strict=True))
        if over and key.nbytes + check.nbytes + 13 * len(key) + values.nbytes > self.limit // 2:
            return
        order = np.argsort(key, kind="stable")
        begin = np.cumsum(size, dtype=np.int64) - size
        merged = _Run(key[order], check[order], size[order], values[expand(begin[order], size[order])])
        merged.hit = np.concatenate(hits)[order]
        self.runs = [merged]


def distinct(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, the first place of each, and which of them each place has."""
    found, first, which = np.unique(key, return_index=True, return_inverse=True)
    if (check[first][which] != check).any():  # two strings of one key: this call takes other keys
        return distinct(mix(key ^ check), check)
    return found, first, which


__all__ = ["Memo", "distinct", "expand"]
