"""Incidence matrices in compressed rows (CSR) on numpy arrays, and their product by rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Entries that a product expands at once, before equal places are summed.
BLOCK = 1 << 20


@dataclass
class Csr:
    """Row i has the columns indices[indptr[i]:indptr[i + 1]] with the values data at the same places."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int

    @classmethod
    def of_ranges(cls, starts: np.ndarray, ends: np.ndarray, columns: int) -> Csr:
        """Row i is one in the columns [starts[i], ends[i])."""
        size = ends - starts
        indptr = np.concatenate([[0], np.cumsum(size)])
        indices = np.arange(indptr[-1]) + np.repeat(starts - indptr[:-1], size)
        return cls(indptr, indices, np.ones(len(indices), np.int64), columns)

    def transposed(self) -> Csr:
        rows = np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))
        order = np.argsort(self.indices, kind="stable")
        indptr = np.concatenate([[0], np.cumsum(np.bincount(self.indices, minlength=self.columns))])
        return Csr(indptr, rows[order], self.data[order], len(self.indptr) - 1)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, value), in order of row and column."""
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr)), self.indices, self.data


def product(a: Csr, b: Csr) -> Csr:
    """a times b by Gustavson's rows: row i is the sum of b's rows named by a's row i, weighted by its values.

    Runs of rows that expand to about BLOCK entries are taken at once, so memory is bounded by BLOCK, one row and the result.
    """
    width = np.diff(b.indptr)
    grown = np.concatenate([[0], np.cumsum(width[a.indices])])[a.indptr]  # entries before each row of a
    sizes, columns, values, i, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, len(a.indptr) - 1
    while i < rows:
        j = max(i + 1, int(np.searchsorted(grown, grown[i] + BLOCK, "right")) - 1)
        part = slice(a.indptr[i], a.indptr[j])
        k = a.indices[part]
        n = width[k]
        before = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(before[-1]) + np.repeat(b.indptr[k] - before[:-1], n)
        row = np.repeat(np.repeat(np.arange(j - i), np.diff(a.indptr[i : j + 1])), n)
        place = row * b.columns + b.indices[at]
        order = np.argsort(place, kind="stable")
        place, value = place[order], (np.repeat(a.data[part], n) * b.data[at])[order]
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]][: len(place)])
        place, value = place[first], np.add.reduceat(value, first) if len(first) else value
        sizes.append(np.bincount(place // max(b.columns, 1), minlength=j - i))
        columns.append(place % max(b.columns, 1)), values.append(value)
        i = j
    return Csr(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64), np.concatenate(columns), np.concatenate(values), b.columns)
