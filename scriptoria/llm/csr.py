"""Sparse matrices in compressed rows, built by hand on numpy arrays, and their row-wise (Gustavson) product."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

# Entries of partial products that one block of rows may make at a time.
BLOCK = 1 << 20


@dataclass
class Csr:
    """Row r has the entries ``columns[starts[r]:starts[r + 1]]`` with ``values`` beside them."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @property
    def height(self) -> int:
        return len(self.starts) - 1

    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(self.height), np.diff(self.starts))


def from_entries(rows: np.ndarray, columns: np.ndarray, height: int, width: int, values: np.ndarray | None = None) -> Csr:
    """Entries in any order; those of one place are added."""
    values = np.ones(len(rows), np.int64) if values is None else values
    place = rows.astype(np.int64) * width + columns
    if len(place) and not (place[1:] > place[:-1]).all():
        place, values = _added(place, values)
    starts = np.zeros(height + 1, np.int64)
    np.cumsum(np.bincount(place // width, minlength=height) if len(place) else np.zeros(height, np.int64), out=starts[1:])
    return Csr(starts, place % width, values, width)


def transposed(m: Csr) -> Csr:
    in_order = (m.columns[1:] >= m.columns[:-1]).all()
    order = np.arange(len(m.columns)) if in_order else np.argsort(m.columns, kind="stable")
    starts = np.zeros(m.width + 1, np.int64)
    np.cumsum(np.bincount(m.columns, minlength=m.width), out=starts[1:])
    return Csr(starts, m.rows()[order], m.values[order], m.height)


def _added(place: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in order, values of one place added."""
    if not (place[1:] >= place[:-1]).all():
        order = np.argsort(place, kind="stable")
        place, values = place[order], values[order]
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    return place[first], np.add.reduceat(values, first)


def product_blocks(a: Csr, b: Csr, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, columns, values) of ``a @ b`` by blocks of rows, in order: each row of ``a`` adds up the rows of ``b`` it names.

    A block takes at most ``block`` partial entries, or one row; a row with
    more is added up piece by piece.
    """
    lengths = np.diff(b.starts)[a.columns]
    ends = np.cumsum(lengths)
    row = 0
    while row < a.height:
        done = ends[a.starts[row] - 1] if a.starts[row] else 0
        last = max(row + 1, int(np.searchsorted(np.append(0, ends)[a.starts], done + block, side="right")) - 1)
        first_entry, last_entry = a.starts[row], a.starts[last]
        place, values = np.zeros(0, np.int64), np.zeros(0, np.int64)
        owners = np.repeat(np.arange(row, last), np.diff(a.starts[row : last + 1]))
        while first_entry < last_entry:
            done = ends[first_entry - 1] if first_entry else 0
            until = min(last_entry, max(first_entry + 1, int(np.searchsorted(ends, done + block, side="right"))))
            n = lengths[first_entry:until]
            total = int(n.sum())
            at = np.repeat(b.starts[a.columns[first_entry:until]] - (np.cumsum(n) - n), n) + np.arange(total)
            own = owners[first_entry - a.starts[row] : until - a.starts[row]]
            place = np.concatenate([place, np.repeat(own, n) * b.width + b.columns[at]])
            values = np.concatenate([values, np.repeat(a.values[first_entry:until], n) * b.values[at]])
            if len(place):
                place, values = _added(place, values)
            first_entry = until
        if len(place):
            yield place // b.width, place % b.width, values
        row = last
