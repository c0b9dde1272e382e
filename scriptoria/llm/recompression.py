"""Recompression of word sequences: rounds of naming pairs and runs, with names that need no dictionary.

Each word has a number.  A round gives every symbol a side by a hash of its
name and replaces each pair of neighbours (left, right) by one symbol whose
name is a hash of the two names; a last round names runs of equal symbols.
Names and sides depend on nothing but the symbols themselves, so every task
names equal pairs alike, and equal stretches of words get equal symbols inside.

Only near the ends of a stretch can the words around it matter.  So each symbol
carries, besides the words it stands for, the reach of words that have decided
that it came about; a symbol whose reach lies inside a stretch stands in every
other occurrence of that stretch too.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import islice

import numpy as np

ROUNDS = 3
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Codes(dict):
    """Codes of words by first occurrence."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


class Numbers:
    """128-bit numbers of words, looked up by a code; forgets all of them when they are too many."""

    def __init__(self, most: int = 400_000):
        self.most, self.codes = most, _Codes()
        self.table = np.zeros((1024, 2), dtype=np.uint64)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """One row of two numbers for each word."""
        if len(self.codes) > self.most:
            self.codes = _Codes()
        known = len(self.codes)
        places = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        while len(self.codes) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for at, word in enumerate(islice(self.codes, known, None), known):
            self.table[at] = np.frombuffer(hashlib.blake2b(word, digest_size=16).digest(), np.uint64)
        return self.table[places]


@dataclass
class Symbols:
    """Parallel arrays: name, words [start, end), reach [low, high)."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray


def recompress(numbers: np.ndarray, wall: np.ndarray, rounds: int = ROUNDS) -> Symbols:
    """Symbols over one row of word numbers in which walls separate documents.

    Nothing merges with a wall, and what a wall has decided reaches over it.
    """
    n = len(numbers)
    at = np.arange(n)
    s = Symbols(numbers, at, at + 1, at, at + 1)
    with np.errstate(over="ignore"):
        for k in range(rounds):
            side = ((mixed(s.name + np.uint64(k + 1) * _B) >> np.uint64(13)) & np.uint64(1)).astype(np.int8)
            side[wall[s.start]] = 2
            first = np.flatnonzero((side[:-1] == 0) & (side[1:] == 1))
            name, end, low, high = s.name.copy(), s.end.copy(), s.low.copy(), s.high.copy()
            # A left symbol stays alone because of the next one, a right one because of the one before.
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            high[left] = np.append(s.high[1:], n + 1)[left]
            low[right] = np.append(-1, s.low[:-1])[right]
            name[first] = mixed(s.name[first] * _A + mixed(s.name[first + 1] + _B))
            end[first], low[first], high[first] = s.end[first + 1], s.low[first], s.high[first + 1]
            stay = np.ones(len(name), dtype=bool)
            stay[first + 1] = False
            s = Symbols(name[stay], s.start[stay], end[stay], low[stay], high[stay])
        # Runs of equal symbols, decided by both neighbours.
        if len(s.name):
            begins = np.flatnonzero(np.append(True, s.name[1:] != s.name[:-1]))
            ends = np.append(begins[1:], len(s.name))
            runs = (ends - begins > 1) & ~wall[s.start[begins]]
            begins, ends = begins[runs], ends[runs]
            run = Symbols(
                mixed(s.name[begins] * _B + (ends - begins).astype(np.uint64)), s.start[begins], s.end[ends - 1],
                np.append(-1, s.low)[begins], np.append(s.high, n + 1)[ends],
            )
            s = Symbols(*(np.concatenate([getattr(s, f), getattr(run, f)]) for f in ("name", "start", "end", "low", "high")))
    return s
