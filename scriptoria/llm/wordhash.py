"""64-bit hashes of all words of many texts as array work, without a list or a dictionary of words."""

from __future__ import annotations

import re

import numpy as np

# Bytes that are hashed at a time; a longer word is a block of its own.
BLOCK_BYTES = 1 << 18
# A random number for each byte at each of so many places in a word; further places multiply them.
PLACES = 32
_CODES = np.random.default_rng(20_260_301).integers(0, np.iinfo(np.uint64).max, size=(PLACES, 256), dtype=np.uint64, endpoint=True)
_ODD, _LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_NEXT_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _block(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of one string and where they begin."""
    codes = np.frombuffer(text, dtype=np.uint8)
    at = np.flatnonzero(~_BLANK[codes])
    if not len(at):
        return np.zeros(0, np.uint64), at
    first = np.flatnonzero(np.append(True, np.diff(at) > 1))
    lengths = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    values = _CODES[place % PLACES, codes[at]]
    if lengths.max() > PLACES:
        values *= np.uint64(2) * (place // PLACES).astype(np.uint64) * _ODD + np.uint64(1)
    return mixed(np.add.reduceat(values, first) + lengths.astype(np.uint64) * _LENGTH), at[first]


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs between blanks, A-Z lower-cased) of all texts, one after the other, and how many each text has."""
    out, counts = [], np.zeros(len(texts), dtype=np.int64)
    part: list[bytes] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if part:
            hashes, starts = _block(b" ".join(part).lower())
            out.append(hashes)
            ends = np.cumsum([len(p) + 1 for p in part])
            np.add.at(counts, np.array(owners)[np.searchsorted(ends, starts, side="right")], 1)
        part.clear()
        owners.clear()
        size = 0

    for k, text in enumerate(texts):
        at = 0
        while text and at < len(text):
            end = len(text)
            if end - at > BLOCK_BYTES:
                blank = _NEXT_BLANK.search(text, at + BLOCK_BYTES)
                end = blank.start() if blank else end
            if size + end - at > BLOCK_BYTES:
                flush()
            part.append(text[at:end])
            owners.append(k)
            size += end - at
            at = end
    flush()
    return np.concatenate([*out, np.zeros(0, np.uint64)]), counts
