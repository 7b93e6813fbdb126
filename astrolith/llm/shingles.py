"""Word shingles of whole texts, hashed with numpy straight from UTF-8 bytes."""

from __future__ import annotations

import numpy as np

from astrolith.llm.common import mix

#: Words in a shingle.
WIDTH = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = True, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased if ``fold``) of the texts
    that ``offsets`` cut ``data`` into, and the n+1 word offsets of the texts. ``breaks``: which bytes
    part words instead."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13))) if breaks is None else ~breaks[data]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | begins[1:n]
    at = np.flatnonzero(solid)
    starts = np.flatnonzero(first)
    bounds = np.searchsorted(starts, offsets)
    if not len(at):
        return np.zeros(0, np.uint64), bounds
    ranks = np.searchsorted(at, starts)
    lengths = np.diff(np.append(ranks, len(at)))
    letters = data[at]
    if fold:
        letters = np.where((letters >= 65) & (letters <= 90), letters + 32, letters)
    letters = letters.astype(np.uint64)
    place = np.arange(len(at), dtype=np.uint64) - np.repeat(ranks, lengths).astype(np.uint64)
    place *= np.uint64(256)
    place += letters
    place += np.uint64(1)
    place *= _STEP
    return mix(np.add.reduceat(mix(place), ranks)), bounds


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: runs of ``width`` words, the whole
    sequence where there are fewer words, nothing where there are none."""
    words, bounds = word_hashes(data, offsets)
    n = len(words)
    if n >= width:
        rolled = words[: n - width + 1].copy()
        for k in range(1, width):
            rolled *= _STEP
            rolled += words[k : n - width + 1 + k]
        rolled = mix(rolled)
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            sets.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = h * _STEP + w
            sets.append(mix(np.array([h ^ np.uint64(0x5BF0)], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
