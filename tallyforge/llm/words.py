"""Hashes of words and of runs of words, computed for a whole batch of texts at once.

A word is a run of bytes other than space and tab to carriage return, with A-Z lower-cased. Its hash comes from
prefix sums of a polynomial in a 64-bit ring, so that no Python code runs for a word.
"""

from __future__ import annotations

import numpy as np

from .common import PIECE_BYTES, mix

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        x = np.full(n, base, np.uint64)
        x[0] = 1
        _powers[base] = np.multiply.accumulate(x)
    return _powers[base][:n]


def _words(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of adjacent texts and the number of words of each."""
    base, n = int(starts[0]), int(stops[-1] - starts[0])
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    bytes_ = data[base : base + n]
    word = ~gaps[bytes_]
    filled = stops > starts
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[1:], last[:-1] = ~word[:-1], ~word[1:]
    first[starts[filled] - base], last[stops[filled] - 1 - base] = True, True
    begin, end = np.flatnonzero(word & first), np.flatnonzero(word & last) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(VALUE[LOWER[bytes_]] * powers(BASE, max(n, PIECE_BYTES))[:n], out=total[1:])
    found = mix((total[end] - total[begin]) * powers(INVERSE, max(n, PIECE_BYTES))[:n][begin] + (end - begin).astype(np.uint64))
    edges = np.searchsorted(begin, np.append(starts, stops[-1]) - base)
    return found, np.diff(edges)


def word_hashes(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """For adjacent texts: the hashes of all words in order, and the number of words of each text.

    ``gaps`` tells which bytes part words. A text longer than a piece is cut at one, so memory does not follow the longest text's bytes eightfold.
    """
    if len(offsets) == 2 and offsets[1] - offsets[0] > PIECE_BYTES:
        at, stop, parts = int(offsets[0]), int(offsets[1]), []
        while at < stop:
            to = min(stop, at + PIECE_BYTES)
            if to < stop and (ends := np.flatnonzero(gaps[data[at:to]])).size:
                to = at + int(ends[-1]) + 1
            elif to < stop:
                while to < stop and not gaps[data[to]]:
                    to += 1
            parts.append(_words(data, np.array([at]), np.array([to]), gaps)[0])
            at = to
        found = np.concatenate(parts)
        return found, np.array([len(found)])
    return _words(data, offsets[:-1], offsets[1:], gaps)


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words of each text, in order with repeats, and how many each text has.

    A text with fewer words gives the run of all of them; one without words gives none.
    """
    n = len(words)
    rolled = np.zeros(n, np.uint64)
    for i in range(k):
        rolled[: max(n - i, 0)] += words[i:] * powers(INVERSE, 64)[i + 1]
    rolled = mix(rolled)
    starts = np.cumsum(counts) - counts
    have = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        own = words[starts[d] : starts[d] + counts[d]]
        rolled[starts[d]] = mix(np.array([(own * powers(INVERSE, 64)[1 : len(own) + 1]).sum() + np.uint64(counts[d])]))[0]
    inside = np.arange(n) - np.repeat(starts, counts) < np.repeat(have, counts)
    return rolled[inside], have


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    rolled, have = shingles(*word_hashes(data, offsets), k)
    stops = np.cumsum(have)
    return [np.unique(rolled[b - h : b]) for b, h in zip(stops, have)]
