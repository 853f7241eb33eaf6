"""Words and word n-grams of whole Arrow text columns as 64-bit hashes.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased (`FOLDED`) or as
it is (`EXACT`). Texts are hashed where they lie in the Arrow buffer, a window of bytes at a
time, so memory does not follow the length of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from marginalia.llm.shared import mixed, odd_numbers

WINDOW = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
EXACT = odd_numbers(256, 11)
FOLDED = EXACT.copy()
FOLDED[65:91] = FOLDED[97:123]
_STEPS = odd_numbers(64, 12)

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _reach(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least `size` of each."""
    global _powers, _inverses
    if len(_powers) < size:
        steps = np.full(size, _BASE, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps)
        steps[1:] = np.uint64(pow(_BASE, -1, 1 << 64))
        _inverses = np.cumprod(steps)
    return _powers, _inverses


def _next_space(data: np.ndarray, at: int, end: int) -> int:
    while at < end:
        found = np.flatnonzero(SPACE[data[at : min(end, at + 4096)]])
        if len(found):
            return at + int(found[0])
        at += 4096
    return end


def _window(part: np.ndarray, breaks: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word starts and word hashes of one window; `breaks` are row starts inside it."""
    inside = ~SPACE[part]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[breaks] = inside[breaks]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = breaks[breaks > 0] - 1
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, run_hashes(part, starts, ends, values)


def run_hashes(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = FOLDED) -> np.ndarray:
    """Hash of the bytes of each run; `values` has a number for every byte."""
    powers, inverses = _reach(len(part))
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(values[part] * powers[: len(part)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverses[starts])


def word_hashes(column: pa.Array, values: np.ndarray = FOLDED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word, first word of every row and the end, byte position of every word).

    Null texts have no words. Equal words have equal hashes in every batch.
    """
    column = column.fill_null("").cast(pa.large_string())
    rows = len(column)
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + rows + 1]
    stored = column.buffers()[2]
    data = np.frombuffer(stored, np.uint8) if stored is not None else np.zeros(0, np.uint8)
    begin, end = int(offsets[0]), int(offsets[-1])
    starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    while begin < end:
        stop = min(end, begin + WINDOW)
        if stop < end:
            stop = min(_next_space(data, stop, end), int(offsets[np.searchsorted(offsets, stop)]))
        low, high = np.searchsorted(offsets, [begin, stop])
        found, own = _window(data[begin:stop], np.unique(offsets[low:high]) - begin, values)
        starts.append(found + begin)
        hashes.append(own)
        begin = stop
    places = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(places, offsets), places


def words_hash(words: list[np.ndarray]) -> np.ndarray:
    """Hash of the words that stand at the same place of all arrays, in order."""
    total = np.full(len(words[0]), np.uint64(len(words)), np.uint64)
    for k, hashes in enumerate(words):
        total += hashes * _STEPS[k]
    return mixed(total)


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; row ends are the caller's business."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(size, np.uint64(n), np.uint64)
    for k in range(n):
        total += hashes[k : k + size] * _STEPS[k]
    return mixed(total)


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of every row; fewer than n words count as one n-gram."""
    hashes, bounds, _ = word_hashes(column)
    grams = ngram_hashes(hashes, n)
    sets = []
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if high - low >= n:
            sets.append(np.unique(grams[low : high - n + 1]))
        else:
            sets.append(ngram_hashes(hashes[low:high], high - low) if high > low else grams[:0])
    return sets
