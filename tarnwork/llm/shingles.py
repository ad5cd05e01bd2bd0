"""Word shingles of packed texts, as 64-bit fingerprints."""

from __future__ import annotations

import numpy as np

from tarnwork.llm import fingerprints as fp

WORDS = 5
_U64 = np.uint64
_CHUNK = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_fingerprints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the lower-cased words of all rows, and the row of each word."""
    space = _SPACE[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = space[:-1]
    edge[offsets[:-1]] = True  # a row's first byte follows no other row's word
    starts = np.flatnonzero(edge[:-1] & ~space)
    stop = np.ones(len(data) + 1, bool)
    stop[:-1] = space
    stop[offsets[1:]] = True
    stop[0] = False
    after = np.ones(len(data) + 1, bool)
    after[1:] = ~space
    ends = np.flatnonzero(stop & after)
    if len(ends) and len(starts) and ends[0] <= starts[0]:
        ends = ends[1:]
    sums = fp.prefix_sums(_LOWER[data], 0)
    words = fp.mix(fp.spans(sums, starts, ends, 0) + (ends - starts).astype(np.uint64))
    return words, np.searchsorted(offsets, starts, side="right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of every row, sorted within the row, and each row's count.

    A row with fewer words than ``width`` has its whole word sequence as one shingle; a row
    without words has none.
    """
    values, counts = [], []
    for a, b in fp.row_groups(offsets, _CHUNK):
        part = offsets[a : b + 1] - offsets[a]
        words, row = word_fingerprints(data[offsets[a] : offsets[b]], part)
        per_row = np.bincount(row, minlength=b - a)
        first = np.concatenate(([0], np.cumsum(per_row)))
        hashed = np.zeros(len(words), np.uint64)
        left = np.repeat(first[1:], per_row) - np.arange(len(words))  # words to the row's end
        for k in range(width):
            inside = left > k
            step = np.zeros(len(words), np.uint64)
            step[inside] = words[np.flatnonzero(inside) + k]
            hashed = np.where(inside, fp.mix(hashed * _U64(0x9E3779B97F4A7C15) + step), hashed)
        whole = left >= width
        whole[first[:-1][(per_row > 0) & (per_row < width)]] = True
        hashed, row = hashed[whole], row[whole]
        order = np.lexsort((hashed, row))
        hashed, row = hashed[order], row[order]
        keep = np.ones(len(hashed), bool)
        keep[1:] = (hashed[1:] != hashed[:-1]) | (row[1:] != row[:-1])
        values.append(hashed[keep])
        counts.append(np.bincount(row[keep], minlength=b - a))
    if not values:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(values), np.concatenate(counts)
