"""Where the words of packed texts lie, for whole Arrow batches at once."""

from __future__ import annotations

import numpy as np

#: Bytes with A-Z made small.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(members: bytes) -> np.ndarray:
    """256 booleans: whether a byte is one of ``members``."""
    out = np.zeros(256, bool)
    out[np.frombuffer(members, np.uint8)] = True
    return out


def edges(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes that are ``inside``; no run crosses rows."""
    firsts, lasts = inside.copy(), inside.copy()
    firsts[1:] &= ~inside[:-1]
    lasts[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(inside))]
    firsts[cuts] |= inside[cuts]
    lasts[cuts - 1] |= inside[cuts - 1]
    starts = np.flatnonzero(firsts)
    return starts, np.flatnonzero(lasts) + 1, np.searchsorted(offsets, starts, side="right") - 1


def joined(data: np.ndarray, inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words, lower-cased, with one space after each; their starts and ends there; their rows and first places."""
    first, ends, row = edges(inside, offsets)
    sizes = ends - first
    after = np.cumsum(sizes + 1)
    out = np.full(after[-1] if len(after) else 0, 32, np.uint8)
    out[np.flatnonzero(inside) + np.repeat(after - sizes - 1 - first, sizes)] = LOWER[data[inside]]
    return out, after - sizes - 1, after - 1, row, first
