"""Vectorised polynomial fingerprints over packed byte buffers.

All functions work on flat numpy arrays, so one call serves a whole Arrow batch of
texts.  Fingerprints are polynomials modulo 2**64 over a random byte table; two of them
with different odd bases are used together wherever equality decides a result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_U64 = np.uint64


@lru_cache(maxsize=None)
def byte_table(which: int) -> np.ndarray:
    """256 odd random values, the same in every process."""
    return np.random.Generator(np.random.PCG64(20_000 + which)).integers(1, 2**63, 256, dtype=np.uint64) * _U64(2) + _U64(1)


@lru_cache(maxsize=16)
def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below n, modulo 2**64."""
    base, inverse = _BASES[which], pow(_BASES[which], -1, 2**64)
    out = []
    for b in (base, inverse):
        a = np.empty(n, np.uint64)
        a[0] = 1
        filled = 1
        while filled < n:
            step = min(filled, n - filled)
            a[filled : filled + step] = a[:step] * _U64(pow(b, filled, 2**64))
            filled += step
        out.append(a)
    return out[0], out[1]


def prefix_sums(data: np.ndarray, which: int) -> np.ndarray:
    """Running sums from which ``spans`` takes the fingerprint of any byte span."""
    size = 1 << max(16, int(len(data)).bit_length())
    up, _ = powers(which, size)
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(byte_table(which)[data] * up[: len(data)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """Fingerprints of the byte spans [start, end) of the buffer behind ``sums``."""
    size = 1 << max(16, int(len(sums) - 1).bit_length())
    _, down = powers(which, size)
    return (sums[end] - sums[start]) * down[start]


def mix(a: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a fingerprint depend on all bytes."""
    a = a ^ (a >> _U64(33))
    a = a * _U64(0xFF51AFD7ED558CCD)
    a = a ^ (a >> _U64(33))
    a = a * _U64(0xC4CEB9FE1A85EC53)
    return a ^ (a >> _U64(33))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[0]


def row_groups(offsets: np.ndarray, limit: int):
    """Ranges of consecutive rows of up to ``limit`` bytes together; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)
