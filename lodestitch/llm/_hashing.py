"""Vectorised hashes of words and byte strings inside a task. Equal content gets equal 64-bit names in every task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_C1, _C2, _C3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = x + _C1
    x = (x ^ (x >> U(30))) * _C2
    x = (x ^ (x >> U(27))) * _C3
    return x ^ (x >> U(31))


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A name for the ordered pair of two names."""
    x = a * _C1 + (b ^ (b >> U(29))) * _C2
    x ^= x >> U(32)
    x *= _C3
    return x ^ (x >> U(29))


def quick_join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A cheaper name for the ordered pair; to be scrambled before it is compared by size."""
    x = a * _C1
    x += b
    x ^= x >> U(29)
    return x


#: A name for each byte.
BYTE = scramble(np.arange(256, dtype=np.uint64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = U(0xD6E8FEB86659FD93)
_INVERSE = U(pow(int(_BASE), -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def span_names(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Names of the spans of a sequence of 64-bit names, by prefix sums of a polynomial."""
    n = len(values)
    up, down = _power(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    return scramble((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def distinct(keys: np.ndarray) -> np.ndarray:
    """The sorted distinct values, by one sort (``np.unique`` alone hashes, which is far slower on many keys)."""
    ordered = np.sort(keys)
    return ordered[np.r_[True, ordered[1:] != ordered[:-1]]] if len(ordered) else ordered


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, offsets); a null text is empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], pa.string())
    a = a.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(a.buffers()[1], dtype=np.int64, count=len(a) + 1 + a.offset)[a.offset :] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], dtype=np.uint8) if len(a) and a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def portions(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together; a longer text is alone."""
    n, first = len(offsets) - 1, 0
    while first < n:
        past = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        past = min(n, max(first + 1, past))
        yield first, past
        first = past


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs outside ``gap`` (white space), none across texts."""
    inside = ~(is_space(data) if gap is None else gap)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[tails] = inside[tails]
    return np.flatnonzero(first), np.flatnonzero(last) + 1
