"""Vectorised 64-bit hashes of the words of byte texts and of runs of consecutive words.

A hash of a run is a difference of prefix sums of a polynomial modulo 2**64, moved to position 0
by an inverse power and mixed. Cost per byte is constant, whatever the length of the run.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_BYTE_KEYS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
CHUNK_BYTES = 1 << 18

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers = np.ones(1, np.uint64)
_inverse_powers = np.ones(1, np.uint64)


def _series(base: int, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(n, np.uint64)
    done, step = 1, base
    while done < n:
        more = min(done, n - done)
        np.multiply(out[:more], U64(step), out=out[done : done + more])
        done += more
        step = step * step % (1 << 64)
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse_powers
    if len(_powers) < n:
        size = max(n, 2 * CHUNK_BYTES)
        _powers, _inverse_powers = _series(_MULTIPLIER, size), _series(_INVERSE, size)
    return _powers, _inverse_powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def prefix_sums(values: np.ndarray) -> np.ndarray:
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def run_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end] from the prefix sums of the values."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of bytes that are no separators."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~separators[data]
    steps = np.flatnonzero(np.diff(inside))
    return steps[0::2], steps[1::2]


def byte_sums(data: np.ndarray) -> np.ndarray:
    return prefix_sums(_BYTE_KEYS[data])


class Words:
    """The words of several texts, with their hashes, and where each text's words begin.

    ``bounds[d] : bounds[d + 1]`` are the words of text ``d``. Texts are joined by a line feed,
    which separates words in every word rule used here.
    """

    def __init__(self, texts: list[bytes], separators: np.ndarray, lower: bool) -> None:
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        self.data = LOWER[data] if lower else data
        self.starts, self.ends = words(self.data, separators)
        self.hashes = run_hashes(byte_sums(self.data), self.starts, self.ends)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.bounds = np.searchsorted(self.starts, self.offsets)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all runs of k words that lie in one text, in order."""
        counts = np.maximum(np.diff(self.bounds) - (k - 1), 0)
        first = spans(self.bounds[:-1], counts)
        return first, run_hashes(prefix_sums(self.hashes), first, first + k)


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, … (count numbers) for every pair, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    moved = starts - np.concatenate([[0], np.cumsum(counts)[:-1]])
    return np.repeat(moved, counts) + np.arange(total)


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie in any half-open span."""
    depth = np.bincount(starts, minlength=size + 1) - np.bincount(ends, minlength=size + 1)
    return np.cumsum(depth)[:size] > 0


_PLACE_BITS = 24
_PLACES = U64((1 << _PLACE_BITS) - 1)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the rightmost minimum of every window of ``width`` values.

    Only the upper 40 bits count, so the choice depends on the values in the window alone. Minima
    of 1, 2, 4, … values meet at each window; the cost grows with the logarithm of the width.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    most = (1 << _PLACE_BITS) - width
    if n > most:
        parts = [
            at + window_minima(values[at : at + most + width - 1], width)
            for at in range(0, n, most)
        ]
        return np.concatenate(parts)
    lowest = (values & ~_PLACES) | (_PLACES - np.arange(len(values), dtype=np.uint64))
    reach = 1
    while reach * 2 <= width:
        lowest = np.minimum(lowest[:-reach], lowest[reach:])
        reach *= 2
    if reach < width:
        lowest = np.minimum(lowest[: -(width - reach)], lowest[width - reach :])
    return (_PLACES - (lowest & _PLACES)).astype(np.int64)


def chunks(texts: Iterable[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about ``limit`` bytes together, with the number of the first."""
    held: list[bytes] = []
    size = first = 0
    for number, text in enumerate(texts):
        held.append(text)
        size += len(text) + 1
        if size >= limit:
            yield first, held
            held, size, first = [], 0, number + 1
    if held:
        yield first, held


def binary(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as bytes; null is an empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
