"""Byte-level text work on Arrow batches with numpy: words, hashes of words and of word runs.

A word is a run of bytes other than the space and 0x09-0x0D, so words are found on UTF-8
without decoding. Hashes are differences of a prefix polynomial modulo 2**64, which gives the
hash of any byte range in constant time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy step works on; one longer text is a step of its own.
STEP_BYTES = 2_000_000
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
#: Powers come from two short tables: of the low bits of an exponent, and of the rest.
LOW_BITS, BLOCK = 12, 1 << 20
_high: dict[str, np.ndarray] = {}


def steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of slices of whole texts; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        after = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, after, data[offsets[first] : offsets[after]], offsets[first : after + 1] - offsets[first]
        first = after


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data - np.uint8(9)) <= 4)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~is_space(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def powers_of(factor: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


LOW_UP, LOW_DOWN = powers_of(BASE, 1 << LOW_BITS), powers_of(INVERSE, 1 << LOW_BITS)


def high_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and INVERSE to multiples of 2**LOW_BITS, up to n."""
    need = (n >> LOW_BITS) + 1
    if "up" not in _high or len(_high["up"]) < need:
        _high["up"] = powers_of(np.uint64(pow(int(BASE), 1 << LOW_BITS, 2**64)), need)
        _high["down"] = powers_of(np.uint64(pow(int(INVERSE), 1 << LOW_BITS, 2**64)), need)
    return _high["up"], _high["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class RangeHash:
    """Hashes of byte ranges of one buffer; equal bytes hash equally wherever they stand."""

    def __init__(self, data: np.ndarray):
        up, self.down = high_powers(len(data))
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        for at in range(0, len(data), BLOCK):  # a block at a time, so that little stands beside the prefix
            part = data[at : at + BLOCK].astype(np.uint64)
            part += np.uint64(1)
            part *= (up[at >> LOW_BITS : (at + BLOCK) >> LOW_BITS, None] * LOW_UP).ravel()[: len(part)]
            part[:1] += self.prefix[at : at + 1]
            np.cumsum(part, out=self.prefix[at + 1 : at + 1 + len(part)])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = self.prefix[end] - self.prefix[start]
        h *= LOW_DOWN[start & ((1 << LOW_BITS) - 1)]
        h *= self.down[start >> LOW_BITS]
        return mixed(h)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of width values; len(values) - width + 1 of them."""
    if len(values) < width:
        return values[:0]
    span, least = 1, values
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
