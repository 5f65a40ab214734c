"""Words of UTF-8 texts and rolling hashes of word windows, on whole Arrow columns at a time.

A word is a run of bytes other than space and 0x09-0x0D. A word's hash is a polynomial over its
bytes modulo 2**64 (Rabin-Karp, by prefix sums); a window's hash is a polynomial over the hashes
of its words. All arrays stand for one block of texts, so memory follows the block, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
# Bytes that are hashed at a time, some 40 bytes of arrays each; a longer word by itself.
_SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread the bits of 64-bit integers (the finisher of SplitMix64)."""
    x = x + np.uint64(seed & _MASK)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class _Powers:
    """Powers of the base and of its inverse, up to the longest span asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(18, (n - 1).bit_length())

            def powers(base: int) -> np.ndarray:
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                return np.cumprod(steps, dtype=np.uint64)

            self.up, self.down = powers(_BASE), powers(pow(_BASE, -1, 1 << 64))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of runs of texts with at most ``block_bytes``, or of one text."""
    data, offs = utf8_parts(column)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offs, offs[first] + block_bytes, "right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, end, data[offs[first] : offs[end]], offs[first : end + 1] - offs[first]
        first = end


class Words:
    """Word positions of a block: byte ``starts`` and ``ends``, and per text the first word's index."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, fold: bool = False) -> None:
        self.data = _LOWER[data] if fold else data
        inside = ~_IS_SPACE[data]
        first, last = inside.copy(), inside.copy()
        if len(data):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            cuts = offs[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < len(data))]
            first[cuts] = inside[cuts]
            last[cuts - 1] = inside[cuts - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        out = np.empty(len(self.starts), np.uint64)
        i, n = 0, len(self.starts)
        while i < n:
            j = max(int(np.searchsorted(self.ends, self.starts[i] + _SEGMENT, "right")), i + 1)
            lo, hi = self.starts[i], self.ends[j - 1]
            up, down = _POWERS.upto(int(hi - lo))
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(_BYTE_VALUE[self.data[lo:hi]] * up, out=sums[1:])
            a, b = self.starts[i:j] - lo, self.ends[i:j] - lo
            out[i:j] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
            i = j
        return mix(out)

    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def window_hashes(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hash of every run of ``size`` words, whatever text the words belong to."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, (seed * 2 + 1) & _MASK, np.uint64)
    base = np.uint64((_BASE * (2 * seed + 3)) & _MASK | 1)
    for i in range(size):
        out *= base
        out += words[i : i + n]
    return mix(out, seed)


def by_first_seen(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of ``keys``, and where in it each new key begins."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return order, new


def pack_ints(values: np.ndarray) -> bytes:
    """Integers of zero or more in seven-bit groups, low group first (LEB128)."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 10):
        longer = values >= np.uint64(1) << np.uint64(7 * k)
        if not longer.any():
            break
        sizes += longer
    at = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        group = (values[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[has] + k] = group.astype(np.uint8) | ((sizes[has] > k + 1).astype(np.uint8) << 7)
    return out.tobytes()


def unpack_ints(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate(([0], ends[:-1] + 1))
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)


def pack_gaps(values: np.ndarray) -> bytes:
    """Ascending integers, the first of any sign."""
    gaps = np.diff(values, prepend=0)
    if len(gaps):
        gaps[0] = (gaps[0] << 1) ^ (gaps[0] >> 63)
    return pack_ints(gaps)


def unpack_gaps(blob: bytes) -> np.ndarray:
    gaps = unpack_ints(blob)
    if len(gaps):
        gaps[0] = (gaps[0] >> 1) ^ -(gaps[0] & 1)
    return np.cumsum(gaps)


def pack_tail(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit integers."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_tail(blob: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()
