"""Elias-Fano lists: ascending whole numbers in about 2 + log2(range / count) bits each, read at any place by select.

A value's low bits stand packed one after another. Its high part is a bit in a row of bits: the i-th value sets bit
(high part + i), so the place of the k-th set bit gives the k-th high part. The places of every ``EVERY``-th set bit are
kept as 32-bit numbers, which is all that ``select`` needs beside a short scan; there is no table of 64-bit offsets.
"""

from __future__ import annotations

import struct

import numpy as np

U64 = np.uint64
EVERY = 512
_HEADER = struct.Struct("<4sIQQQQ")
MAGIC = b"EFL1"


class EliasFano:
    def __init__(self, n: int, base: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.base, self.width, self.low, self.high, self.samples = n, base, width, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """From ascending 64-bit values (equal ones may stand side by side); the least is the base."""
        n = len(values)
        if not n:
            return cls(0, 0, 0, np.empty(0, np.uint8), np.empty(0, np.uint8), np.empty(0, np.uint32))
        if (values[1:] < values[:-1]).any():
            raise ValueError("the values do not ascend")
        base = int(values[0])
        v = values.astype(U64) - U64(base & (1 << 64) - 1)
        width = max(0, (int(v[-1]) // n).bit_length() - 1)
        low = [np.packbits(((v[i : i + (1 << 16), None] >> np.arange(width, dtype=U64)) & U64(1)).astype(np.uint8), bitorder="little") for i in range(0, n, 1 << 16)] if width else []
        place = (v >> U64(width)).astype(np.int64) + np.arange(n)
        if place[-1] >= 1 << 32:
            raise ValueError("too many values for one list")
        high = np.zeros(int(place[-1]) // 8 + 1, np.uint8)
        np.bitwise_or.at(high, place >> 3, np.left_shift(1, place & 7).astype(np.uint8))
        return cls(n, base, width, np.concatenate(low) if low else np.empty(0, np.uint8), high, place[::EVERY].astype(np.uint32))

    def _places(self, first: int, last: int) -> np.ndarray:
        """Places of the set bits first .. last - 1: from the sample before them on, in growing steps."""
        start = int(self.samples[first // EVERY])
        skip = first % EVERY
        at = start >> 3
        wanted, size = skip + last - first, 64
        while True:
            bits = np.unpackbits(self.high[at : at + size], bitorder="little")
            bits[: start & 7] = 0
            ones = np.flatnonzero(bits)
            if len(ones) >= wanted:
                return ones[skip:wanted] + at * 8
            size = max(size * 2, 2 * (wanted // 8))

    def select(self, k: int) -> int:
        """The k-th value."""
        return int(self.slice(k, k + 1)[0])

    def slice(self, first: int, last: int) -> np.ndarray:
        """The values first .. last - 1, as signed 64-bit numbers."""
        if not 0 <= first <= last <= self.n:
            raise IndexError(f"{first} to {last} of {self.n}")
        if first == last:
            return np.empty(0, np.int64)
        high = (self._places(first, last) - np.arange(first, last)).astype(U64) << U64(self.width)
        if self.width:
            bit = first * self.width
            packed = np.unpackbits(self.low[bit >> 3 : (last * self.width + 7) >> 3], bitorder="little")[bit & 7 :][: (last - first) * self.width]
            high |= (packed.reshape(-1, self.width).astype(U64) << np.arange(self.width, dtype=U64)).sum(1, dtype=U64)
        return (high + U64(self.base & (1 << 64) - 1)).astype(np.int64)

    def to_bytes(self) -> bytes:
        head = _HEADER.pack(MAGIC, self.width, self.n, self.base & (1 << 64) - 1, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The list that begins at a place of ``data``, and the place behind it."""
        magic, width, n, base, low, high = _HEADER.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError("no Elias-Fano list here")
        at += _HEADER.size
        samples = -(-n // EVERY)
        end = at + low + high + 4 * samples
        if len(data) < end:
            raise ValueError("the list is cut short")
        part = lambda a, size, kind: np.frombuffer(data, kind, size, a)
        base = base - (1 << 64) if base >> 63 else base
        return cls(n, base, width, part(at, low, np.uint8), part(at + low, high, np.uint8), part(at + low + high, samples, "<u4")), end
