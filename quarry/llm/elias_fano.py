"""Elias-Fano code of non-decreasing integers, with select samples for access to any one of them.

n numbers below u take about 2 + log2(u / n) bits each: the low bits are packed, the high bits are a bit vector in
unary. select finds the i-th set bit from a sample of 32-bit positions and a popcount scan of at most SAMPLE bits.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 512
_HEAD = struct.Struct("<QQBxxxIII")  # numbers, offset of all, low bits, bytes of: low, high, samples
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class EliasFano:
    def __init__(self, n: int, base: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.base, self.low_bits, self.low, self.high, self.samples = n, base, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """values: non-decreasing int64."""
        n = len(values)
        if not n:
            return cls(0, 0, 0, *(np.empty(0, t) for t in (np.uint8, np.uint8, np.uint32)))
        base = int(values[0])
        x = values.astype(np.uint64) - np.uint64(base % 2**64)  # modulo 2**64: right for any two int64
        low_bits = max(0, ((int(x[-1]) + 1) // n).bit_length() - 1)
        places = (x >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1, np.uint8)
        bits[places] = 1
        low = np.empty(0, np.uint8)
        if low_bits:
            low = np.packbits((x[:, None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        return cls(n, base, low_bits, low, np.packbits(bits, bitorder="little"), places[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        parts = [a.tobytes() for a in (self.low, self.high, self.samples)]
        return _HEAD.pack(self.n, self.base % 2**64, self.low_bits, *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: memoryview) -> tuple[EliasFano, int]:
        """It and its size in bytes."""
        n, base, low_bits, *sizes = _HEAD.unpack_from(data)
        at, parts = _HEAD.size, []
        for size, kind in zip(sizes, (np.uint8, np.uint8, np.uint32), strict=True):
            parts.append(np.frombuffer(data[at : at + size], kind))
            at += size
        return cls(n, base - 2**64 if base >= 2**63 else base, low_bits, *parts), at

    def select(self, i: int) -> int:
        """Where the i-th set bit of the high part is."""
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        if not left:
            return place
        byte = (place + 1) // 8
        first = int(self.high[byte]) >> ((place + 1) % 8) << ((place + 1) % 8)
        if (place + 1) % 8 == 0:
            first = int(self.high[byte])
        while (ones := int(_POPCOUNT[first])) < left:
            left -= ones
            byte += 1
            first = int(self.high[byte])
        for bit in range(8):
            left -= first >> bit & 1
            if not left:
                return byte * 8 + bit
        raise IndexError(i)

    def __getitem__(self, i: int) -> int:
        low = 0
        for k in range(self.low_bits):
            at = i * self.low_bits + k
            low |= (int(self.low[at // 8]) >> (at % 8) & 1) << k
        return self.base + ((self.select(i) - i) << self.low_bits | low)

    def between(self, i: int, j: int) -> np.ndarray:
        """The numbers from the i-th, before the j-th, int64: selects find where their high parts begin and end."""
        n = j - i
        if n <= 0:
            return np.empty(0, np.int64)
        byte, end = self.select(i) // 8, self.select(j - 1)
        ones = np.flatnonzero(np.unpackbits(self.high[byte : end // 8 + 1], bitorder="little")) + 8 * byte
        ones = ones[np.searchsorted(ones, self.select(i)) :][:n]
        x = (ones - np.arange(i, j)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            first, last = i * self.low_bits, j * self.low_bits
            bits = np.unpackbits(self.low[first // 8 : -(-last // 8)], bitorder="little")[first % 8 :][: last - first].reshape(n, self.low_bits)
            x |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (x + np.uint64(self.base % 2**64)).astype(np.int64)

    def all(self) -> np.ndarray:
        """Every number, int64."""
        return self.between(0, self.n)
