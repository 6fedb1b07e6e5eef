"""Elias-Fano coding of non-decreasing numbers, and a token file format that uses it for document boundaries.

n numbers up to u take about 2 + log2(u / n) bits each: the low bits are packed, the high bits are a unary bit vector.
Positions of every 256th set bit let select find one number in constant time: it counts bits between two such
positions, and where these lie far apart (SPARSE bits or more) it looks the bit up in a list. Stretches that long are
few, so the lists add less than two bits a number.
"""

from __future__ import annotations

import struct
from array import array

import numpy as np

#: STEP numbers are packed at a time.
SAMPLE, SPARSE, STEP = 256, 16_384, 65_536
_HEAD = struct.Struct("<QQBQQIQ")
_COUNTS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _bits(packed: np.ndarray, first: int, count: int) -> np.ndarray:
    """Bits [first, first + count) of a packed vector, reading no other bytes."""
    skip = first % 8
    return np.unpackbits(packed[first // 8 : (first + count + 7) // 8], bitorder="little")[skip : skip + count]


def _packed(values: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of each number, one after the other."""
    return np.packbits(((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")


class EliasFano:
    """n non-decreasing numbers >= 0; x[i] selects one, part(a, b) gives some, decode() all."""

    def __init__(self, n: int, upto: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray, wide: np.ndarray):
        """wide: the positions of all set bits of the stretches between samples that are SPARSE bits or longer."""
        self.n, self.upto, self.low_bits, self.low, self.high, self.samples, self.wide = n, upto, low_bits, low, high, samples, wide
        ends = np.append(samples[1:], len(high) * 8).astype(np.int64) if len(samples) else np.zeros(0, np.int64)
        far = ends - samples.astype(np.int64) >= SPARSE
        #: for each stretch the place of its list in wide, -1 without one
        self.listed = np.where(far, (np.cumsum(far) - far) * SAMPLE, -1)

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, upto = len(v), int(v[-1]) if len(v) else 0
        bits = max(0, (upto // n).bit_length() - 1) if n else 0
        # a step's numbers, a multiple of eight, fill whole bytes
        low = np.concatenate([np.zeros(0, np.uint8)] + [_packed(v[a : a + STEP], bits) for a in range(0, n if bits else 0, STEP)])
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        high, kind = np.packbits(unary, bitorder="little"), np.uint32 if not n or ones[-1] < 2**32 - 1 else np.uint64
        out = cls(n, upto, bits, low, high, ones[::SAMPLE].astype(kind), np.zeros(0, kind))
        long = np.flatnonzero(out.listed >= 0)
        if len(long):
            padded = np.append(ones, np.full(-n % SAMPLE, ones[-1])).reshape(-1, SAMPLE)
            out.wide = padded[long].ravel().astype(kind)
        return out

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.n, self.upto, self.low_bits, len(self.low), len(self.high), self.samples.itemsize, len(self.wide)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes() + self.wide.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes | memoryview, at: int = 0) -> tuple[EliasFano, int]:
        n, upto, bits, lows, highs, item, wides = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        low, high = np.frombuffer(data, np.uint8, lows, at), np.frombuffer(data, np.uint8, highs, at + lows)
        at += lows + highs
        count = -(-n // SAMPLE)
        samples = np.frombuffer(data, f"<u{item}", count, at)
        at += count * item
        return cls(n, upto, bits, low, high, samples, np.frombuffer(data, f"<u{item}", wides, at)), at + wides * item

    def __len__(self) -> int:
        return self.n

    def _select(self, i: int) -> int:
        """The position of set bit i: at most SPARSE / 8 bytes are counted."""
        block, left = divmod(i, SAMPLE)
        if self.listed[block] >= 0:
            return int(self.wide[self.listed[block] + left])
        bit = int(self.samples[block])
        if not left:
            return bit
        at, skip = bit // 8, bit % 8
        stop = int(self.samples[block + 1]) // 8 + 1 if block + 1 < len(self.samples) else len(self.high)
        chunk = self.high[at:stop].copy()
        chunk[0] = chunk[0] >> skip << skip
        counts = np.cumsum(_COUNTS[chunk], dtype=np.int64)
        step = int(np.searchsorted(counts, left + 1))  # the sampled bit counts too
        byte, left = int(chunk[step]), left - (int(counts[step - 1]) if step else 0)
        for _ in range(left):
            byte &= byte - 1
        return (at + step) * 8 + (byte & -byte).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = (self._select(i) - i) << self.low_bits
        for b in range(self.low_bits):
            where = i * self.low_bits + b
            value |= (int(self.low[where // 8]) >> where % 8 & 1) << b
        return value

    def part(self, a: int, b: int) -> np.ndarray:
        """Numbers a to b - 1: two selects bound the bits that are read."""
        if b <= a:
            return np.zeros(0, np.int64)
        first, last = self._select(a), self._select(b - 1)
        ones = first + np.flatnonzero(_bits(self.high, first, last - first + 1))
        high = (ones - np.arange(a, b)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high.astype(np.int64)
        bits = _bits(self.low, a * self.low_bits, (b - a) * self.low_bits).reshape(b - a, self.low_bits)
        return (high | (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)).astype(np.int64)

    def decode(self) -> np.ndarray:
        return self.part(0, self.n)


#: Magic, bytes an id, documents, null keys among them, the smallest key, where the boundaries begin.
_FILE = struct.Struct("<4sBQQqQ")
_MAGIC = b"EFT2"


class TokenFileWriter:
    """Streams ids to a file; boundaries and keys, which alone are held, follow at the end.

    Documents come in ascending order of their keys, nulls first, with their ids as unsigned 32-bit bytes.
    """

    def __init__(self, out, width: int):
        self.out, self.width, self.nulls, self.ids = out, width, 0, 0
        self.keys, self.lengths = array("q"), array("q")

    def add(self, key: int | None, ids: bytes) -> None:
        self.out.write(np.frombuffer(ids, "<u4").astype(f"<u{self.width}").tobytes())
        if key is None:
            self.nulls += 1
        else:
            self.keys.append(key)
        self.lengths.append(len(ids) // 4)
        self.ids += len(ids) // 4

    @property
    def docs(self) -> int:
        return len(self.lengths)

    def finish(self) -> None:
        own = np.frombuffer(self.keys, np.int64)
        least = int(own[0]) if len(own) else 0
        ends = EliasFano.encode(np.cumsum(np.frombuffer(self.lengths, np.int64)))
        keys = EliasFano.encode((own - least).astype(np.uint64))
        self.out.write(ends.to_bytes() + keys.to_bytes() + _FILE.pack(_MAGIC, self.width, self.docs, self.nulls, least, self.ids * self.width))


class TokenFile:
    """Reads a token file of so many bytes through read(offset, count); document i holds ids [start(i), start(i + 1)).

    Opening it reads the boundaries; ids are read for the documents asked for.
    """

    def __init__(self, read, size: int):
        self.read = read
        if size < _FILE.size:
            raise ValueError("not a token file")
        magic, self.width, self.n, self.nulls, self.least, at = _FILE.unpack(read(size - _FILE.size, _FILE.size))
        if magic != _MAGIC:
            raise ValueError("not a token file")
        data = read(at, size - _FILE.size - at)
        self.ends, at = EliasFano.from_bytes(data)
        self.keys_coded, at = EliasFano.from_bytes(data, at)

    def start(self, i: int) -> int:
        return self.ends[i - 1] if i else 0

    def starts(self, a: int, b: int) -> np.ndarray:
        """start(a) to start(b)."""
        return np.append(self.start(a), self.ends.part(a, b))

    def ids(self, first: int, last: int) -> np.ndarray:
        return np.frombuffer(self.read(first * self.width, (last - first) * self.width), f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.start(i), self.start(i + 1))

    def keys(self, a: int, b: int) -> list[int | None]:
        some = self.keys_coded.part(max(0, a - self.nulls), max(0, b - self.nulls))
        return [None] * (min(b, self.nulls) - min(a, self.nulls)) + (some + self.least).tolist()
