"""Counting quotient filters over packed n-grams of word ids, as sorted arrays that can be sent and merged.

An n-gram of ids of `bits` bits each is one number of n * bits bits, held in two halves. A Feistel network permutes
it invertibly, so that equal ranges of the permuted numbers hold about equally many n-grams; its leading bits are
the number of the range (a shard), the next ones the quotient and all others the remainder. As nothing of the number
is left out, the filter is lossless: counts are exact and the n-grams can be read back.

A filter's slots are in the order of the permuted numbers. A bit for each quotient says whether it is occupied, a
bit for each slot whether it ends its quotient's run, so a slot holds only its remainder. Counters of one take no
room; a bit for each slot tells the others, which have a byte each, or eight where that is too little.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from .wordblocks import mix, runs_of

_ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
#: A counter byte that says that the counter is among the wide ones.
WIDE = 255


def ones(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


@dataclass(frozen=True)
class Packing:
    """How n ids of some bits each make one number of two halves, at most 64 bits each."""

    n: int
    bits: int

    def __post_init__(self):
        if self.n < 2 or not 1 <= self.bits <= 32 or self.n * self.bits > 128:
            raise ValueError(f"{self.n} ids of {self.bits} bits")

    @property
    def high(self) -> int:
        return self.n * self.bits // 2

    @property
    def low(self) -> int:
        return self.n * self.bits - self.high

    def packed(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The halves of each n-gram; ids: n arrays, of the first words, the second words and so on."""
        high, low = np.zeros(len(ids[0]), np.uint64), np.zeros(len(ids[0]), np.uint64)
        b, over = np.uint64(self.bits), np.uint64(self.low - self.bits)
        for column in ids:
            high = ((high << b) | (low >> over)) & ones(self.high)
            low = ((low << b) & ones(self.low)) | column.astype(np.uint64)
        return high, low

    def unpacked(self, high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
        b, over, ids = np.uint64(self.bits), np.uint64(self.low - self.bits), []
        for _ in range(self.n):
            ids.append(low & ones(self.bits))
            low = (low >> b) | ((high & ones(self.bits)) << over)
            high = high >> b
        return ids[::-1]

    def _scattered(self, half: np.ndarray, k: int, bits: int) -> np.ndarray:
        return mix(half + np.uint64(_ROUNDS[k])) >> np.uint64(64 - bits)

    def permuted(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for k in range(0, len(_ROUNDS), 2):
            high = high ^ self._scattered(low, k, self.high)
            low = low ^ self._scattered(high, k + 1, self.low)
        return high, low

    def restored(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for k in range(len(_ROUNDS) - 2, -1, -2):
            low = low ^ self._scattered(high, k + 1, self.low)
            high = high ^ self._scattered(low, k, self.high)
        return high, low


def tallied(packing: Packing, high: np.ndarray, low: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers in ascending order, with the sums of their counts (default: one each).

    A stable sort merges parts that are in order already.
    """
    if not len(high):
        return high, low, np.zeros(0, np.uint64)
    if packing.high + packing.low <= 64:
        key = (high << np.uint64(packing.low)) | low
        if counts is None:
            key.sort()
            order = None
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        high, low = key[first] >> np.uint64(packing.low), key[first] & ones(packing.low)
    else:
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        first = np.flatnonzero(np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])))
        high, low = high[first], low[first]
    if counts is None:
        return high, low, np.diff(np.append(first, len(order) if order is not None else len(key))).astype(np.uint64)
    return high, low, np.add.reduceat(counts[order].astype(np.uint64), first)


def _narrow(values: np.ndarray, bits: int) -> bytes:
    width = (bits + 7) // 8
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _wide(data: bytes, offset: int, n: int, bits: int) -> tuple[np.ndarray, int]:
    width = (bits + 7) // 8
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, offset).reshape(n, width)
    return out.reshape(-1).view("<u8"), offset + n * width


class Filter:
    """The distinct permuted numbers of one shard in ascending order, and their counts."""

    HEADER = struct.Struct("<QB")

    def __init__(self, packing: Packing, shard_bits: int, shard: int, high: np.ndarray, low: np.ndarray, counts: np.ndarray):
        self.packing, self.shard_bits, self.shard = packing, shard_bits, shard
        self.high, self.low, self.counts = high, low, counts

    @property
    def _rest(self) -> int:
        """Bits of the high half without the shard's number."""
        return self.packing.high - self.shard_bits

    def packed(self) -> bytes:
        n = len(self.high)
        q = min(max(n - 1, 1).bit_length(), self._rest)
        inside = self.high & ones(self._rest)
        above = self._rest - q  # bits of the high half that are in the remainder
        quotient, upper = (inside >> np.uint64(above)).astype(np.int64), inside & ones(above)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        ends = np.append(quotient[1:] != quotient[:-1], True)[:n]
        many = self.counts > 1
        counters = self.counts[many]
        wide = counters >= WIDE
        parts = [self.HEADER.pack(n, q), *(np.packbits(x).tobytes() for x in (occupied, ends, many))]
        if above + self.packing.low <= 64:
            parts.append(_narrow((upper << np.uint64(self.packing.low)) | self.low if above else self.low, above + self.packing.low))
        else:
            parts += [_narrow(upper, above), _narrow(self.low, self.packing.low)]
        parts += [np.where(wide, WIDE, counters).astype(np.uint8).tobytes(), counters[wide].astype("<u8").tobytes()]
        return b"".join(parts)

    @classmethod
    def unpacked(cls, packing: Packing, shard_bits: int, shard: int, data: bytes) -> Filter:
        n, q = cls.HEADER.unpack_from(data)
        at, bits = cls.HEADER.size, []
        for size in (1 << q, n, n):
            bits.append(np.unpackbits(np.frombuffer(data, np.uint8, (size + 7) // 8, at), count=size).astype(bool))
            at += (size + 7) // 8
        occupied, ends, many = bits
        rest = packing.high - shard_bits
        above = rest - q
        if above + packing.low <= 64:
            remainder, at = _wide(data, at, n, above + packing.low)
            low = remainder & ones(packing.low)
            upper = remainder >> np.uint64(packing.low) if above else np.zeros(n, np.uint64)
        else:
            upper, at = _wide(data, at, n, above)
            low, at = _wide(data, at, n, packing.low)
        run = np.cumsum(np.append(False, ends[:-1])[:n])  # each slot's run; the runs' quotients are the occupied ones in order
        quotient = np.flatnonzero(occupied)[run].astype(np.uint64) if n else np.zeros(0, np.uint64)
        high = (np.uint64(shard) << np.uint64(rest)) | (quotient << np.uint64(above)) | upper
        counts = np.ones(n, np.uint64)
        counters = np.frombuffer(data, np.uint8, int(many.sum()), at).astype(np.uint64)
        wide = counters == WIDE
        counters[wide] = np.frombuffer(data, "<u8", int(wide.sum()), at + len(counters))
        counts[many] = counters
        return cls(packing, shard_bits, shard, high, low, counts)

    @classmethod
    def merged(cls, filters: list[Filter]) -> Filter:
        """One filter of all of a shard's, counts added."""
        one = filters[0]
        columns = (np.concatenate([getattr(f, name) for f in filters]) for name in ("high", "low", "counts"))
        return cls(one.packing, one.shard_bits, one.shard, *tallied(one.packing, *columns))

    def at_least(self, least: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The ids and the counts of the n-grams that are counted so often."""
        often = self.counts >= least
        return self.packing.unpacked(*self.packing.restored(self.high[often], self.low[often])), self.counts[often]


def filters(packing: Packing, shard_bits: int, ids: list[np.ndarray]) -> list[Filter]:
    """A filter for each shard that the n-grams fall in."""
    high, low, counts = tallied(packing, *packing.permuted(*packing.packed(ids)))
    shards = (high >> np.uint64(packing.high - shard_bits)).astype(np.int64)
    return [Filter(packing, shard_bits, shard, high[at], low[at], counts[at]) for shard, at in runs_of(shards)]
