"""Counting quotient filters without loss: keys are permuted invertibly, so quotient and full remainder give them back.

A key is three word ids of `bits` bits each (0 stands for no word), packed and seen as two halves of `half` bits. A
Feistel network permutes it, which spreads keys evenly over quotients. The top `segment_bits` of a permuted key name
its segment; a stored filter holds the keys of one segment in order: a bit vector that gives each key's quotient
(the bit at quotient + position is set), the remainders in whole bytes, and counters of one byte with an
overflow list. Filters of one segment from any number of shards merge by key order.
"""

from __future__ import annotations

import struct

import numpy as np

HEADER = struct.Struct("<QBBBB")
#: Fixed odd multipliers of the network's rounds.
ROUNDS = tuple(np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & (2**64 - 1) | 1) for k in range(4))


def _low(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


class Grams:
    """Word-id n-grams of up to three words as permuted keys (two arrays of halves)."""

    def __init__(self, bits: int):
        if not 1 <= bits <= 42:
            raise ValueError("word ids have 1 to 42 bits")
        self.bits = bits
        self.half = -(-3 * bits // 2)

    def pack(self, first: np.ndarray, second: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b, h = self.bits, self.half
        first, second, third = (x.astype(np.uint64) for x in (first, second, third))
        high = first << np.uint64(2 * b - h) | second >> np.uint64(h - b)
        low = (second & _low(h - b)) << np.uint64(b) | third
        return self._permuted(high, low)

    def unpack(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b, h = self.bits, self.half
        high, low = self._restored(high, low)
        first = high >> np.uint64(2 * b - h)
        second = (high & _low(2 * b - h)) << np.uint64(h - b) | low >> np.uint64(b)
        return first, second, low & _low(b)

    def _mixed(self, x: np.ndarray, k: np.uint64) -> np.ndarray:
        x = (x + k) * k
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ x >> np.uint64(32)) & _low(self.half)

    def _permuted(self, high, low):
        for k in ROUNDS:
            high, low = low, high ^ self._mixed(low, k)
        return high, low

    def _restored(self, high, low):
        for k in reversed(ROUNDS):
            high, low = low ^ self._mixed(high, k), high
        return high, low

    def counted(self, high: np.ndarray, low: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order, with the sum of their counts (1 each where none are given)."""
        h = np.uint64(self.half)
        if not len(high):
            return high, low, np.zeros(0, np.int64)
        if self.half <= 32:
            key = high << h | low
            if counts is None:
                key.sort()
            else:
                order = np.argsort(key, kind="stable")
                key, counts = key[order], counts[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            total = key
            high, low = key[starts] >> h, key[starts] & _low(self.half)
        else:
            order = np.lexsort((low, high))
            total, low = high[order], low[order]
            counts = None if counts is None else counts[order]
            starts = np.flatnonzero(np.r_[True, (total[1:] != total[:-1]) | (low[1:] != low[:-1])])
            high, low = total[starts], low[starts]
        return high, low, np.diff(np.r_[starts, len(total)]) if counts is None else np.add.reduceat(counts, starts)


def _bytes_of(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _values_of(data: np.ndarray, width: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = data[: n * width].reshape(n, width)
    return out.view("<u8").ravel().astype(np.uint64)


def stored(grams: Grams, segment_bits: int, high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> bytes:
    """The filter of one segment's distinct keys, given in order."""
    n, rest = len(high), grams.half - segment_bits
    quotient_bits = min(rest, max(0, n.bit_length() - 1))
    inside = high & _low(rest)
    quotients = (inside >> np.uint64(rest - quotient_bits)).astype(np.int64)
    marks = np.zeros(n + (1 << quotient_bits), bool)
    marks[quotients + np.arange(n)] = True
    wide, narrow = -(-(rest - quotient_bits) // 8), -(-grams.half // 8)
    small = np.minimum(counts, 255).astype(np.uint8)
    parts = [
        HEADER.pack(n, quotient_bits, wide, narrow, 0),
        np.packbits(marks).tobytes(),
        _bytes_of(inside & _low(rest - quotient_bits), wide),
        _bytes_of(low, narrow),
        small.tobytes(),
        counts[small == 255].astype("<i8").tobytes(),
    ]
    return b"".join(parts)


def loaded(grams: Grams, segment_bits: int, segment: int, blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys in order and their counts of a stored filter."""
    n, quotient_bits, wide, narrow, _ = HEADER.unpack_from(blob)
    rest = grams.half - segment_bits
    data = np.frombuffer(blob, np.uint8, offset=HEADER.size)
    size = -(-(n + (1 << quotient_bits)) // 8)
    quotients = np.flatnonzero(np.unpackbits(data[:size])) - np.arange(n)
    data = data[size:]
    remainder = _values_of(data, wide, n)
    low = _values_of(data[n * wide :], narrow, n)
    data = data[n * (wide + narrow) :]
    counts = data[:n].astype(np.int64)
    counts[counts == 255] = np.frombuffer(data[n:].tobytes(), "<i8")
    top = np.uint64(segment) << np.uint64(rest) if segment_bits else np.uint64(0)
    return top | quotients.astype(np.uint64) << np.uint64(rest - quotient_bits) | remainder, low, counts


def segments(grams: Grams, segment_bits: int, high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> list[tuple[int, bytes]]:
    """(segment, stored filter) of each segment that distinct keys, given in order, fall in."""
    if not len(high):
        return []
    own = (high >> np.uint64(grams.half - segment_bits)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    ends = np.r_[starts[1:], len(own)]
    return [(int(own[a]), stored(grams, segment_bits, high[a:b], low[a:b], counts[a:b])) for a, b in zip(starts, ends)]
