"""Elias-Fano sequences over arrays that may be memory-mapped, queried for many positions or values at once."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


_BYTES, _TOPS = np.uint64(0x0101_0101_0101_0101), np.uint64(0x8080_8080_8080_8080)
#: Position of the k-th set bit of a byte, at 8 * byte + k.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.int64).ravel()


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th set bit (from 0) of each 64-bit word: its byte by running sums in the word's bytes, then a table."""
    two, four, half = np.uint64(0x5555_5555_5555_5555), np.uint64(0x3333_3333_3333_3333), np.uint64(0x0F0F_0F0F_0F0F_0F0F)
    s = word - ((word >> _ONE) & two)
    s = (s & four) + ((s >> np.uint64(2)) & four)
    s = ((s + (s >> np.uint64(4))) & half) * _BYTES
    k = k.astype(np.uint64)
    shift = np.bitwise_count(((k * _BYTES | _TOPS) - s) & _TOPS).astype(np.uint64) << np.uint64(3)
    k = k - ((s << np.uint64(8)) >> shift & np.uint64(255))
    return shift.astype(np.int64) + _IN_BYTE[(((word >> shift) & np.uint64(255)) << np.uint64(3) | k).astype(np.int64)]


def _or_into(target: np.ndarray, at: np.ndarray, bits: np.ndarray) -> None:
    """target[at] |= bits, for places in ascending order."""
    if at.size:
        start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        target[at[start]] |= np.bitwise_or.reduceat(bits, start)


class EliasFano:
    """A non-decreasing sequence of n numbers below `universe`: about 2 + log2(universe / n) bits each."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones = n, bits, low, high, ones

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        v = values.astype(np.uint64)
        n = v.size
        bits = min(63, max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1))
        buckets = (universe >> bits) + 1
        high = np.zeros(((n + buckets) >> 6) + 1, np.uint64)
        pos = (v >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)
        _or_into(high, (pos >> np.uint64(6)).astype(np.int64), _ONE << (pos & np.uint64(63)))
        low = np.zeros(((n * bits) >> 6) + 2, np.uint64)
        if bits:
            part = v & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            _or_into(low, word, part << shift)
            over = (shift + np.uint64(bits)) > np.uint64(64)  # at most one value of a word
            low[word[over] + 1] |= part[over] >> (np.uint64(64) - shift[over])
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64)))
        return cls(n, bits, low, high, ones)

    def to_bytes(self) -> bytes:
        """The sequence alone, without the counts of ones that lookups use."""
        return np.array([self.n, self.bits, self.low.size, self.high.size], np.int64).tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[EliasFano, int]:
        """The sequence that data begins with, for values(), and where it ends."""
        n, bits, low, high = np.frombuffer(data, np.int64, 4).tolist()
        words = np.frombuffer(data, np.uint64, low + high, 32)
        return cls(n, bits, words[:low], words[low:], np.empty(0, np.int64)), 32 + 8 * (low + high)

    def values(self) -> np.ndarray:
        """All values, as uint64."""
        i = np.arange(self.n)
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))
        return ((ones - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def parts(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.shape": np.array([self.n, self.bits], np.int64), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.ones": self.ones}

    @classmethod
    def of(cls, parts: dict[str, np.ndarray], name: str) -> EliasFano:
        n, bits = (int(x) for x in parts[f"{name}.shape"])
        return cls(n, bits, parts[f"{name}.low"], parts[f"{name}.high"], parts[f"{name}.ones"])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(i.size, np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        x = self.low[word] >> shift
        y = self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63))
        return (x | np.where(shift > 0, y, np.uint64(0))) & np.uint64((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at positions i."""
        word = np.searchsorted(self.ones, i, "right") - 1
        pos = word * 64 + _select_in_word(self.high[word], i - self.ones[word])
        return ((pos - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def _starts(self, bucket: np.ndarray) -> np.ndarray:
        """Number of values whose high part is below each bucket (bucket at most the last + 1)."""
        out, b = np.zeros(bucket.size, np.int64), np.flatnonzero(bucket > 0)
        k = bucket[b] - 1  # the zero that closes the bucket before
        if self._zeros is None:
            self._zeros = np.arange(self.ones.size, dtype=np.int64) * 64 - self.ones
        word = np.searchsorted(self._zeros, k, "right") - 1
        pos = word * 64 + _select_in_word(~self.high[word], k - self._zeros[word])
        out[b] = pos - k
        return out

    def _ends(self, lo: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Number of values whose high part is at most each bucket, of which lo have a smaller one."""
        pos = lo + bucket
        word, shift = pos >> 6, (pos & 63).astype(np.uint64)
        x = self.high[word] >> shift
        after = self.high[np.minimum(word + 1, self.high.size - 1)] << ((np.uint64(64) - shift) & np.uint64(63))
        x |= np.where((shift > 0) & (word + 1 < self.high.size), after, np.uint64(0))
        run = np.bitwise_count(x & ~(x + _ONE)).astype(np.int64)
        out, long_ = lo + run, np.flatnonzero(run == 64)
        out[long_] = self._starts(bucket[long_] + 1)
        return out

    _zeros = None

    def find(self, values: np.ndarray) -> np.ndarray:
        """Position of each value, -1 where it is absent: successor search inside the value's bucket."""
        out = np.full(values.size, -1, np.int64)
        if not self.n or not values.size:
            return out
        v = values.astype(np.uint64)
        bucket = (v >> np.uint64(self.bits)).astype(np.int64)
        live = np.flatnonzero(v <= self.access(np.array([self.n - 1]))[0])
        lo = self._starts(bucket[live])
        hi = self._ends(lo, bucket[live])
        want = v[live] & np.uint64((1 << self.bits) - 1)
        keep = lo < hi
        live, lo, hi, want = live[keep], lo[keep], hi[keep], want[keep]
        while live.size:
            mid = (lo + hi) >> 1
            got = self._low(mid)
            hit = got == want
            out[live[hit]] = mid[hit]
            lo, hi = np.where(got < want, mid + 1, lo), np.where(got < want, hi, mid)
            keep = ~hit & (lo < hi)
            live, lo, hi, want = live[keep], lo[keep], hi[keep], want[keep]
        return out
