"""Elias-Fano sequences over arrays that may be mapped from files; queries take whole arrays."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np

#: 64-bit words of the upper bits from one entry of the directory to the next.
SPAN = 2
_EACH, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
#: Place of the k-th one of a byte, at 8 * byte + k.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[k] for b in range(256) for k in range(8)], np.int64)


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """The lowest bits of each value, one value after another, in 64-bit words; a spare word at the end."""
    n = len(values)
    out = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
    if not bits or not n:
        return out
    at = np.arange(n, dtype=np.int64) * bits
    word, off = at >> 6, (at & 63).astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[first]] = np.bitwise_or.reduceat(values << off, first)
    over = np.flatnonzero(off.astype(np.int64) + bits > 64)  # one value a word goes on in the next
    out[word[over] + 1] |= values[over] >> (np.uint64(64) - off[over])
    return out


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """The parts of an ascending sequence below the universe: low bits, upper bits, directory of zeros.

    As many low bits as log2(universe / n), packed; upper bits hold, for each upper
    part in turn, a one a value and then a zero: two bits a value at most.
    """
    n = len(values)
    v = values.astype(np.uint64)
    bits = max(0, (universe // max(n, 1)).bit_length() - 1)
    high = (v >> np.uint64(bits)).astype(np.int64)
    size = n + (universe >> bits) + 1
    words = -(-size // 64)
    words += -words % SPAN
    mask = np.zeros(words * 64, np.uint8)
    mask[high + np.arange(n)] = 1
    upper = np.packbits(mask, bitorder="little").view("<u8")
    ones = np.bitwise_count(upper).reshape(-1, SPAN).sum(axis=1, dtype=np.int64)
    zeros = np.concatenate([[0], np.cumsum(64 * SPAN - ones)[:-1]]).astype(np.int64)
    return {"low": _pack(v & np.uint64((1 << bits) - 1), bits), "upper": upper, "zeros": zeros, "head": np.array([n, bits], np.int64)}


class EliasFano:
    """A sequence whose parts are got by name, as from mapped files."""

    def __init__(self, part: Mapping[str, np.ndarray]) -> None:
        self.n, self.bits = map(int, part["head"])
        self.low, self.upper, self.zeros = part["low"], part["upper"], part["zeros"]
        self.ones = np.arange(len(self.zeros), dtype=np.int64) * 64 * SPAN - self.zeros

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.int64)
        at = i * self.bits
        word, off = at >> 6, (at & 63).astype(np.uint64)
        # a shift by 64 is a shift by 63 and by 1
        v = (self.low[word] >> off) | ((self.low[word + 1] << (np.uint64(63) - off)) << np.uint64(1))
        return (v & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Position of the k-th (from 0) one or zero among the upper bits."""
        before = self.ones if one else self.zeros
        block = np.searchsorted(before, k, "right") - 1
        rest = (k - before[block]).astype(np.uint64)
        at = block * SPAN
        word = self.upper[at] if one else ~self.upper[at]
        for step in range(1, SPAN):  # on to the word of the block that it is in
            c = np.bitwise_count(word).astype(np.uint64)
            on = rest >= c
            if step > 1:
                on &= at == block * SPAN + step - 1
            at = at + on
            w = self.upper[at]
            word = np.where(on, w if one else ~w, word)
            rest = rest - c * on
        # sums of the bits of all bytes up to each, then the first byte where they exceed the rest
        sums = np.bitwise_count(word.view(np.uint8)).view(np.uint64) * _EACH
        shift = np.bitwise_count(((rest * _EACH) | _TOPS) - sums & _TOPS).astype(np.uint64) << np.uint64(3)
        rest = rest - (((sums << np.uint64(8)) >> shift) & np.uint64(255))
        byte = (word >> shift) & np.uint64(255)
        return at * 64 + shift.astype(np.int64) + _IN_BYTE[(byte << np.uint64(3) | rest).astype(np.int64)]

    def _next(self, at: np.ndarray, k: np.ndarray, one: bool) -> np.ndarray:
        """Position of the k-th one or zero, which is the first at or after `at`: in the same word, as a rule."""
        word = self.upper[at >> 6]
        word = (word if one else ~word) >> (at & 63).astype(np.uint64)
        out = at + np.bitwise_count(~word & (word - np.uint64(1)))
        if len(far := np.flatnonzero(word == 0)):
            out[far] = self._select(k[far], one)
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        i = i.astype(np.int64)
        return ((self._select(i, True) - i) << self.bits) | self._low(i)

    def both(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The i-th value and the one after it."""
        i = i.astype(np.int64)
        at = self._select(i, True)
        on = self._next(at + 1, i + 1, True)
        return ((at - i) << self.bits) | self._low(i), ((on - i - 1) << self.bits) | self._low(i + 1)

    def find(self, value: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where in [begin, end) each value is, or -1, no value being there twice: among those of the same upper part, the last whose low bits are no more."""
        value = value.astype(np.int64)
        out = np.full(len(value), -1, np.int64)
        there = value >> self.bits < len(self.upper) * 64 - self.n  # upper parts are as many as zeros
        if not there.all():
            live = np.flatnonzero(there)
            out[live] = self.find(value[live], begin[live], end[live]) if len(live) else out[live]
            return out
        high = value >> self.bits
        bit = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) + 1, 0)  # where the ones of this upper part begin
        stop = self._next(bit, high, False)
        lo, hi = np.maximum(bit - high, begin), np.minimum(stop - high, end)
        live = np.flatnonzero(lo < hi)  # the others' upper part has no values there
        lo, hi, want = lo[live], hi[live], value[live] & ((1 << self.bits) - 1)
        open_ = np.flatnonzero(hi - lo > 1)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) <= want[open_]
            lo[open_], hi[open_] = np.where(less, mid, lo[open_]), np.where(less, hi[open_], mid)
            open_ = open_[hi[open_] - lo[open_] > 1]
        hit = self._low(lo) == want
        out[live[hit]] = lo[hit]
        return out


def grouped(values: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Values that ascend within each group [starts[g], starts[g + 1]), as one ascending sequence: each group goes on after the last of the one before."""
    size = np.diff(starts)
    some = np.flatnonzero(size)
    tops = values[starts[some + 1] - 1].astype(np.int64) + 1
    base = np.repeat(np.cumsum(tops) - tops, size[some])
    return encode(values + base, int(tops.sum()) + 1)


class Grouped(EliasFano):
    """The sequence of grouped(); a value of a group is found relative to where the group before ends."""

    def base(self, begin: np.ndarray) -> np.ndarray:
        """What stands before the groups that begin there."""
        later = begin > 0
        out = np.zeros(len(begin), np.int64)
        out[later] = self.get(begin[later] - 1) + 1
        return out

    def at(self, value: np.ndarray, begin: np.ndarray, end: np.ndarray, base: np.ndarray) -> np.ndarray:
        """The place of each value in its group [begin, end), or -1; a value beyond the group's last is at none of its places."""
        out = np.full(len(value), -1, np.int64)
        live = np.flatnonzero((value >= 0) & (begin < end))
        if len(live):
            out[live] = self.find(value[live] + base[live], begin[live], end[live])
        return out
