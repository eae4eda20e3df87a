"""A compressed FM-index over word numbers: wavelet matrix with packed bits, backward search in many lanes.

What stays of the text is its Burrows-Wheeler transform in the wavelet matrix, the counts of smaller symbols, and one
bit a suffix for where the first ``depth - 1`` symbols change. The suffix order itself is dropped once it is built.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class PackedBits:
    """Bits in 64-bit words with the ones before each word: rank in one lookup and one popcount."""

    def __init__(self, bits: np.ndarray):
        n = -(-(len(bits) + 1) // 64)
        packed = np.zeros(n * 8, dtype=np.uint8)
        some = np.packbits(bits, bitorder="little")
        packed[: len(some)] = some
        self.words = packed.view("<u8")
        self.before = np.zeros(n, dtype=np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:], dtype=np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        k = i >> 6
        low = (_ONE << (i & 63).astype(np.uint64)) - _ONE
        return self.before[k] + np.bitwise_count(self.words[k] & low)

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.before.nbytes


class Bounds(PackedBits):
    """Bits of which the nearest ones are asked for; the first and the last are set."""

    def __init__(self, bits: np.ndarray):
        super().__init__(bits)
        full = np.where(self.words != 0, np.arange(len(self.words), dtype=np.int32), -1)
        self.last = np.maximum.accumulate(full)
        full[full < 0] = len(full)
        self.next = np.minimum.accumulate(full[::-1])[::-1]

    def at_or_before(self, i: np.ndarray) -> np.ndarray:
        k = i >> 6
        upto = (np.uint64(2) << (i & 63).astype(np.uint64)) - _ONE  # wraps to all ones for the last bit
        m = self.words[k] & upto
        none = m == 0
        k = np.where(none, self.last[k - 1], k)
        m = np.where(none, self.words[k], m)
        for s in (1, 2, 4, 8, 16, 32):
            m |= m >> np.uint64(s)
        return k * 64 + np.bitwise_count(m).astype(np.int64) - 1

    def at_or_after(self, i: np.ndarray) -> np.ndarray:
        k = i >> 6
        m = self.words[k] & ~((_ONE << (i & 63).astype(np.uint64)) - _ONE)
        none = m == 0
        k = np.where(none, self.next[np.minimum(k + 1, len(self.next) - 1)], k)
        m = np.where(none, self.words[k], m)
        return k * 64 + np.bitwise_count((m & -m) - _ONE).astype(np.int64)

    @property
    def nbytes(self) -> int:
        return super().nbytes + self.last.nbytes + self.next.nbytes


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, size: int):
        self.levels: list[tuple[int, PackedBits, int]] = []
        s = symbols
        for b in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            bits = (s >> b) & 1
            zeros = int(len(s) - bits.sum())
            self.levels.append((b, PackedBits(bits.astype(bool)), zeros))
            s = np.concatenate((s[bits == 0], s[bits == 1]))
        alphabet = np.arange(size)
        self.origin = self._down(alphabet, np.zeros(size, dtype=np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((symbol >> b) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each lane's symbol among the first i."""
        return self._down(symbol, i) - self.origin[symbol]

    @property
    def nbytes(self) -> int:
        return self.origin.nbytes + sum(bits.nbytes for _, bits, _ in self.levels)


class FMIndex:
    """Of a text of numbers (0 separates its pieces), with suffixes ordered by their first ``depth`` symbols."""

    def __init__(self, text: np.ndarray, size: int, depth: int):
        n = len(text)
        half = 1
        while 2 * half < depth:
            half *= 2
        rank = text.astype(np.int64)
        step = 1
        while step < half:
            rank = self._pairs(rank, step)
            step *= 2
        order = np.lexsort((self._shift(rank, depth - half), rank))
        a = rank[order]
        c = self._shift(rank, depth - 1 - half)[order] if depth - 1 >= half else a * 0
        wide = np.ones(n + 1, dtype=bool)
        wide[1:-1] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        self.n, self.depth = n, depth
        self.shorter = Bounds(wide)
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size))))
        self.bwt = WaveletMatrix(text[order - 1], size)

    @staticmethod
    def _shift(rank: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate((rank[by:], np.zeros(by, dtype=rank.dtype))) if by else rank

    @classmethod
    def _pairs(cls, rank: np.ndarray, step: int) -> np.ndarray:
        second = cls._shift(rank, step)
        return np.unique(rank * (int(second.max()) + 1) + second, return_inverse=True)[1] + 1

    def back(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """One step of backward search for a bound of each lane's interval."""
        return self.less[symbol] + self.bwt.rank(symbol, i)

    def shrink(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of matches of ``depth`` symbols, with their last symbol dropped."""
        return self.shorter.at_or_before(lo), self.shorter.at_or_after(hi)

    @property
    def nbytes(self) -> int:
        return self.shorter.nbytes + self.less.nbytes + self.bwt.nbytes


def matching_statistics(index: FMIndex, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Streams pieces of the text, each from its end, through the index. For each place of the text at which
    ``index.depth`` symbols of its piece begin, the first of the interval of suffixes that match them, and its width; else -1, 0.

    The pieces are in the index, so their matches reach as far as they do; one of ``depth`` symbols drops its last
    before the next step, as statistics above the threshold need no more.
    """
    first, width = np.full(len(text), -1, dtype=np.int64), np.zeros(len(text), dtype=np.int64)
    lane = np.argsort(-lengths, kind="stable")
    ends, sizes = (starts + lengths)[lane], lengths[lane]
    lo = np.zeros(len(lane), dtype=np.int64)
    hi = np.full(len(lane), index.n, dtype=np.int64)
    for t in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -t, side="left"))
        at = ends[:live] - 1 - t
        symbol = text[at]
        lo[:live] = index.back(symbol, lo[:live])
        hi[:live] = index.back(symbol, hi[:live])
        if t + 1 >= index.depth:
            first[at], width[at] = lo[:live], hi[:live] - lo[:live]
            lo[:live], hi[:live] = index.shrink(lo[:live], hi[:live])
    return first, width
