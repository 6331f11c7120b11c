"""FM-index of a sequence of numbers: suffix order, wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np

#: Every such position is sampled, and every one just after an end mark.
SAMPLE = 16


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by prefix doubling on the groups still tied.

    Every 0 is an end mark, smaller than all else; an earlier mark is smaller than a later one.
    """
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    key = symbols.astype(np.int64) + len(ends)
    key[ends] = np.arange(len(ends))
    # Three symbols at once, as long as they can be packed into one number.
    base = int(key.max()) + 2 if n else 2
    width = 3 if base < 1 << 20 else 1
    packed = key + 1
    for ahead in range(1, width):
        after = np.zeros(n, np.int64)
        after[: n - ahead] = key[ahead:] + 1
        packed = packed * base + after
    order = np.argsort(packed, kind="stable")
    rank = np.empty(n, np.int64)
    place = np.arange(n)
    keys = packed[order]
    while len(place):
        new = np.r_[True, keys[1:] != keys[:-1]]
        heads = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        rank[order[place]] = place[heads][group]
        tied = (np.diff(np.r_[heads, len(place)]) > 1)[group]
        place = place[tied]
        at = order[place]
        after = np.minimum(at + width, n)
        keys = rank[at] * (n + 2) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        again = np.argsort(keys, kind="stable")
        order[place], keys = at[again], keys[again]
        width *= 2
    return order


class Bits:
    """Bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        size = -(-(len(bits) + 1) // 64) * 8
        packed = np.zeros(size, np.uint8)
        some = np.packbits(bits, bitorder="little")
        packed[: len(some)] = some
        self.words = packed.view("<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Ranks of symbols in a sequence, one level of bits for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):
            bits = (symbols >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(bits), int((~bits).sum())))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low, high = np.zeros_like(at), at
        for shift, bits, zeros in self.levels:
            one = (symbol >> shift & 1).astype(bool)
            left, right = bits.ones(low), bits.ones(high)
            low = np.where(one, zeros + left, low - left)
            high = np.where(one, zeros + right, high - right)
        return high - low

    def get(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for shift, bits, zeros in self.levels:
            one = bits.get(at).astype(bool)
            ones = bits.ones(at)
            at = np.where(one, zeros + ones, at - ones)
            symbol |= one.astype(np.int64) << shift
        return symbol


class FmIndex:
    """Index of ``symbols``, in which 0 marks the end of each part; the last one must be 0."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = SAMPLE):
        order = suffix_order(symbols)
        last = symbols[order - 1]
        self.tree = WaveletMatrix(last, sigma)
        self.first = np.r_[0, np.cumsum(np.bincount(symbols, minlength=sigma))][:-1]
        self.size = len(symbols)
        # The walk back never has to pass an end mark: what follows one is sampled.
        kept = (order % sample == 0) | (last == 0)
        self.marked = Bits(kept)
        self.at = order[kept]

    def search(self, phrases: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(low, high) rows of the suffixes that begin with each phrase, empty if low >= high."""
        sizes = np.array([len(p) for p in phrases])
        longest = int(sizes.max())
        table = np.zeros((len(phrases), longest), np.int64)
        for row, phrase in enumerate(phrases):
            table[row, longest - len(phrase) :] = phrase
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size)
        for back in range(1, longest + 1):
            live = np.flatnonzero((sizes >= back) & (low < high))
            if not len(live):
                break
            symbol = table[live, longest - back]
            low[live] = self.first[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.tree.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes in the sequence, by walking back to sampled ones."""
        place = np.empty(len(rows), np.int64)
        todo, now, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            known = self.marked.get(now).astype(bool)
            place[todo[known]] = self.at[self.marked.ones(now[known])] + steps
            todo, now = todo[~known], now[~known]
            symbol = self.tree.get(now)
            now = self.first[symbol] + self.tree.rank(symbol, now)
            steps += 1
        return place
