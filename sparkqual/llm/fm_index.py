"""A compressed full-text index: backward search in a wavelet matrix, many patterns at a time."""

from __future__ import annotations

import numpy as np

_ONE, _ALL = np.uint64(1), np.uint64(63)


class Bits:
    """A bit vector, packed, with the number of ones before every word."""

    def __init__(self, bits: np.ndarray):
        words = -(-(len(bits) + 1) // 64)
        packed = np.zeros(words * 8, np.uint8)
        some = np.packbits(bits, bitorder="little")
        packed[: len(some)] = some
        self.words = packed.view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(ones, dtype=np.int32) - ones
        self.zeros = len(bits) - int(ones.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        inside = self.words[word] & ((_ONE << (at.astype(np.uint64) & _ALL)) - _ONE)
        return self.before[word] + np.bitwise_count(inside)


class WaveletMatrix:
    """Numbers below 2**levels; how often one occurs before a place."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels = []
        for level in range(levels - 1, -1, -1):
            bits = (values >> level) & 1 == 1
            self.levels.append((level, Bits(bits)))
            values = np.concatenate([values[~bits], values[bits]])

    def rank(self, value: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each value before `low` and before `high`."""
        first = np.zeros(len(value), np.int64)
        for level, bits in self.levels:
            one = (value >> level) & 1 == 1
            place = np.stack([first, low, high])
            ones = bits.ones(place.ravel()).reshape(3, -1)
            first, low, high = np.where(one, bits.zeros + ones, place - ones)
        return low - first, high - first


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of suffixes in order of their first `depth` symbols, by doubling the symbols compared."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank, have = rank.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while have < depth:
        after = np.zeros(n, np.int64)
        after[: max(0, n - have)] = rank[have:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        have *= 2
        if rank[order[-1]] == n - 1:
            break
    return order


class FMIndex:
    """Index of segments of symbols (numbers from 1 on), each with the number of its copies.

    Suffixes are ordered by their first `depth` symbols, which is exact for patterns up to that length.
    Symbols with a single occurrence and copy match nothing twice and share the number `unique`.
    """

    def __init__(self, segments: list[np.ndarray], copies: np.ndarray, depth: int):
        sizes = np.array([len(s) for s in segments], np.int64)
        # A 0 ends each segment; no pattern holds it.
        self.begin = np.cumsum(sizes + 1) - sizes - 1
        text = np.zeros(int((sizes + 1).sum()), np.int64)
        inside = np.ones(len(text), bool)
        inside[self.begin + sizes] = False
        text[inside] = np.concatenate(segments) if segments else []
        weight = np.repeat(copies, sizes + 1)
        total = np.bincount(text, weights=weight)
        # Numbers by use: 0 the end, 1 what occurs once, then the others.
        number = np.where(total > 1, np.cumsum(total > 1) + 1, 1)
        number[0] = 0
        self.unique, self.text = 1, number[text]
        order = suffix_order(self.text, depth)
        symbols = int(self.text.max(initial=0)) + 1
        self.first = np.cumsum(np.bincount(self.text, minlength=symbols)) - np.bincount(self.text, minlength=symbols)
        self.tree = WaveletMatrix(self.text[order - 1], max(1, (symbols - 1).bit_length()))
        self.copies = np.concatenate([[0], np.cumsum(weight[order])])

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of patterns after one more symbol in front."""
        a, b = self.tree.rank(symbol, low, high)
        return self.first[symbol] + a, self.first[symbol] + b


# What a lane does: match all that is left of its segment, or only the window that starts first.
_REST, _FIRST = 0, 1
# A match of fewer symbols is cheap: the next one ends a symbol earlier.
_SHORT = 8


def repeated_windows(index: FMIndex, sizes: np.ndarray, width: int) -> np.ndarray:
    """For each segment a mask (uint64, bit i: window i) of the windows of `width` symbols that occur at least twice.

    All segments are streamed through the index at once. A match runs backwards from its end while
    the interval holds two occurrences. One that gets to `width` symbols or more marks all windows in
    it; where it ends, the string that occurs once excludes all windows that hold it.
    """
    count = sizes - width + 1
    mask = np.zeros(len(sizes), np.uint64)
    lane = np.flatnonzero(count > 0)
    begin = index.begin[lane]
    # Windows that are open have starts from `low` to `high` - 1, in their segment.
    low, high = np.zeros(len(lane), np.int64), count[lane].copy()
    mode = np.full(len(lane), _REST)
    last = high + width - 2
    at, a, b = last.copy(), np.zeros(len(lane), np.int64), np.full(len(lane), len(index.text))

    def bits(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        stop = np.maximum(start, stop).astype(np.uint64)
        return ((_ONE << stop) - _ONE) & ~((_ONE << start.astype(np.uint64)) - _ONE)

    while len(lane):
        symbol = index.text[begin + at]
        a, b = index.extend(symbol, a, b)
        ended = (symbol == index.unique) | (index.copies[b] - index.copies[a] < 2)
        # `at` is the first symbol that is not part of the match.
        at = np.where(ended, at, at - 1)
        ended |= at < low
        if not ended.any():
            continue
        e = np.flatnonzero(ended)
        stop, start, full = last[e], at[e] + 1, at[e] < low[e]
        length = stop - start + 1
        long = length >= width
        mask[lane[e]] |= np.where(long, bits(start, stop - width + 2), np.uint64(0))
        # A whole match settles its windows; otherwise those that hold the symbol before it and its end are out.
        rest = mode[e] == _REST
        out = np.where(long, start, stop - width + 1)
        high[e] = np.where(rest, np.where(full, low[e], out), high[e])
        low[e] = np.where(rest, low[e], np.where(full, low[e] + 1, start))
        mode[e] = np.where(rest & (length >= _SHORT), _FIRST, _REST)
        last[e] = np.where(mode[e] == _REST, high[e], low[e] + 1) + width - 2
        at[e], a[e], b[e] = last[e], 0, len(index.text)
        open_ = low < high
        if not open_.all():
            lane, begin, low, high, mode, last, at, a, b = (x[open_] for x in (lane, begin, low, high, mode, last, at, a, b))
    return mask
