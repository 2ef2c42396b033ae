"""A compressed FM-index over symbol sequences: bit-packed wavelet matrix, backward
search, matching statistics and locating by sampled suffix positions.

The text of a shard is a row of segments, each closed by a separator. All
queries are vectorised: many patterns take one backward step together.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Ranks over a symbol sequence; one bit a symbol and level, with a count each 64 bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            bit = (symbols >> b) & 1
            packed = np.zeros((len(symbols) // 64 + 1) * 8, np.uint8)
            bytes_ = np.packbits(bit.astype(bool), bitorder="little")
            packed[: len(bytes_)] = bytes_
            words = packed.view(np.uint64)
            before = np.zeros(len(words), np.int32)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:], dtype=np.int32)
            zeros = int(len(symbols) - bit.sum())
            self.levels.append((b, words, before, zeros))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def moved(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the first `at` places of each symbol end in the last level's order."""
        for b, words, before, zeros in self.levels:
            block = at >> 6
            ones = before[block] + np.bitwise_count(words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> b) & 1, zeros + ones, at - ones)
        return at

    def symbol(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and that place in the last level's order."""
        found = np.zeros(len(at), np.int64)
        for b, words, before, zeros in self.levels:
            block, low = at >> 6, (at & 63).astype(np.uint64)
            bit = ((words[block] >> low) & np.uint64(1)).astype(np.int64)
            ones = before[block] + np.bitwise_count(words[block] & ((np.uint64(1) << low) - np.uint64(1)))
            at = np.where(bit, zeros + ones, at - ones)
            found |= bit << b
        return found, at


class FMIndex:
    """symbols: 1 and up, with 0 after each segment. depth: the longest segment.

    Separators sort by their place, so every suffix order ends inside its
    segment and no match crosses segments. sigma: one above the largest symbol
    that a pattern may have. Samples are kept every `every`
    places of a segment, its first place included.
    """

    def __init__(self, symbols: np.ndarray, depth: int, every: int = 0, common: bool = False, sigma: int = 0):
        symbols = np.asarray(symbols, np.int64)
        self.n = n = len(symbols)
        closes = symbols == 0
        n_seg = int(closes.sum())
        rank = symbols + n_seg
        rank[closes] = np.arange(n_seg)
        names, span = [(1, rank)], 1
        width = int(rank.max() + 1).bit_length()
        while True:
            # As many ranks as fit go into the first key, so fewer sorts are needed.
            packed = 4 if span == 1 and 4 * width <= 63 else 2
            room = width if packed == 4 else 31
            key = rank + 1
            for k in range(1, packed):
                ahead = np.zeros(n, np.int64)
                if k * span < n:
                    ahead[: n - k * span] = rank[k * span :] + 1
                key = (key << room) | ahead
            order = np.argsort(key)
            key = key[order]
            fresh = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            span *= packed
            if span > depth or fresh[-1] == n - 1:
                break
            names.append((span, rank))
        self.order = order
        last = symbols[order - 1]
        sigma = max(sigma, int(symbols.max()) + 1)
        self.wavelet = WaveletMatrix(last, max(1, (sigma - 1).bit_length()))
        before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))[:-1]])
        self.shift = before - self.wavelet.moved(np.arange(sigma), np.zeros(sigma, np.int64))
        self.symbols = symbols
        if common:
            self._common(names, span)
        if every:
            heads = np.concatenate([[0], np.flatnonzero(closes)[:-1] + 1])
            within = np.arange(n) - np.repeat(heads, np.diff(np.append(heads, n)))
            kept = (within % every == 0)[order]
            self.kept = kept
            self.samples = order[kept]
            self.kept_before = np.concatenate([[0], np.cumsum(kept)])

    def _common(self, names: list[tuple[int, np.ndarray]], span: int) -> None:
        """Common prefix lengths of neighbours, and the nearest smaller ones to each side."""
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        lcp = np.zeros(self.n + 1, np.int64)
        for (span, rank), above in zip(names[::-1], [span, *(x for x, _ in names[:0:-1])]):
            name = np.concatenate([rank, [-1]])
            for _ in range(above // span - 1):
                step = (name[a] == name[b]) * span
                a += step
                b += step
                lcp[1:-1] += step
        lcp[0] = lcp[-1] = -1
        self.lcp = lcp
        self.smaller = []
        for side in (-1, 1):
            near = np.arange(self.n + 1) + side
            near[0 if side < 0 else -1] = 0 if side < 0 else self.n
            open_ = np.arange(1, self.n)
            while len(open_):
                open_ = open_[lcp[near[open_]] >= lcp[open_]]
                near[open_] = near[near[open_]]
            self.smaller.append(near)

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.wavelet.moved(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) + np.concatenate([self.shift[symbol]] * 2)
        return both[: len(lo)], both[len(lo) :]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of patterns, given as rows of symbols filled from the left."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        for k in range(int(lengths.max()) if len(lengths) else 0):
            on = np.flatnonzero((lengths > k) & (hi > lo))
            if not len(on):
                break
            lo[on], hi[on] = self.step(patterns[on, lengths[on] - 1 - k], lo[on], hi[on])
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks: walk left to the nearest sample."""
        found, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        on, at = np.arange(len(rows)), rows.copy()
        while len(on):
            kept = self.kept[at]
            found[on[kept]] = self.samples[self.kept_before[at[kept]]] + steps[on[kept]]
            on, at = on[~kept], at[~kept]
            symbol, moved = self.wavelet.symbol(at)
            at = moved + self.shift[symbol]
            steps[on] += 1
        return found

    def matching_statistics(self, starts: np.ndarray, stops: np.ndarray, least: int = 2) -> np.ndarray:
        """For each place of the given segments, the longest match from it with `least` occurrences.

        A backward search runs over each segment from its end; where a symbol
        can't be put before the match, the match gives up symbols at its end
        by going to the parent interval.
        """
        found = np.zeros(self.n, np.int32)
        at, low, begin = stops.astype(np.int64), np.zeros(len(stops), np.int64), starts
        high, length = np.full(len(stops), self.n), np.zeros(len(stops), np.int64)
        smaller_left, smaller_right = self.smaller
        while len(at):
            lo, hi = self.step(self.symbols[at - 1], low, high)
            good = hi - lo >= least
            drop = ~good & (length == 0)
            shrink = ~good & ~drop
            low, high = np.where(good, lo, low), np.where(good, hi, high)
            length += good
            at -= good | drop
            found[at[good]] = length[good]
            if shrink.any():
                k = np.where(self.lcp[low[shrink]] >= self.lcp[high[shrink]], low[shrink], high[shrink])
                depth = self.lcp[k]
                root = depth <= 0
                low[shrink] = np.where(root, 0, smaller_left[k])
                high[shrink] = np.where(root, self.n, smaller_right[k])
                length[shrink] = np.where(root, 0, depth)
            more = at > begin
            at, low, high, length, begin = at[more], low[more], high[more], length[more], begin[more]
        return found
