"""A compressed full-text index of one shard: Burrows-Wheeler transform in a wavelet tree, searched backwards.

Used inside tasks by ``substring_dedup``; many patterns advance together, so all steps are array operations.
"""

from __future__ import annotations

import numpy as np

DEPTH = 64  # suffixes are sorted by so many tokens; patterns must stay shorter


class BitRank:
    """Bits with constant-time rank: 64-bit words and a count before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(np.pad(bits, (0, 64 - len(bits) % 64)), bitorder="little").view(np.uint64)
        self.words = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletTree:
    """Level-wise wavelet tree (zeros first on every level)."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            self.levels.append(BitRank(bit))
            values = np.concatenate([values[~bit], values[bit]])

    def walk(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` ends up on the last level in the part of ``value``."""
        for k, level in enumerate(self.levels):
            ones = level.ones(at)
            at = np.where(value >> (self.bits - 1 - k) & 1, level.zeros + ones, at - ones)
        return at


class FMIndex:
    def __init__(self, tokens: np.ndarray, weight: np.ndarray, longest: int):
        """``tokens``: ints from 0; 0 separates the texts. ``weight``: occurrences that each position stands for."""
        n = len(tokens)
        self.n, self.longest = n, longest
        ranks = [np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1]
        h = 1
        while h < DEPTH:
            r = ranks[-1]
            later = np.zeros(n, np.int64)
            later[: n - h] = r[h:]
            key = r * (n + 2) + later
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            ordered = key[order]
            new[order] = np.concatenate([[1], 1 + np.cumsum(ordered[1:] != ordered[:-1])])
            ranks.append(new)
            h *= 2
        sa = np.argsort(ranks[-1], kind="stable")
        self.weight = np.concatenate([[0], np.cumsum(weight[sa])])
        common = np.zeros(max(n - 1, 0), np.int64)
        a, b = sa[:-1].copy(), sa[1:].copy()
        for level in range(len(ranks) - 1, -1, -1):
            inside = (a < n) & (b < n)
            same = np.zeros(len(a), bool)
            same[inside] = ranks[level][a[inside]] == ranks[level][b[inside]]
            common[same] += 1 << level
            a[same] += 1 << level
            b[same] += 1 << level
        self.lcp = np.concatenate([[-1], np.minimum(common, longest), [-1]])
        self.smaller_before, self.smaller_after = self._smaller()
        bits = max(1, int(tokens.max()).bit_length())
        self.tree = WaveletTree(tokens[sa - 1], bits)
        symbols = np.arange(int(tokens.max()) + 1)
        starts = np.concatenate([[0], np.cumsum(np.bincount(tokens, minlength=len(symbols)))])[:-1]
        self.base = starts - self.tree.walk(symbols, np.zeros(len(symbols), np.int64))

    def _smaller(self) -> tuple[np.ndarray, np.ndarray]:
        """Nearest places before and after with a smaller common prefix."""
        at, lcp = np.arange(len(self.lcp)), self.lcp
        before, after = np.zeros(len(lcp), np.int64), np.full(len(lcp), len(lcp) - 1)
        for v in np.unique(lcp[lcp >= 0]):
            here = np.flatnonzero(lcp == v)
            low = at[lcp < v]
            k = np.searchsorted(low, here)
            before[here], after[here] = low[k - 1], low[k]
        return before, after

    def _parent(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        left, right = self.lcp[lo], self.lcp[hi]
        depth = np.maximum(left, right)
        return np.where(left == depth, self.smaller_before[lo], lo), np.where(right == depth, self.smaller_after[hi], hi), np.maximum(depth, 0)

    def matching_statistics(self, tokens: np.ndarray, first: np.ndarray, size: np.ndarray, least: int = 2) -> np.ndarray:
        """For each token of the patterns: length, at most ``longest``, of the longest match from it on with ``least`` occurrences.

        Pattern p is ``tokens[first[p] : first[p] + size[p]]``; all are read from their ends, each step extending the
        match to the left or, where that has too few occurrences, shortening it at its right end to the parent interval.
        """
        out = np.zeros(len(tokens), np.int64)
        lo, hi, depth = np.zeros(len(first), np.int64), np.full(len(first), self.n), np.zeros(len(first), np.int64)
        for step in range(int(size.max()) if len(size) else 0):
            todo = np.flatnonzero(size > step)
            active, at = todo, first[todo] + size[todo] - 1 - step
            symbol = np.zeros(len(first), np.int64)
            symbol[todo] = tokens[at]
            while len(todo):
                c = symbol[todo]
                ends = self.tree.walk(np.concatenate([c, c]), np.concatenate([lo[todo], hi[todo]]))
                new_lo, new_hi = self.base[c] + ends[: len(c)], self.base[c] + ends[len(c) :]
                ok = self.weight[new_hi] - self.weight[new_lo] >= least
                go = todo[ok]
                lo[go], hi[go] = new_lo[ok], new_hi[ok]
                depth[go] += 1
                todo = todo[~ok & (depth[todo] > 0)]
                lo[todo], hi[todo], depth[todo] = self._parent(lo[todo], hi[todo])
            long = active[depth[active] > self.longest]
            if len(long):
                a, b, _ = self._parent(lo[long], hi[long])
                wide = np.maximum(self.lcp[lo[long]], self.lcp[hi[long]]) >= self.longest
                lo[long], hi[long] = np.where(wide, a, lo[long]), np.where(wide, b, hi[long])
                depth[long] = self.longest
            out[at] = depth[active]
        return out
