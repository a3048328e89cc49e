"""A compressed full-text index over sequences of numbers, searched backwards.

The index is the Burrows-Wheeler transform of the sequences (suffixes sorted by
their first 64 symbols, which is enough for patterns of up to 63), kept in a
wavelet matrix: one bit vector per bit of the alphabet with counted blocks.
Searches run over many queries in step, as array operations.
"""

from __future__ import annotations

import numpy as np

DEPTH = 64                     # suffixes are sorted by this many symbols


class BitVector:
    """Bits with the number of ones before each block of 64."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words))[:-1])).astype(np.int64)
        self.zeros = n - int(bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Number of ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Rank of any symbol at any position of a sequence of numbers under 2**bits."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels, now = [], values
        for b in range(bits - 1, -1, -1):
            one = (now >> b & 1).astype(bool)
            self.levels.append((b, BitVector(one)))
            now = np.concatenate((now[~one], now[one]))
        symbols = np.arange(1 << bits) if bits < 24 else np.zeros(0, dtype=np.int64)
        self.start = self._place(symbols, np.zeros(len(symbols), dtype=np.int64))

    def _place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for b, v in self.levels:
            ones = v.ones(at)
            at = np.where(symbol >> b & 1, v.zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._place(symbol, at) - self.start[symbol]


class FMIndex:
    """Index over sequences of numbers from 1 on.  ``owner`` gives a number per sequence; the
    smallest owner of all occurrences of a match of ``most`` symbols is kept per match."""

    def __init__(self, sequences: list[np.ndarray], owner: np.ndarray, most: int):
        assert 32 < most < DEPTH
        self.most = most
        end = np.zeros(1, dtype=np.int64)
        text = np.concatenate([x for s in sequences for x in (s, end)] or [end])
        of = np.repeat(np.arange(len(sequences)), [len(s) + 1 for s in sequences]) if sequences else np.zeros(1, dtype=np.int64)
        n = self.n = len(text)
        self.ranks, rank, step = [], text.astype(np.int64), 1
        while True:                                   # ranks by the first 1, 2, 4, ... symbols
            self.ranks.append(rank)
            if step == DEPTH:
                break
            after = np.zeros(n, dtype=np.int64)
            after[:max(n - step, 0)] = rank[step:] + 1
            rank = np.unique(rank * (int(after.max()) + 1) + after, return_inverse=True)[1].astype(np.int64)
            step *= 2
        self.sa = np.argsort(rank, kind="stable")
        symbols = int(text.max()) + 1
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        self.bwt = WaveletMatrix(text[self.sa - 1], max(1, symbols.bit_length()))
        self.symbols = symbols
        # rows whose first ``most`` symbols are equal form a group
        half, rest = self.ranks[5], most - 32
        second = np.zeros(n, dtype=np.int64)
        second[:max(n - rest, 0)] = half[rest:] + 1
        a, b = half[self.sa], second[self.sa]
        head = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        self.group = np.cumsum(head) - 1
        self.group_start = np.flatnonzero(head)
        self.group_end = np.append(self.group_start[1:], n)
        owners = owner[of[self.sa]] if len(owner) else np.zeros(n, dtype=np.int64)
        self.group_owner = np.minimum.reduceat(owners, self.group_start)
        self._parents = None

    def parents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Common prefix with the row before (up to ``most``), and the nearest rows before and
        behind with a shorter one: the interval of a shorter match."""
        if self._parents is None:
            n, lcp = self.n, np.zeros(self.n, dtype=np.int64)
            i, j = self.sa[:-1].copy(), self.sa[1:].copy()
            for k in range(6, -1, -1):
                r, inside = self.ranks[k], (i < n) & (j < n)
                same = inside & (r[np.minimum(i, n - 1)] == r[np.minimum(j, n - 1)])
                lcp[1:][same] += 1 << k
                i[same] += 1 << k
                j[same] += 1 << k
            lcp = np.append(np.minimum(lcp, self.most), 0)
            lcp[0] = -1
            lcp[n] = -1
            before, behind = np.zeros(n + 1, dtype=np.int64), np.full(n + 1, n, dtype=np.int64)
            at = np.arange(n + 1)
            for v in range(self.most + 1):
                own = np.flatnonzero(lcp == v)
                if len(own):
                    low = np.where(lcp < v, at, -1)
                    before[own] = np.maximum.accumulate(low)[own]
                    high = np.where(lcp < v, at, n)
                    behind[own] = np.minimum.accumulate(high[::-1])[::-1][own]
            self._parents = np.maximum(lcp, 0), before, behind
        return self._parents

    def matching_statistics(self, queries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the queries laid end to end: length (up to ``most``) of the longest match that starts
        at each position, the first row of its interval, and where each query begins.  All
        queries are read from their ends, one symbol per step; a failed step shortens the match."""
        sizes = np.array([len(q) for q in queries], dtype=np.int64)
        first = np.concatenate(([0], np.cumsum(sizes)))
        flat = np.concatenate([*queries, np.zeros(0, dtype=np.int64)])
        length, row = np.zeros(len(flat), dtype=np.int64), np.zeros(len(flat), dtype=np.int64)
        on = np.flatnonzero(sizes)
        at = first[on + 1] - 1
        stop = first[on]
        lo, hi, got = np.zeros(len(on), dtype=np.int64), np.full(len(on), self.n, dtype=np.int64), np.zeros(len(on), dtype=np.int64)
        while len(at):
            c = flat[at]
            known = (c > 0) & (c < self.symbols)
            s = np.where(known, c, 0)
            new_lo = self.counts[s] + self.bwt.rank(s, lo)
            new_hi = self.counts[s] + self.bwt.rank(s, hi)
            ok = known & (new_hi > new_lo)
            lo, hi, got = np.where(ok, new_lo, lo), np.where(ok, new_hi, hi), np.where(ok, got + 1, got)
            long = got > self.most                    # forget the last symbol: widen to the group
            if long.any():
                g = self.group[lo[long]]
                lo[long], hi[long], got[long] = self.group_start[g], self.group_end[g], self.most
            over = ~known & ~ok
            if over.any():
                lo[over], hi[over], got[over] = 0, self.n, 0
            failed = ~ok & (got > 0)
            if failed.any():
                lcp, before, behind = self.parents()
                k = np.where(lcp[lo[failed]] >= lcp[hi[failed]], lo[failed], hi[failed])
                got[failed] = lcp[k]
                whole = lcp[k] == 0
                lo[failed], hi[failed] = np.where(whole, 0, before[k]), np.where(whole, self.n, behind[k])
            done = ~failed
            length[at[done]], row[at[done]] = got[done], lo[done]
            at = np.where(done, at - 1, at)
            stay = at >= stop
            if not stay.all():
                at, stop, lo, hi, got = at[stay], stop[stay], lo[stay], hi[stay], got[stay]
        return length, row, first
