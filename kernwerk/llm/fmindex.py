"""An FM-index over a sequence of symbols: suffix array, Burrows-Wheeler transform, wavelet matrix and sampled positions, all vectorised."""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; the sequence must end in a symbol of its own that is smaller than all others."""
    n = len(seq)
    rank = seq.astype(np.int64)
    step = 1
    while True:
        key = rank * (int(rank.max()) + 2)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key)  # equal keys share a rank, so their order does not matter yet
        sorted_ = key[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
        rank = new
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


def spread_out(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, … (many[0] numbers), then those of first[1], and so on."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())


class WaveletMatrix:
    """Access and rank of any symbol in one step for each bit of the alphabet."""

    def __init__(self, seq: np.ndarray, symbols: int) -> None:
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        cur = seq.astype(np.int32)
        for level in reversed(range(self.bits)):
            b = ((cur >> level) & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(b)]).astype(np.int32))
            self.zeros.append(int(len(cur) - b.sum()))
            cur = np.concatenate([cur[~b], cur[b]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        start, end = np.zeros_like(upto), upto.copy()
        for k, level in enumerate(reversed(range(self.bits))):
            b = (symbol >> level) & 1
            s1, e1 = self.ones[k][start], self.ones[k][end]
            start = np.where(b == 1, self.zeros[k] + s1, start - s1)
            end = np.where(b == 1, self.zeros[k] + e1, end - e1)
        return end - start

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its rank there."""
        pos, start, symbol = at.copy(), np.zeros_like(at), np.zeros_like(at)
        for k in range(self.bits):
            o = self.ones[k]
            b = o[pos + 1] - o[pos]
            symbol = symbol * 2 + b
            s1, p1 = o[start], o[pos]
            start = np.where(b == 1, self.zeros[k] + s1, start - s1)
            pos = np.where(b == 1, self.zeros[k] + p1, pos - p1)
        return symbol, pos - start


class FMIndex:
    """Counts and locates phrases of symbols 1..symbols-1 in a sequence; symbol 0 ends it."""

    def __init__(self, seq: np.ndarray, symbols: int, sample: int = 4) -> None:
        seq = np.append(seq, 0)
        self.n = len(seq)
        sa = suffix_array(seq)
        self.bwt = WaveletMatrix(seq[sa - 1], symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols))])
        self.sampled = sa % sample == 0
        self.slot = np.cumsum(self.sampled) - 1
        self.places = sa[self.sampled]

    def search(self, phrases: np.ndarray, first: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of many phrases of classes at once: (phrase, low, high) of every range of the suffix array that is not empty.

        Each row of ``phrases`` is a phrase of as many classes as there are columns; class c may be any of symbols[first[c]:first[c + 1]]. A
        step puts every symbol of the class before each range that is still open, so a phrase branches over its spellings and the ranks
        close the branches that do not occur. The ranges of one phrase are disjoint.
        """
        phrase = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        for column in reversed(range(phrases.shape[1] if len(phrases) else 0)):
            c = phrases[phrase, column]
            many = first[c + 1] - first[c]
            row = np.repeat(np.arange(len(c)), many)
            s = symbols[spread_out(first[c], many)]
            a, b = self.before[s] + self.bwt.rank(s, low[row]), self.before[s] + self.bwt.rank(s, high[row])
            open_ = a < b
            phrase, low, high = phrase[row[open_]], a[open_], b[open_]
        return phrase, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix array rows: walk back by the last-to-first mapping to the next sampled row."""
        out = np.zeros(len(rows), dtype=np.int64)
        todo, cur, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            hit = self.sampled[cur]
            out[todo[hit]] = self.places[self.slot[cur[hit]]] + steps
            todo, cur = todo[~hit], cur[~hit]
            if len(todo):
                symbol, rank = self.bwt.access_rank(cur)
                cur = self.before[symbol] + rank
                steps += 1
        return out
