"""Compressed FM-index of a shard's strings: a wavelet tree over their Burrows-Wheeler transform (numpy only)."""

from __future__ import annotations

import numpy as np

U = np.uint64


class BitRank:
    """A bit vector packed into 64-bit words, with counts per word: ones before a position."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(bits.size + 1) // 64) * 64, np.uint8)
        padded[: bits.size] = bits
        self.words = np.packbits(padded, bitorder="little").view(U)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def ones(self, i: np.ndarray) -> np.ndarray:
        word, bit = i >> 6, (i & 63).astype(U)
        return self.before[word] + np.bitwise_count(self.words[word] & ((U(1) << bit) - U(1)))


class WaveletTree:
    """Rank of any symbol: one bit vector for each bit of the symbols, sorted by the bits before (wavelet matrix)."""

    def __init__(self, symbols: np.ndarray):
        self.levels = []
        for shift in reversed(range(max(1, int(symbols.max(initial=0)).bit_length()))):
            bits = (symbols >> shift) & 1
            self.levels.append((shift, BitRank(bits), int(bits.size - bits.sum())))
            symbols = np.concatenate((symbols[bits == 0], symbols[bits == 1]))

    def walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position ``i`` comes to in the bottom order, following the bits of ``symbol``."""
        for shift, bits, zeros in self.levels:
            ones = bits.ones(i)
            i = np.where((symbol >> shift) & 1, zeros + ones, i - ones)
        return i


class FMIndex:
    def __init__(self, transform: np.ndarray):
        counts = np.bincount(transform)
        self.tree = WaveletTree(transform)
        self.size = transform.size
        # Symbols below, less where the symbol's own part of the bottom order begins: a rank is walk - begin.
        symbols = np.arange(counts.size)
        self.base = np.cumsum(counts) - counts - self.tree.walk(symbols, np.zeros_like(symbols))

    def extend(self, symbol: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the intervals of symbol + string."""
        both = self.tree.walk(np.concatenate((symbol, symbol)), np.concatenate((left, right)))
        base = self.base[symbol]
        return base + both[: symbol.size], base + both[symbol.size :]

    def matching(self, text: np.ndarray, first: np.ndarray, count: np.ndarray, limit: int, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """(start, n) runs of windows of ``limit`` symbols in ``text`` that the index holds ``least`` times or more.

        Query i asks for the windows from first[i] on, count[i] of them. All queries stream in step. A string
        over one or more windows is searched backward from its end, and its matching statistic is how far that
        goes. If it reaches the string's start, all its windows are found, and the next string spans twice as
        many. If a string of one window ends at a symbol p short of it, no window from here to p can reach the
        threshold, and the query goes on behind p; a longer string is tried again with one window.
        """
        found, spans = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        start, last = first.astype(np.int64), (first + count).astype(np.int64)
        keep = start < last
        start, last = start[keep], last[keep]
        span, step = np.ones(start.size, np.int64), np.zeros(start.size, np.int64)
        left, right = np.zeros(start.size, np.int64), np.full(start.size, self.size, np.int64)
        while start.size:
            at = start + span + limit - 2 - step
            left, right = self.extend(text[at], left, right)
            step += 1
            failed = right - left < least
            whole = ~failed & (at == start)
            if whole.any():
                found.append(start[whole])
                spans.append(span[whole])
            again = failed | whole
            start = np.where(whole, start + span, np.where(failed & (span == 1), at + 1, start))
            span = np.where(whole, span * 2, np.where(failed, 1, span))
            step[again], left[again], right[again] = 0, 0, self.size
            live = start < last
            span = np.minimum(span, np.maximum(last - start, 1))
            if not live.all():
                start, last, span, step, left, right = (x[live] for x in (start, last, span, step, left, right))
        return np.concatenate(found), np.concatenate(spans)
