"""Burrows-Wheeler transform of a shard's strings, and common prefixes by interval expansion (numpy only)."""

from __future__ import annotations

import numpy as np


def joined(bodies: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The strings one after another, symbols from 1 on and a 0 behind each; offsets of the strings."""
    sizes = np.array([b.size for b in bodies])
    offsets = np.concatenate(([0], np.cumsum(sizes + 1)))
    text = np.zeros(offsets[-1], np.int64)
    flat = np.concatenate(bodies)
    text[np.arange(flat.size) + np.repeat(np.arange(len(bodies)), sizes)] = flat.astype(np.int64) + 1
    return text, offsets


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix positions sorted by at least their first ``depth`` symbols, by prefix doubling.

    The first ranks are those of as many symbols as fit 63 bits; each round then sorts the suffixes that
    are not yet alone by the rank of what follows.
    """
    n, width = text.size, max(1, int(text.max(initial=0)).bit_length())
    h = max(1, min(63 // width, n))
    key = np.zeros(n, np.int64)
    for i in range(h):
        key <<= width
        key[: n - i] |= text[i:]
    order = np.argsort(key)
    rank, order, open_ = _ranked(key, order)
    while h < depth and open_.size:
        at = order[open_]
        ahead = np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + ahead
        inner = np.argsort(key)
        key, at = key[inner], at[inner]
        order[open_] = at
        fresh = np.diff(key, prepend=-1) != 0
        # A rank is the first place of a suffix's group in the order.
        first = np.maximum.accumulate(np.where(fresh, open_, 0))
        rank[at] = first
        h *= 2
        alone = fresh & np.append(fresh[1:], True)
        open_ = open_[~alone]
    return order


def _ranked(key: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    fresh = np.diff(key[order], prepend=-1) != 0
    rank = np.empty(order.size, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(order.size), 0))
    return rank, order, np.flatnonzero(~(fresh & np.append(fresh[1:], True)))


def transform(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    return text[order - 1]


def short_prefix_bounds(bwt: np.ndarray, depth: int) -> np.ndarray:
    """Flags at i where the suffixes of ranks i-1 and i share fewer than ``depth`` symbols; ranks 0 and n are flagged.

    Intervals of strings of length 1, 2, ... are made from shorter ones by backward extension, breadth
    first. The interval of a string of length k that ends at rank r sets the bound at r to k-1 unless a
    shorter string did; only then is it expanded. Expansion stops at ``depth``: what is still open
    shares at least that much. Extension by the separator 0 is left out, so strings hold it only last.
    Intervals are expanded a run of equal transform symbols at a time, which repetitive text has few of.
    """
    n = bwt.size
    closed = np.zeros(n + 1, bool)
    closed[[0, n]] = True
    by_symbol = np.argsort(bwt.astype(np.uint16), kind="stable")
    back = np.empty(n, np.int64)
    back[by_symbol] = np.arange(n)
    changes = np.flatnonzero(np.diff(bwt, prepend=-1))
    run_of = np.cumsum(np.diff(bwt, prepend=bwt[:1]) != 0)
    run_end = np.append(changes[1:], n)
    counts = np.bincount(bwt)
    ends = np.cumsum(counts)
    left, right = (ends - counts)[counts > 0], ends[counts > 0]
    closed[right] = True
    width = int(bwt.max()) + 1
    for _ in range(1, depth):
        if not left.size:
            break
        first_run, last_run = run_of[left], run_of[right - 1]
        n_runs = last_run - first_run + 1
        owner = np.repeat(np.arange(left.size), n_runs)
        runs = np.arange(owner.size) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs) + first_run[owner]
        low, high = np.maximum(left[owner], changes[runs]), np.minimum(right[owner], run_end[runs]) - 1
        symbol = bwt[low]
        keep = symbol > 0
        owner, low, high, symbol = owner[keep], low[keep], high[keep], symbol[keep]
        key = owner * width + symbol
        order = np.argsort(key, kind="stable")
        key = key[order]
        head = np.flatnonzero(np.diff(key, prepend=-1))
        tail = np.append(head[1:], key.size) - 1 if head.size else head
        left, right = back[low[order[head]]], back[high[order[tail]]] + 1
        fresh = ~closed[right]
        left, right = left[fresh], right[fresh]
        closed[right] = True
    return closed
