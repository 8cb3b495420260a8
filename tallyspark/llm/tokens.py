"""Vectorised hashing of bytes and words inside Arrow tasks.

A word is hashed by a cryptographic digest. A range of words, or of bytes, is hashed by a polynomial over
their numbers modulo 2**64, so the hash of any range is a difference of two prefix values. Such hashes
have collisions by construction from some 1,000 tokens on; they are used for short grams only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INV = U(pow(int(_BASE), -1, 2**64))
CHUNK = 1 << 20

#: Words whose digest a worker remembers.
REMEMBERED = 500_000

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x.astype(U, copy=True)
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> U(shift)
        x *= U(mul)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U))
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse."""
    if _powers[0].size < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for i, base in enumerate((_BASE, _INV)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=U)
    return _powers[0][:n], _powers[1][:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix hashes of a sequence of 64-bit values; one entry more than there are values."""
    out = np.zeros(values.size + 1, U)
    np.cumsum(values * powers(values.size)[0], dtype=U, out=out[1:])
    return out


def ranges(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end), independent of where the range stands."""
    inv = powers(pre.size)[1]
    return mix(((pre[ends] - pre[starts]) * inv[starts]) ^ mix((ends - starts).astype(U)))


def byte_values(buf: np.ndarray) -> np.ndarray:
    return _BYTE[buf]


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the words' starts and ends."""
    inside = np.zeros(buf.size + 2, np.int8)
    inside[1:-1] = ~SPACE[buf]
    turns = np.flatnonzero(np.diff(inside))
    return turns[0::2], turns[1::2]


def _cut(buf: np.ndarray, at: int) -> int:
    """Where a piece that starts at ``at`` ends: after white space, about CHUNK bytes on."""
    if at + CHUNK >= buf.size:
        return buf.size
    gaps = np.flatnonzero(SPACE[buf[at : at + CHUNK]])
    if gaps.size:
        return at + int(gaps[-1]) + 1
    end = at + CHUNK  # inside a word longer than the piece
    while end < buf.size:
        gaps = np.flatnonzero(SPACE[buf[end : end + CHUNK]])
        if gaps.size:
            return end + int(gaps[0]) + 1
        end += CHUNK
    return buf.size


class _Digests(dict):
    """A 64-bit BLAKE2 digest of each word, remembered for frequent short words."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = value
        return value


_digests = _Digests()


def word_hashes(buf: np.ndarray, fold: bool) -> np.ndarray:
    """One digest per word in order; ``fold`` lower-cases A-Z first. Long texts go in pieces cut at white space.

    bytes.split knows just the six kinds of white space, and bytes.lower just A-Z.
    """
    out, at = [], 0
    while at < buf.size:
        end = _cut(buf, at)
        piece = buf[at:end].tobytes()
        words = (piece.lower() if fold else piece).split()
        out.append(np.fromiter(map(_digests.__getitem__, words), U, len(words)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, U)


def lists_of(column) -> Iterator[dict[str, np.ndarray]]:
    """The struct lists of an Arrow column, each as an array per field; a missing list is empty."""
    ends, values = column.offsets.to_numpy(), column.values
    fields = {f.name: values.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(values.type)}
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield {name: x[a:b] for name, x in fields.items()}


def rows_of(column) -> list[np.ndarray]:
    """The values of an Arrow binary column as byte arrays, without copies."""
    if column.null_count:
        return [np.frombuffer(x or b"", np.uint8) for x in column.to_pylist()]
    _, offsets, data = column.buffers()
    width = np.int64 if str(column.type).startswith("large") else np.int32
    off = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return [raw[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
