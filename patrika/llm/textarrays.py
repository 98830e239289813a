"""Whole batches of texts as numpy arrays: words, their hashes and windows of them, without a Python object per word.

Hashes take bytes eight at a time through a bijective mix that is applied after each eight, so no pattern in a text, such
as a word and its complement, makes two hashes equal; what is left is chance, 1 in 2**64 for a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts go through the arrays in blocks of about so many bytes; a longer text is a block of its own.
BLOCK = 1 << 20
#: Words of more bytes are hashed one by one.
LONG_WORD = 256
_U = np.uint64
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as a number, zeros following the last; one more than bytes, without a copy of each."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each range."""
    size, eight = ends - starts, eights(data)
    out = mixed(size.astype(_U) + _U(0x5851F42D4C957F2D))
    live, at = np.flatnonzero((size > 0) & (size <= LONG_WORD)), 0
    while len(live):
        left = size[live] - at
        part = eight[starts[live] + at]
        short = left < 8
        part[short] &= (_U(1) << (left[short] * 8).astype(_U)) - _U(1)
        out[live] = mixed((out[live] ^ part) + _U(0x9E3779B97F4A7C15))
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Which ranges of `data` hold the same bytes as those of `other`, one by one."""
    size, a, b = ends - starts, eights(data), eights(other)
    same = size == other_ends - other_starts
    live, at = np.flatnonzero(same & (size > 0)), 0
    while len(live):
        left = np.minimum(size[live] - at, 8)
        mask = np.where(left < 8, (_U(1) << (np.minimum(left, 7) * 8).astype(_U)) - _U(1), ~_U(0))
        same[live] = (a[starts[live] + at] & mask) == (b[other_starts[live] + at] & mask)
        live, at = live[same[live] & (size[live] > at + 8)], at + 8
    return same


class Lookup:
    """Finds hashes among sorted terms by a table of their leading bits; terms that share a slot follow each other."""

    def __init__(self, terms: np.ndarray):
        bits = max(12, (8 * len(terms)).bit_length())
        self.terms, self.shift = terms, _U(64 - bits)
        slot = (terms >> self.shift).astype(np.int64)
        self.first, self.longest = np.full(1 << bits, -1, np.int32), int(np.bincount(slot).max(initial=0)) if len(terms) else 0
        self.first[slot[::-1]] = np.arange(len(terms), dtype=np.int32)[::-1]

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the hashes that are terms, and which terms."""
        term = self.first[(h >> self.shift).astype(np.int64)].astype(np.int64)
        at = np.flatnonzero(term >= 0)
        term = term[at]
        hit = self.terms[term] == h[at] if len(at) else np.zeros(0, bool)
        for _ in range(self.longest - 1):
            miss = np.flatnonzero(~hit)
            term[miss] = np.minimum(term[miss] + 1, len(self.terms) - 1)
            hit[miss] = self.terms[term[miss]] == h[at[miss]]
        return at[hit], term[hit]


class Block:
    """Consecutive texts: `data` (bytes as uint8) and `offsets` (one more than texts), `first` being the first one's row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.n = len(offsets) - 1

    def words(self, spaces: np.ndarray = _SPACES) -> None:
        """Sets starts, ends and doc (the text's index in the block) for each word, `[^\\x20\\x09-\\x0D]+` or runs of other
        bytes than `spaces` marks."""
        inside = np.zeros(len(self.data) + 2, bool)
        np.logical_not(spaces[self.data], out=inside[1:-1])
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        here, before = inside[1:], inside[:-1]
        self.starts = np.flatnonzero(here & (~before | edge))
        self.ends = np.flatnonzero(before & (~here | edge))
        self.doc = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.n_words = np.bincount(self.doc, minlength=self.n)
        self.first_word = np.concatenate([[0], np.cumsum(self.n_words)])

    def grams(self, k: int) -> np.ndarray:
        """A hash of the k bytes from each byte on, as far as k bytes of the block follow: those of eight bytes, joined to
        twice as many again and again, the last ones overlapping."""
        if len(self.data) < k:
            return np.zeros(0, _U)
        part = eights(self.data)[: len(self.data) - min(k, 8) + 1]
        if k < 8:
            part = part & _U((1 << 8 * k) - 1)
        out, width = mixed(part + _U(0x9E3779B97F4A7C15)), min(k, 8)
        while width < k:
            step = min(width, k - width)
            out = mixed(out[:-step] * _U(0xD6E8FEB86659FD93) + out[step:])
            width += step
        return out

    def word_hashes(self) -> np.ndarray:
        """A hash for each word."""
        return range_hashes(self.data, self.starts, self.ends)

    def windows(self, width: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of `width` words that lie in one text, and the index of each one's first word."""
        h = self.word_hashes() if hashes is None else hashes
        n = len(h) - width + 1
        if n <= 0:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        total, factor = np.zeros(n, _U), 1
        for j in range(width):
            factor = factor * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
            total += h[j : j + n] * _U(factor)
        at = np.flatnonzero(self.doc[:n] == self.doc[width - 1 :])
        return mixed(total[at]), at


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a binary or string column; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[Block]:
    """The column in blocks of about `size` bytes."""
    data, offsets = binary_parts(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        end = min(end, len(column))
        yield Block(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], at)
        at = end
