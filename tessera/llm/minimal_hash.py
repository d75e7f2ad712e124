"""A minimal perfect hash of triples of 64-bit words, with the triples stored by slot."""

from __future__ import annotations

import numpy as np

from .wordhash import mix

#: Bits of a level for each triple that is still without a slot.
SPACE = 2


def _place(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Where the triples fall in a level; each level hashes them anew, so no two stay together for ever."""
    w = keys.view(np.uint64)
    h = mix(w[:, 0] + np.uint64(0x9E3779B97F4A7C15 * (2 * level + 1) & 0xFFFFFFFFFFFFFFFF))
    h = mix(mix(h ^ w[:, 1]) + w[:, 2])
    return (h % np.uint64(bits)).astype(np.int64)


class PerfectHash:
    """Levels of bits: a triple's slot is the rank of its bit in the first level where it fell alone.

    ``slots`` gives -1 for what is not among the stored triples, which are compared in full.
    """

    def __init__(self, sizes: list[int], words: list[np.ndarray], stored: np.ndarray):
        self.sizes, self.words, self.stored = sizes, words, stored
        self.ranks, before = [], 0
        for w in words:
            counts = np.bitwise_count(w).astype(np.int64)
            self.ranks.append(before + np.cumsum(counts) - counts)
            before += int(counts.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: distinct rows of three int64."""
        sizes, words, rest = [], [], keys
        while len(rest):
            bits = -(-max(64, SPACE * len(rest)) // 64) * 64
            at = _place(rest, len(sizes), bits)
            alone = np.bincount(at, minlength=bits)[at] == 1
            taken = np.zeros(bits, bool)
            taken[at[alone]] = True
            words.append(np.packbits(taken, bitorder="little").view(np.uint64))
            sizes.append(bits)
            rest = rest[~alone]
        out = cls(sizes, words, np.zeros((len(keys), 3), np.int64))
        out.stored[out._slots(keys)] = keys
        return out

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.sizes):
            if not len(left):
                break
            at = _place(keys[left], level, bits)
            word, bit = self.words[level][at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) != 0
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (self.ranks[level][at >> 6] + below)[hit]
            left = left[~hit]
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        at = self._slots(keys)
        if len(self.stored):
            at[(at >= 0) & (self.stored[at] != keys).any(1)] = -1
        return at

    def pack(self) -> bytes:
        head = np.array([len(self.sizes), *self.sizes], np.int64)
        return b"".join([head.tobytes(), *[w.tobytes() for w in self.words], self.stored.tobytes()])

    @classmethod
    def unpack(cls, data) -> PerfectHash:
        (n,) = np.frombuffer(data, np.int64, 1).tolist()
        sizes, place, words = np.frombuffer(data, np.int64, n, 8).tolist(), 8 * (n + 1), []
        for bits in sizes:
            words.append(np.frombuffer(data, np.uint64, bits // 64, place))
            place += bits // 8
        return cls(sizes, words, np.frombuffer(data, np.int64, -1, place).reshape(-1, 3))
