"""Words of many texts at once, as hashes and class masks, with numpy over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

#: Characters that are handled at once, which bounds the memory of the arrays.
AT_ONCE = 500_000
_POWERS = np.empty(1 << 12, np.uint64)
_p = 1
for _k in range(len(_POWERS)):
    _POWERS[_k] = _p
    _p = _p * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """``hash``: of each word; ``doc``: the text it is in; ``start``, ``end``: its bytes in ``data``."""

    def __init__(self, texts: list[str], table: np.ndarray):
        """``table`` maps each byte to another; bytes that map to 32 separate words."""
        raw = "\x20".join(texts).encode()
        # A space between texts is a separator in every table used.
        sizes = np.fromiter((len(t.encode()) if not t.isascii() else len(t) for t in texts), np.int64, len(texts))
        self.raw = np.frombuffer(raw, np.uint8)
        self.data = table[self.raw]
        inside = np.zeros(len(self.data) + 2, bool)
        np.not_equal(self.data, 32, out=inside[1:-1])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        self.starts_of_texts = np.cumsum(sizes + 1) - (sizes + 1)
        self.doc = np.searchsorted(self.starts_of_texts, self.start, "right") - 1
        self.counts = np.bincount(self.doc, minlength=len(texts)) if len(self.doc) else np.zeros(len(texts), np.int64)
        size = self.end - self.start
        if not len(size):
            self.hash = np.zeros(0, np.uint64)
            return
        place = np.arange(len(self.data))
        place[self.start[0] :] -= np.repeat(self.start, np.diff(np.append(self.start, len(self.data))))
        value = (self.data.astype(np.uint64) + np.uint64(1)) * _POWERS[place & (len(_POWERS) - 1)]
        value[self.data == 32] = 0
        if size.max() > len(_POWERS):  # a very long word: the powers repeat, so later rounds are scrambled
            value = np.where(place >= len(_POWERS), mix(value + (place >> 12).astype(np.uint64)), value)
            value[self.data == 32] = 0
        self.hash = mix(np.add.reduceat(value, self.start) + size.astype(np.uint64))


def chunks(texts: list[str]):
    """Runs of texts, each of about AT_ONCE characters."""
    start = chars = 0
    for k, x in enumerate(texts):
        chars += len(x)
        if chars >= AT_ONCE or k == len(texts) - 1:
            yield start, texts[start : k + 1]
            start, chars = k + 1, 0
