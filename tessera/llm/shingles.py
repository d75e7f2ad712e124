"""Sets of distinct word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .wordhash import Words, chunks, mix


def _lower_spaced() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    out[[9, 10, 11, 12, 13]] = 32
    return out


#: A-Z in lower case; words end at space, tab, line feed, vertical tab, form feed and carriage return.
_TABLE = _lower_spaced()
_FACTORS = [np.uint64(int(x)) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_sets(texts: list[str], width: int = 3):
    """Yields the set of each text: distinct shingles of ``width`` words, or the whole sequence as one if it is shorter."""
    for _, run in chunks(texts):
        w = Words(run, _TABLE)
        n = len(w.hash)
        full = np.zeros(n, np.uint64)
        for j in range(width):
            full[: n - j] += w.hash[j:] * _FACTORS[j]
        full = mix(full)
        ends = np.cumsum(w.counts)
        for first, last in zip((ends - w.counts).tolist(), ends.tolist(), strict=True):
            if last - first >= width:
                yield np.unique(full[first : last - width + 1])
            elif last > first:
                few = w.hash[first:last] * np.array(_FACTORS[: last - first])
                yield mix(few.sum(keepdims=True) + np.uint64(last - first))
            else:
                yield np.zeros(0, np.uint64)
