"""Token ids of whole texts, with public tokenizer files.

A BPE tokenizer cuts a text into pre-tokens and merges each by itself, so a text may be cut anywhere
between two pre-tokens.  Both vocabularies used here cut at a line feed, and before a space, that stands
between two characters which are not white space, and between letters, digits and marks of ASCII other than the apostrophe.  Texts are cut there: the places
are found on the bytes of all texts of a batch at once, and Arrow numbers the distinct pieces.  Each distinct piece is encoded
once by the library, and a text's ids are put together from its pieces' ids.  Texts repeat their words,
so this is several times as fast and gives the same ids.  A piece that is a plain word is one pre-token,
and is given to the library's merges without its cutting; that this gives the same ids is probed first.  A text with any other white space (doubled,
leading, trailing, tabs and so on) goes to the library whole.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

#: Pieces whose ids a worker keeps from batch to batch; beyond it, the store starts anew.
KEPT_PIECES = 800_000
#: Characters that are cut at once, which bounds the memory of the pieces.
AT_ONCE = 4_000_000
#: A word of Latin letters, which is one pre-token and has a lower case of its own.
_PLAIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
_PROBES = (" the", "the", " Straße", "Éléphant", " ñandúÿÀ", " thonatinwhst", "Qxzjkw", " WORLD", "a")
_WHITE = re.compile(r"\s")
#: Kinds of bytes between which a pre-token ends: letters, digits and marks; 0 stands for all others and the apostrophe, which may begin a pre-token with letters.
_KIND = np.array([0 if chr(b) == "'" or not 33 <= b < 127 else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], np.uint8)
#: A text whose kinds follow one another in every way, to probe that they may be parted.
_MIXED = "ab.Cd12,34ef-$5é_6é7(Gh)"


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write the UTF-8 bytes of each Latin-1 character."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


_AS_BYTES = _byte_letters()


class PieceEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        self._probe()
        self._start_anew()

    def _start_anew(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.first = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.odd = np.zeros(1 << 16, bool)

    def _keep(self, pieces: list[str], found: list) -> None:
        first = len(self.place)
        size = np.fromiter(map(len, found), np.int64, len(found))
        total = int(size.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(pieces) > len(self.first):
            self.first, self.size, self.odd = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size, self.odd))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        self.size[first : first + len(pieces)] = size
        self.first[first : first + len(pieces)] = self.used + np.cumsum(size) - size
        self.used += total
        self.place.update(zip(pieces, range(first, first + len(pieces)), strict=True))

    def _learn(self, pieces: list[str]) -> None:
        """Encodes pieces that are not in the store; a plain word goes to the merges at once."""
        plain = _PLAIN.fullmatch if self.plain is not None else lambda piece: None
        found = [self._merged(piece) if plain(piece) else None for piece in pieces]
        rest = [k for k, ids in enumerate(found) if ids is None]
        for k, e in zip(rest, self.tokenizer.encode_batch([pieces[k] for k in rest], add_special_tokens=False), strict=True):
            found[k] = e.ids
        start = len(self.place)
        self._keep(pieces, found)
        odd = [k for k in rest if pieces[k] != "\n" and (not pieces[k].strip() or _WHITE.search(pieces[k], 1 if pieces[k][0] == " " else 0))]
        self.odd[start + np.array(odd, np.int64)] = True

    def _merged(self, word: str) -> list[int]:
        lower, space = self.plain
        word = (word.lower() if lower else word) if space else word.lstrip(" ").lower() if lower else word.lstrip(" ")
        return [t.id for t in self.model.tokenize(word.replace(" ", _AS_BYTES[32]) if word.isascii() else word.translate(_AS_BYTES))]

    def _probe(self) -> None:
        """How a plain word reaches the merges: in lower case or not, with the space before it or not; None if neither fits."""
        for self.plain in ((False, True), (True, False)):
            if all(self._merged(w) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in _PROBES):
                break
        else:
            self.plain = None
        self.parted = True
        pieces = self._cut(pa.array([_MIXED], pa.large_string()))[0].to_pylist()
        ids = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in (_MIXED, *pieces)]
        self.parted = ids[0] == [*chain.from_iterable(ids[1:])] and all(t.special for t in self.tokenizer.get_added_tokens_decoder().values())

    def _cut(self, column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The pieces of all texts one after another, how many there are up to each text's end, and the texts with white space at an end or doubled."""
        bounds = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8)[: bounds[-1]]
        line, white = data == 10, data == 32
        white |= line
        starts = np.append(white, True)
        starts[np.flatnonzero(line) + 1] = True
        starts[bounds] = True
        if self.parted:
            kind = _KIND[data]
            starts[1:-1] |= (kind[1:] != kind[:-1]) & (kind[1:] != 0) & (kind[:-1] != 0)
            accents = np.flatnonzero(data[:-2] == 0xC3)  # of letters in two bytes, but for two signs
            last = data[accents + 1]
            starts[accents[(kind[accents + 2] > 1) & (last != 0x97) & (last != 0xB7)] + 2] = True
        offsets = np.flatnonzero(starts)
        pieces = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), column.buffers()[2])
        full = np.flatnonzero(bounds[1:] > bounds[:-1])
        ends = full[white[bounds[full]] | white[bounds[full + 1] - 1]]
        doubled = np.searchsorted(bounds, np.flatnonzero(white[1:] & white[:-1]), "right") - 1
        return pieces, np.searchsorted(offsets, bounds[1:]), np.union1d(ends, doubled)

    def _chunk(self, texts: list[str]) -> list[np.ndarray]:
        column = pa.array(texts, pa.large_string())
        if not any(texts):
            return [np.zeros(0, np.uint32) for _ in texts]
        pieces, last, odd = self._cut(column)
        numbered = pieces.dictionary_encode()
        distinct = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.place) > KEPT_PIECES:
            self._start_anew()
        at = np.fromiter(map(self.place.get, distinct, repeat(-1)), np.int64, len(distinct))
        if len(missing := np.flatnonzero(at < 0)):
            at[missing] = len(self.place) + np.arange(len(missing))
            self._learn([distinct[i] for i in missing.tolist()])
        at = at[numbered.indices.to_numpy()]
        size = self.size[at]
        ends = np.append(0, np.cumsum(size))
        ids = self.flat[np.repeat(self.first[at] - ends[:-1], size) + np.arange(ends[-1])]
        out = np.split(ids, ends[last[:-1]])
        # An odd piece has other white space: as doubled white space does, it shows a text that is not cut as said above.
        odd = np.union1d(odd, np.searchsorted(last, np.flatnonzero(self.odd[at]), "right"))
        for k, e in zip(odd.tolist(), self.tokenizer.encode_batch([texts[k] for k in odd.tolist()], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, np.uint32)
        return out

    def encode(self, texts: list[str]):
        """Yields for each text its ids (uint32)."""
        start = chars = 0
        for k, x in enumerate(texts):
            chars += len(x)
            if chars >= AT_ONCE or k == len(texts) - 1:
                yield from self._chunk(texts[start : k + 1])
                start, chars = k + 1, 0


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder per file and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
