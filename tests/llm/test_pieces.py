"""Pieces by which texts are encoded: how many there are, and that their ids are the library's."""

import random

import public_tokenizers
import pytest
import tokenizers

from tessera.llm.tokens import PieceEncoder

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
#: Characters at which pre-tokenizers and normalizers do something of their own.
ODD = ["a", "B", "é", "×", "÷", "ß", "Ω", "́", "̸", "'s", "'S", "'", ".", ",", "..", "=", "_", "^", "1", "23", "½", " ", " ", "\n", "\t", "\xa0", "\x85", "　", "\x00", "\x1c", "<|endoftext|>", "</s>", "漢", "…", "😀", "İ", "ﬁ", "À"]


def expected(path, texts):
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", NAMES)
def test_marks_and_digits_make_no_pieces_of_their_words(name):
    """Each word is merged once, whatever stands behind it."""
    rng, path = random.Random(2), public_tokenizers.path(name)
    words = sorted({"".join(rng.choice("abcdefgé") for _ in range(6)) for _ in range(150)})
    texts = [" ".join(w + end for w in words) for end in ("", ".", ",", ";", "!?", "###", "12", ")", "-", "@")]
    pieces = PieceEncoder(path)
    assert [x.tolist() for x in pieces.encode(texts)] == expected(path, texts)
    assert len(pieces.place) < len(words) + 30


@pytest.mark.parametrize("name", NAMES)
def test_odd_texts_give_the_librarys_ids(name, monkeypatch):
    """In batches of any size, with the store started anew in between."""
    rng, path = random.Random(3), public_tokenizers.path(name)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(14))) for _ in range(6000)]
    texts += [" ".join("".join(rng.choice(ODD[:21]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 9))) for _ in range(6000)]
    want = expected(path, texts)
    for at_once, kept in ((10_000_000, 800_000), (700, 50), (1, 800_000)):
        monkeypatch.setattr("tessera.llm.tokens.AT_ONCE", at_once)
        monkeypatch.setattr("tessera.llm.tokens.KEPT_PIECES", kept)
        assert [x.tolist() for x in PieceEncoder(path).encode(texts)] == want
