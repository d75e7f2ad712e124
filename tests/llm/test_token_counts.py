"""Token counts against the libraries, for texts whole and cut."""

import random

import numpy as np
import pytest
from corpora import prose

from tessera.llm import op13_token_counts as op13
from tessera.llm.scratch import Scratch

public_tokenizers = pytest.importorskip("public_tokenizers")
FILES = ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"]


def whole(path, text):
    """What the library gives for a text at once."""
    if path.endswith(".model"):
        import sentencepiece

        return len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text or ""))
    from tokenizers import Tokenizer

    return len(Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids)


def multiset(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_query_counts_as_the_library(spark, corpus, documents):
    path = public_tokenizers.path(FILES[0])
    want = [(d, len((t or "").encode()), n := whole(path, t), n > 2048) for d, t in documents]
    assert multiset(op13.query(spark, corpus).collect()) == multiset(want)


def hard_texts():
    rng = random.Random(11)
    long = prose(rng, 700)
    return [
        long, long, long.replace(" ", "  "), long.replace(" ", "\n"), "é" * 3000 + " " + long, "no" * 4000, "词语" * 900, "Ωορία ΣΑΣ é ́x " * 300,
        "<|endoftext|> inside <|startoftext|>" * 120, "<|end" * 700, " " * 5000, "a " * 3000, "1234567 8,9 " * 400, long[:999] + "x" * 3000 + long[999:], "don't we'll " * 300, "  \x85\t" * 500, "", None, "short", "\U0001f600 ‍" * 700,
    ]


@pytest.mark.parametrize("name", FILES)
def test_cut_texts_count_as_whole_ones(spark, name):
    """Chunks of a few words, overlaps without and with a splice, texts without spaces, copies, special strings across cuts."""
    path, texts = public_tokenizers.path(name), hard_texts()
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id int, text string, key string").repartition(5)
    with Scratch(spark) as s:
        got = op13.token_counts(s, docs, path, huge=600, chunk=256, overlap=32).collect()
    assert multiset(got) == multiset((k, len((t or "").encode()), whole(path, t)) for k, t in enumerate(texts))


@pytest.mark.parametrize("seed", range(6))
def test_splices_of_random_texts(seed):
    """Every splice that is found gives the count of the whole text."""
    lib, rng = op13.library(public_tokenizers.path(FILES[seed % 3])), random.Random(seed)
    letters = ["a", "b", "the ", " ", "  ", "\n", "é", "'s", "1", ".", "Σ", "́", "<|endoftext|>", "ing", "　", "词"]
    found = 0
    for _ in range(60):
        text = "".join(rng.choice(letters) for _ in range(400))
        whole_count = len(lib.tokens(text))
        chunk, overlap = 150, 60
        parts = [lib.tokens(p) + np.array([k * chunk, k * chunk, 0]) for k, p in enumerate(op13.cut(text, chunk, overlap))]
        n = sum(map(len, parts))
        for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)):
            first, last = (k + 1) * chunk, (k + 1) * chunk + overlap
            left, rest = op13.zone(a, first, last)
            right, before = op13.zone(b, first, last)
            places = np.array([m.start() for m in op13.SAFE.finditer(text, first, last)], np.int64)
            if (at := op13.splice(left, right, places)) is None:
                n = None
                break
            n -= len(a) - rest - at[0] + before + at[1]
        if n is not None:
            found += 1
            assert n == whole_count
    assert found or seed % 3 == 2


def test_a_torn_overlap_is_no_splice():
    tokens = np.array([(0, 3, 1), (3, 7, 2), (7, 9, 3)], np.int64)
    assert op13.splice(tokens, tokens, np.array([5, 8], np.int64)) is None
    assert op13.splice(tokens, tokens, np.array([3, 7], np.int64)) == (1, 1)
    other = tokens.copy()
    other[1, 2] = 9
    assert op13.splice(tokens, other, np.array([3, 7], np.int64)) is None
    assert op13.splice(tokens, tokens, np.array([], np.int64)) is None


def test_an_overlap_longer_than_its_chunk_is_refused(spark):
    with pytest.raises(ValueError), Scratch(spark) as s:
        op13.token_counts(s, spark.createDataFrame([(1, "x")], "doc_id long, text string"), "none.json", chunk=10, overlap=20)
