"""Counts of edits of texts that differ: the table's counts, in little time."""

import random
import time

import pytest

from tessera.functions import sequences as q


@pytest.mark.parametrize("long", [0, 20_000])
def test_error_counts_of_any_lengths_trace_like_the_table(monkeypatch, long):
    """The whole table by bits, turned or not, in blocks and after a band that is too narrow."""
    from test_whole_texts import edits_by_table

    monkeypatch.setattr(q, "LONG", long, raising=False)
    rng = random.Random(5)
    for k in range(300):
        a, b = ("".join(rng.choice("abé你"[: 2 + k % 3]) for _ in range(rng.randrange(0, 24))) for _ in range(2))
        assert q.error_counts(a, b, band=1 + k % 3) == edits_by_table(a, b)


def test_error_counts_of_texts_that_differ_take_no_time():
    rng = random.Random(6)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(6000)) for _ in range(2))
    began = time.process_time()
    s, d, i = q.error_counts(a, b[:5000])
    assert d - i == 1000 and s + d + i > 1000
    assert time.process_time() - began < 2
