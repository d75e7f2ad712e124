"""Lists and families of the Jaccard join: skipped blocks, derived answers, and both when they are split."""

import random

import numpy as np
import pytest
from corpora import write
from test_operators import classes, multiset

from tessera.llm import op02_set_relation_join as op2


def near_copies(rng, m, words=130, edits=9, prefix="w"):
    base = [f"{prefix}{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(m):
        w = list(base)
        for _ in range(rng.randrange(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(30)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("limits", [(1024, 512), (40, 50)])
def test_links_of_hot_groups_with_copies(spark, tmp_path, monkeypatch, limits):
    """Two groups of near copies that share half their text, exact copies, null ids; whole and split lists and families."""
    monkeypatch.setattr(op2, "LIMIT", limits[0])
    monkeypatch.setattr(op2, "TOGETHER", limits[1])
    rng = random.Random(5)
    texts = near_copies(rng, 150) + near_copies(rng, 60, 40, 3, "v")
    texts += texts[:20] + [texts[7]] * 15 + ["", None, "one", "two words", "two words"]
    rows = [(k if k % 50 else None, t) for k, t in enumerate(texts)]
    got = op2.query(spark, write(tmp_path, rows)).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    want = classes(rows)
    assert multiset(got) == multiset(want) and len({w[3] for w in want}) > 4


def test_blocks_are_skipped_and_no_pair_is_lost():
    rng = np.random.default_rng(3)
    n = rng.integers(20, 400, 900)
    pos = (rng.random(900) * op2.prefix_size(400, 9, 10)).astype(np.int64)
    order = np.lexsort((pos, n))
    n, pos = n[order].astype(np.int64), pos[order]
    bins = np.zeros((900, 64), np.uint8)
    some = op2.LongList(n, pos, op2.Counts([bytes(32)] * 900), 9, 10)
    got = {(int(a), int(b)) for x, y in some.pairs(np.arange(900)) for a, b in zip(x, y, strict=True)}
    want = {(i, j) for i in range(900) for j in range(i) if op2._allowed(n[i], pos[i], n[j], pos[j], 9, 10) and op2._near(bins[i], bins[j], n[i], n[j], 9, 10)}
    assert got == want and some.skipped > some.visited
    first = [int(a) for x, _ in op2.LongList(n, pos, op2.Counts([bytes(32)] * 900), 9, 10).pairs() for a in x]
    assert sorted(first) == sorted({i for i, _ in want})


def test_answers_from_differences_equal_those_of_whole_sets():
    rng = np.random.default_rng(8)
    base = np.arange(200, dtype=np.uint64)
    sets = []
    for _ in range(60):
        gone = rng.choice(200, rng.integers(0, 20), replace=False)
        sets.append(np.union1d(np.delete(base, gone), rng.integers(1000, 1040, rng.integers(0, 15)).astype(np.uint64)))
    n, diffs = np.array([len(s) for s in sets]), [np.setxor1d(s, base) for s in sets]
    got, looked_at = op2.linked(n, diffs, n, diffs, 9, 10)
    want = np.array([[10 * len(np.intersect1d(a, b)) >= 9 * len(np.union1d(a, b)) for b in sets] for a in sets])
    assert (got == want).all() and want.any() and not want.all() and looked_at < got.size


def test_packed_differences_keep_every_symmetric_difference():
    """Also of a set that equals its base, only lacks shingles, or only has more."""
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    more = np.array([7, 2**63 + 9], np.uint64)
    sets = [base, base[:-5], base[10:], np.union1d(base, more), np.union1d(base[20:], more), more]
    diffs = [op2.unpacked_differences(op2.packed(s, base)) for s in sets]
    for a, x in zip(sets, diffs, strict=True):
        assert len(x) == len(np.setxor1d(a, base))
        assert [len(np.setxor1d(x, y)) for y in diffs] == [len(np.setxor1d(a, b)) for b in sets]


def test_counts_of_any_two_widths_bound_the_difference():
    """No linked pair is refused, also of sets on both sides of a width's limit; unlike long sets are."""
    rng = np.random.default_rng(4)
    sets = []
    for size in (60, 505, 519, 3000, 4090, 4100, 9000):
        base = rng.integers(0, 2**64, size, dtype=np.uint64)
        sets += [np.unique(base), np.unique(base[size // 30 :]), np.unique(np.append(base[size // 30 :], rng.integers(0, 2**64, size // 30, dtype=np.uint64))), np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))]
    counts, n = op2.Counts([op2.bins_of(s).tobytes() for s in sets]), np.array([len(s) for s in sets])
    x, y = (a.ravel() for a in np.meshgrid(np.arange(len(sets)), np.arange(len(sets)), indexing="ij"))
    got = counts.near(x, y, n[x], n[y], 9, 10)
    want = np.array([10 * len(np.intersect1d(sets[i], sets[j])) >= 9 * len(np.union1d(sets[i], sets[j])) for i, j in zip(x, y, strict=True)])
    assert (got | ~want).all() and (want & (x != y)).any()
    assert (got == want)[(n[x] > 2000) & (n[y] > 2000)].all()


def test_any_two_near_sets_are_linked():
    rng = np.random.default_rng(6)
    base = np.arange(300, dtype=np.uint64)
    sets = [np.union1d(base[k % 290 :][int(gone) :], np.arange(1000 * k, 1000 * k + int(more), dtype=np.uint64) + np.uint64(1000)) for k, (gone, more) in enumerate(zip(rng.integers(0, 12, 60), rng.integers(0, 12, 60), strict=True))]
    n = np.array([len(s) for s in sets])
    for num, den in ((9, 10), (4, 5)):
        near = np.flatnonzero(op2.near(n, np.array([len(np.setxor1d(s, base)) for s in sets]), num, den))
        assert 2 < len(near) < 60
        assert all(den * len(np.intersect1d(sets[i], sets[j])) >= num * len(np.union1d(sets[i], sets[j])) for i in near for j in near)
