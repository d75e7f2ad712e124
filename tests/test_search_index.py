"""The stored search index against brute force: matches, ranks, skipped ranges, appends."""

import collections
import math
import random
import re

import pytest

from tessera.operators import search
from tessera.operators.search import SearchIndex, phrases_of
from tessera.sources.scratch import Scratch

SCHEMA = "transcript_id long, ordinal long, start_ms long, end_ms long, text string"


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(blocks, query, limit):
    """(transcript_id, ordinal, tf, score) by counting every phrase in every block."""
    tokens = {b[:2]: words(b[4]) for b in blocks}
    n, mean = len(tokens), sum(map(len, tokens.values())) / max(1, len(tokens))
    df = collections.Counter(t for w in tokens.values() for t in set(w))
    phrases = [w for p in phrases_of(query) if (w := words(p))]
    out = []
    for key, w in tokens.items():
        tfs = [sum(w[k : k + len(p)] == p for k in range(len(w) - len(p) + 1)) for p in phrases]
        if phrases and all(tfs):
            idfs = [max(math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) for t in p) for p in phrases]
            score = sum(i * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean)) for i, tf in zip(idfs, tfs, strict=True))
            out.append((-round(score, 9), *key, sum(tfs)))
    return [(t, o, tf, -s) for s, t, o, tf in sorted(out)[:limit]]


def corpus(seed, n=400):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "in", "la"] + [f"w{k}" for k in range(25)]
    weights = [20, 12, 8, 5, 5] + [1] * 25
    text = lambda: " ".join(rng.choices(vocabulary, weights, k=rng.randrange(0, 30)))
    return [(k // 7, k % 7, 10 * k, 10 * k + 5, text().replace("and", "And, ")) for k in range(n)] + [(90, 0, 0, 1, None), (90, 1, 0, 1, ""), (91, 0, 0, 1, "the the the of the")]


QUERIES = ["the", "of the", '"of the"', '"the of" w1', "w3 w4", '"the the"', '"w1 w2', "nothing", "", '" "', "THE, of!", '"of the" "of the"']


@pytest.mark.parametrize("limit", [3, 50, None])
def test_hits_are_those_of_brute_force(spark, monkeypatch, limit):
    """Also where most ranges are passed over: ranges of a few blocks, one of them read first."""
    monkeypatch.setattr(search, "RANGE_BLOCKS", 8)
    monkeypatch.setattr(search, "FIRST_RANGES", 1)
    blocks = corpus(1)
    with Scratch(spark) as s:
        index = SearchIndex(spark, s.path("index"))
        assert index.append(spark.createDataFrame(blocks, SCHEMA)) == len(blocks)
        got = collections.defaultdict(list)
        for r in index.matches(QUERIES, limit).collect():
            got[r["query"]].append((-r["score"], r["transcript_id"], r["ordinal"], r["tf"]))
        for q in QUERIES:
            assert [(t, o, tf, pytest.approx(-s, abs=2e-9)) for s, t, o, tf in sorted(got[q])] == brute(blocks, q, limit)


def test_appends_past_the_mark_and_repeats_change_nothing(spark):
    blocks = spark.createDataFrame(corpus(2, 100), SCHEMA)
    with Scratch(spark) as s:
        index = SearchIndex(spark, s.path("index"))
        assert index.mark() == (-1, -1) and index.matches(["the"]).count() == 0
        first = index.append(blocks.where("transcript_id < 5"))
        # A build that was killed: its segment is written, and not committed.
        blocks.where("transcript_id < 9").write.parquet(f"{index.path}/segments/1-killed/blocks")
        assert index.mark() == (4, 6)
        second = index.append(blocks)
        assert first + second == blocks.count() and index.append(blocks) == 0
        hits = index.matches(["the"], None)
        assert hits.count() == hits.distinct().count() == blocks.where("lower(text) rlike '\\\\bthe\\\\b'").count()
        assert [c["blocks"] for c in index.commits()] == [first, second]


def test_named_appends_are_done_once(spark):
    blocks = spark.createDataFrame(corpus(3, 60), SCHEMA)
    with Scratch(spark) as s:
        index = SearchIndex(spark, s.path("index"))
        for _ in range(2):
            index.append(blocks.where("ordinal % 2 = 1"), "epoch-0")
            index.append(blocks.where("ordinal % 2 = 0"), "epoch-1")
        assert [c["name"] for c in index.commits()] == ["epoch-0", "epoch-1"]
        assert index.matches(["of"], None).count() == blocks.where("lower(text) rlike '\\\\bof\\\\b'").count()


def test_dense_scripts_are_found_inside_runs(spark):
    texts = ["否定之否定", "这是 否定 的", "定之否", "AI人工智能", "a否b定c"]
    with Scratch(spark) as s:
        index = SearchIndex(spark, s.path("index"))
        index.append(spark.createDataFrame([(1, k, 0, 1, t) for k, t in enumerate(texts)], SCHEMA))
        found = collections.defaultdict(set)
        for r in index.matches(["否定", "否定之", "定之否定", "人工智能", "是否", "定"], None).collect():
            found[r["query"]].add((r["ordinal"], r["tf"]))
        assert found == {"否定": {(0, 2), (1, 1)}, "否定之": {(0, 1)}, "定之否定": {(0, 1)}, "人工智能": {(3, 1)}, "是否": {(1, 1)}}


def test_dates_titles_snippets_and_redaction(spark):
    long = "start " * 20 + "see https://example.com/?token=abc then the   needle\nis here " + "tail " * 40
    rows = [(1, 0, 5, 9, long), (2, 0, 5, 9, "needle; cookie: abc12 and so on"), (3, 0, 5, 9, "needle")]
    facts = spark.createDataFrame([(1, "first", 100), (2, "second", 200), (3, "third", None)], "transcript_id long, title string, pubdate long")
    with Scratch(spark) as s:
        index = SearchIndex(spark, s.path("index"))
        index.append(spark.createDataFrame(rows, SCHEMA))
        got = {r["transcript_id"]: r for r in index.search(["needle"], 5, facts, since=100, until=200).collect()}
        assert set(got) == {1} and got[1]["title"] == "first" and got[1]["start_ms"] == 5
        assert got[1]["snippet"].startswith("...") and got[1]["snippet"].endswith("...") and "needle is here" in got[1]["snippet"] and "example.com" not in got[1]["text"]
        every = {r["transcript_id"]: r["snippet"] for r in index.search(["needle"], 5, facts).collect()}
        assert every[2] == "needle; [redacted] and so on" and every[3] == "needle"
        with pytest.raises(ValueError):
            index.search(["needle"], since=1)


def test_strings_become_words_and_phrases():
    assert phrases_of('a "b c" d') == ["a", "b c", "d"]
    assert phrases_of('a "b c') == ['a "b c'] and phrases_of(' "" ') == []
