"""Collocations against brute force and their SQL, and the minimal perfect hash."""

import collections
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.llm import op12_collocations as op12
from tessera.llm.minimal_hash import PerfectHash
from tessera.llm.scratch import Scratch

LOWER = {k: k + 32 for k in range(65, 91)}


def brute(rows, least=10, explained=50, top=2000):
    n, f = collections.Counter(), collections.defaultdict(collections.Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                f[lang].update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            cuts = [(10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            longer = [q for q in candidates if len(q) > len(p) and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1))] if len(p) == 2 else []
            if not any(100 * candidates[q] >= explained * a for q in longer):
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -score) for k, (score, a, p, left, right) in enumerate(sorted(found)[:top])]
    return out


def texts():
    rng = random.Random(5)
    words = ["the", "of", "New", "new", "york", "CITY", "é", "É", "a\xa0b", "\x1c", "x" * 5000, "ß", "\U0001f600"] + [f"w{k}" for k in range(60)]
    rows = []
    for k in range(200):
        body = "".join(rng.choice(words[: rng.choice((6, 13, 73))]) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b"]) for _ in range(rng.randrange(1, 60)))
        rows.append((body, rng.choice(["en", "en", "en", "de", None, "und", ""])))
    rows += [("new york city, " * 700, "en"), ("one two three " * 30_000, "de"), (None, "en"), ("", None), (None, None), (" \t. ,", "fr"), ("rare words only", "fr")]
    return rows + [("copied text of some words", "en")] * 25


def put(path, rows):
    columns = {"doc_id": range(len(rows)), "text": pa.array([r[0] for r in rows], pa.string()), "lang": pa.array([r[1] for r in rows], pa.string()), "key": [1] * len(rows), "salt": ["x"] * len(rows), "n": [2] * len(rows)}
    pq.write_table(pa.table(columns), path / "documents.parquet")
    return str(path)


def flat(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_query_is_brute_force_and_its_sql(spark, tmp_path):
    rows = texts()
    path, want = put(tmp_path, rows), flat(brute(rows))
    assert flat(op12.query(spark, path).collect()) == want
    con = duckdb.connect()
    con.read_parquet(path + "/documents.parquet").create_view("documents")
    assert flat(con.execute(op12.ORACLE_SQL).fetchall()) == want


@pytest.mark.parametrize(("bits", "shard_bits", "parts", "top"), [(4, 2, 3, 15), (22, 0, 130, 2000)])
def test_full_filters_shards_and_trees_change_nothing(spark, bits, shard_bits, parts, top):
    """Filters whose buckets are all full, several shards, few ranks, and more tasks than are added up at once."""
    rows = texts()
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(parts)
    with Scratch(spark) as s:
        got = op12.collocations(s, docs, least=5, explained=70, top=top, bits=bits, shard_bits=shard_bits).collect()
    assert flat(got) == flat(brute(rows, 5, 70, top))


def test_perfect_hash_is_minimal_and_refuses_others():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 70, 5000):
        keys = np.unique(rng.integers(-(1 << 63), 1 << 63, (n, 3), dtype=np.int64), axis=0)
        h = PerfectHash.unpack(PerfectHash.build(keys).pack())
        assert sorted(h.slots(keys).tolist()) == list(range(n))
        assert (h.stored[h.slots(keys)] == keys).all()
        assert (h.slots(rng.integers(0, 1 << 40, (3000, 3))) == -1).all()
    near = np.array([[1, 2, k] for k in range(300)] + [[1, k, 2] for k in range(300, 500)], np.int64)
    assert sorted(PerfectHash.build(near).slots(near).tolist()) == list(range(500))


def test_scores_beyond_64_bits(spark):
    """The score's numbers are decimals of 38 digits."""
    a, left, right = 3_000_000_000_000, 4_000_000_000_000, 3_000_000_000_001
    row = spark.sql(f"SELECT cast((cast(1000000 AS decimal(38,0)) * cast({a} AS decimal(38,0)) * cast({a} AS decimal(38,0))) div (cast({left} AS decimal(38,0)) * cast({right} AS decimal(38,0))) AS bigint) AS s").first()
    assert row["s"] == 10**6 * a * a // (left * right)


def test_columns_and_arrays_hash_alike(spark):
    keys = np.random.default_rng(2).integers(-(1 << 63), 1 << 63, (50, 3), dtype=np.int64)
    df = spark.createDataFrame([tuple(map(int, k)) for k in keys], "a long, b long, c long")
    got = {tuple(r)[:3]: r[3] for r in df.select("a", "b", "c", op12.blended(df.a, df.b, df.c)).collect()}
    assert [got[tuple(map(int, k))] for k in keys] == op12.blend(keys).view(np.int64).tolist()
