"""The trie of conversations against brute force, and its SQL."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
from corpora import write

from tessera.llm import op11_prefix_trie as op11
from tessera.llm.scratch import Scratch


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def rebuilt(rows):
    """The turns (role, text) of each rebuilt conversation."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    for turns in own.values():
        turns.sort()
    heads = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: [t[3:] for t in own.get(c - int(math.fmod(c, 20)), [])[: heads[c]] + own[c][heads[c] :]] for c in own}


def trie(turns):
    """Each node's row, by listing the members of every prefix."""
    members, children = collections.defaultdict(list), collections.defaultdict(list)
    for conv, its in turns.items():
        for depth in range(len(its) + 1):
            members[tuple(its[:depth])].append(conv)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved, out = {}, {}, []
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in children[path]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        saved[path] = (len(members[path]) - 1) * words + sum(saved[k] for k in children[path])
    for path, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(turns[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(convs), len(path), parent, len(convs), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations():
    rng = random.Random(3)
    rows = []
    for c in [*range(140), -7, -45, 10_000_000_000]:
        for turn in range(rng.randrange(1, 7)):
            rows.append((c, turn, ("user", "assistant")[turn % 2], f"turn {rng.randrange(3)} of some words"))
    rows += [(c, None, None, None) for c in (3, 20, 41)] + [(60, 1, "user", "a tie"), (60, 1, "user", "another tie"), (60, 1, "user", "a tie")]
    rows += [(300, t, "user", "") for t in range(3)] + [(c, t, "user", f"the same {t}") for c in range(400, 1700) for t in range(2)]
    rows += [(5000, t, "user", f"deep {t}") for t in range(300)] + [(1800 + c, 0, "user", "x y " * 20_000) for c in range(4)]
    rows += [(None, 0, "user", "of no conversation"), (None, None, None, None), (13, 9, "a", "bc"), (14, 9, "ab", "c")]
    rng.shuffle(rows)
    return rows


def flat(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_trie_is_that_of_brute_force_and_of_its_sql(spark, tmp_path):
    rows = conversations()
    path = write(tmp_path, conversations=rows)
    want = flat(trie(rebuilt(rows)))
    assert flat(op11.query(spark, path).collect()) == want
    assert any(r[3] > 1200 for r in want) and any(r[1] == 300 for r in want)
    few = [r for r in rows if r[0] != 5000 and (r[0] or 0) < 1800]
    con = duckdb.connect()
    con.read_parquet(write(tmp_path, conversations=few) + "/conversations.parquet").create_view("conversations")
    assert flat(con.execute(op11.ORACLE_SQL).fetchall()) == flat(trie(rebuilt(few)))


def test_one_conversation_and_turnless_ones(spark):
    """Turnless conversations end in the root; one conversation is a path below it."""
    with Scratch(spark) as s:
        turns = spark.createDataFrame([(7, d, bytes([d]), 5) for d in (1, 2)], "conv_id long, depth long, digest binary, words long")
        convs = spark.createDataFrame([(7, 2), (9, 0), (8, 0)], "conv_id long, size long")
        nodes, ends = op11.build(s, turns, convs)
        assert flat(nodes.collect()) == flat([(7, 0, None, 3, 1, 1, 0), (7, 1, 7, 1, 1, 1, 0), (7, 2, 7, 1, 0, 1, 0)])
        assert flat(ends.collect()) == flat([(7, 2, 7), (8, 0, 7), (9, 0, 7)])
        named = op11.with_turns(nodes, turns).where("depth = 2").collect()
        assert [(r["conv_id"], r["digest"]) for r in named] == [(7, b"\x02")]
        alone, _ = op11.build(s.__class__(spark), turns, convs.where("size > 0"))
        assert flat(alone.collect()) == flat([(7, 0, None, 1, 1, 1, 0), (7, 1, 7, 1, 1, 1, 0), (7, 2, 7, 1, 0, 1, 0)])


def test_ends_of_many_chunks(spark):
    """Negative ids come first, and a node's ids are hashed in order over all its chunks."""
    ids = [*range(-3000, 3000, 7), 1 << 40]
    ends = spark.createDataFrame([(c, 2, -3000) for c in ids] + [(5, 1, 5)], "conv_id long, depth long, node long")
    got = {(r["node"], r["depth"]): r["ends_sha256"] for r in op11.ids_sha256(ends).collect()}
    assert got == {(-3000, 2): hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), (5, 1): hashlib.sha256(b"5").hexdigest()}
