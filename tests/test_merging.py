"""Merges with colliding keys against a walk over rows."""

import random

import pytest

from tessera.operators.merging import Table, merged, plan
from tessera.sources.scratch import Scratch

TABLES = [Table("owners", "id", ("name",)), Table("items", "id", (), {"owner": "owners"}), Table("steps", "id", (), {"item": "items", "after": "steps"}), Table("papers", "id", (), {"item": "items"}, frozen=True)]
COLUMNS = {"owners": ["id", "name", "note"], "items": ["id", "owner", "text"], "steps": ["id", "item", "after"], "papers": ["id", "item"]}
SCHEMAS = {"owners": "id long, name string, note string", "items": "id long, owner long, text string", "steps": "id long, item long, after long", "papers": "id long, item long"}


def by_hand(base, incoming):
    out, maps = {}, {}
    for t in TABLES:
        names = COLUMNS[t.name]
        held = {r[0]: r[1:] for r in base[t.name]}
        natural = {tuple(r[names.index(c)] for c in t.natural): r[0] for r in base[t.name] if t.natural and all(r[names.index(c)] is not None for c in t.natural)}
        top = max([0, *held, *(r[0] for r in incoming[t.name])])
        maps[t.name] = {}
        while True:
            fates = {}
            for row in incoming[t.name]:
                now = list(row)
                for column, parent in t.parents.items():
                    k = names.index(column)
                    now[k] = maps[parent].get(now[k], now[k])
                known = natural.get(tuple(now[names.index(c)] for c in t.natural)) if t.natural else None
                if known is not None:
                    how = "conflict" if held[known] != tuple(now[1:]) else "skipped" if known == row[0] else "mapped"
                    fates[row[0]] = (known, how)
                elif row[0] not in held:
                    fates[row[0]] = (row[0], "added")
                else:
                    fates[row[0]] = (row[0], "skipped") if held[row[0]] == tuple(now[1:]) else (row[0] + top + 1, "remapped")
                if t.frozen and (fates[row[0]][1] in ("mapped", "remapped") or now != list(row)):
                    fates[row[0]] = (fates[row[0]][0], "frozen")
            moved = {k: v for k, (v, _) in fates.items() if v != k}
            if moved == maps[t.name]:
                break
            maps[t.name] = moved
        out |= {(t.name, k): v for k, v in fates.items()}
    return out


def archives(seed, clean=False):
    rng = random.Random(seed)
    side = lambda: {
        "owners": [(k, f"name {k if clean else k + rng.choice([0, 0, 0, 40])}", rng.choice(["", None])) for k in range(rng.randrange(1, 12))],
        "items": [(k, rng.choice([None, *range(12)]), rng.choice("ab")) for k in range(20) if rng.random() < 0.7],
        "steps": [(k, rng.randrange(3), k - 1 if k and rng.random() < 0.9 else None) for k in range(40) if rng.random() < 0.9],
        "papers": [(k, rng.randrange(20)) for k in range(5)],
    }
    return side(), side()


def frames(spark, rows):
    return {n: spark.createDataFrame(r, SCHEMAS[n]) for n, r in rows.items()}


@pytest.mark.parametrize("seed", range(3))
def test_fates_are_those_of_a_walk(spark, seed):
    base, incoming = archives(seed)
    with Scratch(spark) as s:
        got = plan(s, TABLES, frames(spark, base), frames(spark, incoming)).collect()
    assert {(r["table_name"], r["old_id"]): (r["new_id"], r["how"]) for r in got} == by_hand(base, incoming)


def test_a_parent_that_moves_moves_equal_children_down_the_chain(spark):
    base = {"owners": [(1, "a", "")], "items": [(1, 1, "x")], "steps": [(1, 1, None), (2, 1, 1), (3, 1, 2), (4, 9, None)], "papers": []}
    incoming = {"owners": [(1, "b", "")], "items": [(1, 1, "x")], "steps": [(1, 1, None), (2, 1, 1), (3, 1, 2), (4, 9, None)], "papers": []}
    with Scratch(spark) as s:
        out = merged(s, TABLES, frames(spark, base), frames(spark, incoming))
        assert {tuple(r) for r in out["owners"].collect()} == {(1, "a", ""), (3, "b", "")}
        assert {tuple(r) for r in out["items"].collect()} == {(1, 1, "x"), (3, 3, "x")}
        assert {tuple(r) for r in out["steps"].collect()} == {*base["steps"], (6, 3, None), (7, 3, 6), (8, 3, 7)}


def test_merging_again_adds_nothing(spark):
    base = {"owners": [(1, "a", ""), (2, "b", None)], "items": [(1, 2, "x")], "steps": [], "papers": [(1, 1)]}
    with Scratch(spark) as s:
        out = merged(s, TABLES, frames(spark, base), frames(spark, base))
        assert {n: {tuple(r) for r in df.collect()} for n, df in out.items()} == {n: set(r) for n, r in base.items()}


def test_frozen_rows_and_conflicts_are_refused(spark):
    base = {"owners": [(1, "a", "")], "items": [(1, 1, "x")], "steps": [], "papers": [(1, 1)]}
    with Scratch(spark) as s, pytest.raises(ValueError, match="frozen rows in papers"):
        merged(s, TABLES, frames(spark, base), frames(spark, {**base, "items": [(1, 1, "y")]}))
    with Scratch(spark) as s, pytest.raises(ValueError, match="conflict rows in owners"):
        merged(s, TABLES, frames(spark, base), frames(spark, {**base, "owners": [(1, "a", "other")]}))
    with Scratch(spark) as s, pytest.raises(ValueError, match="before its parents"):
        plan(s, TABLES[1:], frames(spark, base), frames(spark, base))
