"""Closures against brute force on odd graphs, and without broadcasts of tables that were not counted."""

import random
from collections import defaultdict

import pytest

from tessera.operators import graph
from tessera.operators.graph import transitive_closure
from tessera.plans.catalog import QUERIES
from tessera.sources.scratch import Scratch

DATA = "/root/testdata/sf0.001"


def by_hand(edges, seeds):
    to = defaultdict(set)
    for a, b in edges:
        to[a].add(b)
    out = set()
    for seed, start in seeds:
        front = [start]
        while front:
            for x in to[front.pop()]:
                if (seed, x) not in out:
                    out.add((seed, x))
                    front.append(x)
    return out


@pytest.mark.parametrize("few", [0, 100_000])
@pytest.mark.parametrize("k", range(3))
def test_pairs_are_those_of_a_walk_and_come_once(spark, monkeypatch, k, few):
    """Cycles, starts that are reached again, nodes with several ways in, repeated edges and starts."""
    monkeypatch.setattr(graph, "FEW", few)
    rng = random.Random(k)
    edges = [(rng.randrange(20), rng.randrange(20)) for _ in range(24)] + [(30, 31), (31, 32), (32, 30), (7, 7)]
    edges += edges[:5]
    seeds = [(rng.randrange(3), rng.randrange(20)) for _ in range(6)] + [(1, 30), (1, 32), (2, 7), (2, 7)]
    want = by_hand(edges, seeds)
    with Scratch(spark) as s:
        frames = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(seeds, "seed long, node long")
        for n, (starts, result) in enumerate([(None, want), (True, want | set(seeds)), (False, want - set(seeds))]):
            got = [tuple(r) for r in transitive_closure(s, *frames, name=f"c{n}", starts=starts).collect()]
            assert len(got) == len(set(got))
            assert set(got) == result


def recorded(monkeypatch):
    """The plans of all tables that are written from now on."""
    plans, write = [], Scratch.table

    def table(self, df, name, keep=False):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(self, df, name, keep)

    monkeypatch.setattr(Scratch, "table", table)
    return plans


@pytest.mark.parametrize("name", ["G-02_reachable_parts", "G-03_downstream_state", "A-23_lateness_clock", "G-06_dependency_closure", "U-03_recursive_union", "G-01_blocked_by_cancelled"])
def test_written_tables_are_not_broadcast_by_the_size_of_their_files(spark, monkeypatch, name):
    monkeypatch.setattr(graph, "FEW", 0, raising=False)
    plans = recorded(monkeypatch)
    result = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert any("_new_" in at for at, _ in plans)
    assert not [at for at, plan in [*plans, ("result", result)] if "Broadcast" in plan and "_edges" not in at]
