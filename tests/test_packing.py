"""Batches of connected copies against a plain walk."""

import random

import pytest

from tessera.operators.packing import Policy, batch
from tessera.sources.scratch import Scratch


def by_hand(copies, references, p):
    """Components by repeated union; then one at a time, each object paid for once."""
    groups = {}
    for obj, group in references:
        groups.setdefault(obj, set()).add(group)
    left, parts = {c[0]: c for c in copies}, []
    while left:
        first = min(left)
        part, seen = {first}, set(groups.get(left[first][1], ()))
        while True:
            more = {k for k, c in left.items() if k not in part and groups.get(c[1], set()) & seen}
            if not more:
                break
            part |= more
            for k in more:
                seen |= groups[left[k][1]]
        parts.append([left.pop(k) for k in sorted(part)])
    parts = [x for x in parts if all(c[3] <= p.now - p.least_age for c in x)]
    parts.sort(key=lambda x: (-sum(c[2] for c in x) if p.priority == "largest" else min(c[3] for c in x), min(c[0] for c in x)))
    taken, total, objects = set(), 0, set()
    for part in parts:
        incoming = {c[1]: c[2] for c in part}
        added = sum(size for o, size in incoming.items() if o not in objects)
        if total + added > p.batch_bytes or len(objects | set(incoming)) > p.batch_objects:
            continue
        taken |= {(c[0], c[1], part[0][0]) for c in part}
        total, objects = total + added, objects | set(incoming)
    return taken


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("priority", ["largest", "oldest"])
def test_batches_are_those_of_a_walk(spark, seed, priority):
    rng = random.Random(seed)
    objects = {o: rng.randrange(1, 100) for o in range(60)}
    # Lone copies of one object share its time, so that their order is that of the walk.
    made = {o: rng.randrange(0, 1000) for o in objects}
    references = [(o, rng.randrange(0, 40)) for o in objects if o % 3 for _ in range(rng.randrange(1, 3))]
    tied = {o for o, _ in references}
    copies = [(100 * o + t, o, objects[o], made[o] if o not in tied else rng.randrange(0, 1000)) for o in objects for t in range(rng.randrange(0, 3))]
    policy = Policy(1000, rng.choice([0, 100]), priority, rng.choice([150, 600, 5000]), rng.choice([3, 12, 100]))
    with Scratch(spark) as s:
        got = batch(s, spark.createDataFrame(copies, "copy_id long, object_id long, byte_size long, modified long"), spark.createDataFrame(references, "object_id long, group_id long"), policy).collect()
    assert {(r["copy_id"], r["object_id"], r["component"]) for r in got} == by_hand(copies, references, policy)


def test_a_young_copy_keeps_its_group_back_and_a_full_batch_goes_on(spark):
    copies = [(1, 1, 50, 0), (2, 2, 40, 990), (3, 3, 30, 0), (4, 4, 60, 0), (5, 5, 10, 0)]
    references = [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)]
    with Scratch(spark) as s:
        got = batch(s, spark.createDataFrame(copies, "copy_id long, object_id long, byte_size long, modified long"), spark.createDataFrame(references, "object_id long, group_id long"), Policy(1000, 100, "largest", 75, 5)).collect()
    assert {r["copy_id"] for r in got} == {4, 5}
    with pytest.raises(ValueError):
        Policy(0, priority="newest")
