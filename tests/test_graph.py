from tessera.operators.graph import min_labels, transitive_closure
from tessera.operators.intervals import overlap_join
from tessera.sources.scratch import Scratch


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    with Scratch(spark) as s:
        out = transitive_closure(s, edges, spark.createDataFrame([(0, 1)], "seed long, node long"))
        assert {r["node"] for r in out.collect()} == {1, 2, 3, 4}


def test_labels_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 101)], "a long, b long")
    with Scratch(spark) as s:
        out = {r["node"]: r["label"] for r in min_labels(s, links).collect()}
    assert out == {k: 0 for k in range(31)} | {100: 100, 101: 100}


def test_overlap_join_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    make = lambda: [(k % 3, k, a := rng.randrange(300_000), a + rng.randrange(0, 90_000)) for k in range(60)]
    left, right = make(), make()
    schema = "key long, ordinal long, start_ms long, end_ms long"
    got = {(r["key"], r["l_ordinal"], r["r_ordinal"]) for r in overlap_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "key").collect()}
    want = {(a[0], a[1], b[1]) for a in left for b in right if a[0] == b[0] and a[3] > a[2] and b[3] > b[2] and b[2] < a[3] and b[3] > a[2]}
    assert got == want
