"""Graph queries from every row, against brute force on the smallest tables."""

import hashlib
import os
from collections import defaultdict

import pytest

from tessera.operators.graph import min_labels, transitive_closure
from tessera.plans.catalog import QUERIES
from tessera.plans.dialect import relation
from tessera.sources.scratch import Scratch

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def reach(edges, start):
    to, seen, front = edges, set(), [start]
    while front:
        for x in to[front.pop()]:
            if x not in seen:
                seen.add(x)
                front.append(x)
    return seen


def pairs(spark, name, *columns):
    return [tuple(r) for r in relation(spark, DATA, name).select(*columns).collect()]


def found(spark, name, *columns):
    out = [tuple(r) for r in QUERIES[name](spark, DATA).select(*columns).collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.fixture(scope="module")
def parts(spark):
    after = defaultdict(set)
    for job, needs in pairs(spark, "edges", "job_id", "needs"):
        after[needs].add(job)
    return {(x, part) for job, part in pairs(spark, "jobs", "job_id", "part_id") for x in {job} | reach(after, job)}


def test_all_parts_are_reached(spark, parts):
    assert found(spark, "G-02_reachable_parts", "job_id", "part_id") == parts


def test_downstream_state_of_all_parts(spark, parts):
    of = {j: (s, a) for j, s, a in pairs(spark, "jobs", "job_id", "status", "available")}
    jobs = defaultdict(list)
    for job, part in parts:
        jobs[part].append(of[job])
    want = {(p, len(x), any(s == "queued" for s, _ in x), max(a for _, a in x)) for p, x in jobs.items()}
    assert found(spark, "G-03_downstream_state", "part_id", "jobs_n", "live", "last_at") == want
    assert found(spark, "A-23_lateness_clock", "part_id", "last_at") == {(w[0], w[3]) for w in want}


def test_every_job_has_its_needs(spark):
    needs = defaultdict(set)
    for job, need in pairs(spark, "edges", "job_id", "needs"):
        needs[job].add(need)
    want = {(j, x) for (j,) in pairs(spark, "jobs", "job_id") for x in {j} | reach(needs, j)}
    assert found(spark, "G-06_dependency_closure", "root_id", "job_id") == want
    after = defaultdict(set)
    for job, xs in needs.items():
        for x in xs:
            after[x].add(job)
    jobs = {j for (j,) in pairs(spark, "jobs", "job_id")}
    assert found(spark, "U-03_recursive_union", "root_id", "job_id") == {(j, x) for j in jobs for x in reach(after, j)}


def test_copies_of_all_objects(spark):
    links = defaultdict(set)
    for o, t in pairs(spark, "replicas", "object_id", "target_id"):
        links[("o", o)].add(("t", t))
        links[("t", t)].add(("o", o))
    want = {(x[1], min(y[1] for y in reach(links, x) if y[0] == "o")) for x in list(links) if x[0] == "o"}
    assert found(spark, "G-08_copy_groups", "object_id", "component") == want


def test_all_publications_are_traced(spark):
    to = defaultdict(set)
    texts, audio = pairs(spark, "transcripts", "transcript_id", "part_id", "sha"), pairs(spark, "audio_links", "part_id", "audio_id")
    pubs = pairs(spark, "publications", "publication_id", "transcript_id")
    for p, t in pubs:
        to[f"publication:{p}"].add(f"transcript:{t}")
    for t, part, sha in texts:
        to[f"transcript:{t}"] |= {f"text:{sha}"} | {f"audio:{a}" for x, a in audio if x == part}
    of = {p: {hashlib.sha256(x.encode()).hexdigest() for x in reach(to, f"publication:{p}")} for p, _ in pubs}
    assert found(spark, "G-09_provenance", "publication_id", "node_sha") == {(p, x) for p, xs in of.items() for x in xs}
    want = {(p, len(x), hashlib.sha256(",".join(sorted(x)).encode()).hexdigest()) for p, x in of.items()}
    assert found(spark, "G-10_provenance_report", "publication_id", "nodes", "root") == want


def test_too_few_rounds_raise(spark):
    chain = [(k, k + 1) for k in range(30)]
    with Scratch(spark) as s:
        with pytest.raises(RuntimeError):
            transitive_closure(s, spark.createDataFrame(chain, "src long, dst long"), spark.createDataFrame([(0, 0)], "seed long, node long"), max_rounds=5)
        with pytest.raises(RuntimeError):
            min_labels(s, spark.createDataFrame(chain, "a long, b long"), max_rounds=3)


def test_long_chains_are_closed(spark):
    """Many more rounds than are kept apart, and a chain of 1,500 links."""
    chain = lambda n: [(k, k + 1) for k in range(n)]
    with Scratch(spark) as s:
        out = transitive_closure(s, spark.createDataFrame([*chain(40), (40, 20)], "src long, dst long"), spark.createDataFrame([(7, 0)], "seed long, node long"))
        assert sorted(r["node"] for r in out.collect()) == list(range(1, 41))
        labels = min_labels(s, spark.createDataFrame([(5000 - a, 5000 - b) for a, b in chain(1500)], "a long, b long"))
        assert {r["label"] for r in labels.collect()} == {3500} and labels.count() == 1501
