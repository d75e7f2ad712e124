"""Leases: the rule, its fold over logs, and the stream whose timers end them."""

import random

import pytest

from tessera.operators.leases import EVENTS, Lease, expired_leases, fold, timed_state
from tessera.sources.scratch import Scratch
from tessera.streaming.jobs import run_available

#: The first event; a stream takes what happened at its first watermark, zero, for late.
START = 1000
SCHEMA = "job_id long, seq long, happened long, kind string, worker long, fence long"


def run(events, seconds=10):
    state, out = Lease(), []
    for kind, at, worker, fence in events:
        state, verdict = state.after(kind, at, worker, fence, seconds)
        out.append(verdict)
    return out, state


def test_a_late_owner_is_fenced_off():
    verdicts, state = run([("claim", 0, 1, None), ("claim", 5, 2, None), ("claim", 10, 2, None), ("succeeded", 11, 1, 1), ("succeeded", 12, 2, 1), ("succeeded", 13, 2, 2), ("succeeded", 14, 2, 2)])
    assert verdicts == ["claimed", "not queued", "claimed", "lease lost", "lease lost", "succeeded", "lease lost"]
    assert (state.status, state.fence, state.owner, state.expires) == ("succeeded", 2, None, None)


def test_renewals_hold_a_lease_and_end_with_it():
    verdicts, _ = run([("claim", 0, 1, None), ("renew", 9, 1, 1), ("renew", 18, 2, 1), ("renew", 19, 1, 1), ("failed", 18, 1, 1)])
    assert verdicts == ["claimed", "renewed", "lease lost", "lease lost", "lease lost"]


def test_superseded_work_goes_back_to_the_queue():
    verdicts, state = run([("claim", 0, 1, None), ("supersede", 1, 9, None), ("succeeded", 2, 1, 1), ("claim", 3, 1, None), ("succeeded", 4, 1, 2), ("supersede", 5, 9, None)])
    assert verdicts == ["claimed", "superseded", "requeued", "claimed", "succeeded", "superseded"] and state.status == "queued"
    verdicts, state = run([("claim", 0, 1, None), ("supersede", 1, 9, None), ("failed", 2, 1, 1)])
    assert verdicts[-1] == "failed"


def test_a_cancelled_job_stays_so():
    verdicts, state = run([("claim", 0, 1, None), ("cancel", 1, 9, None), ("succeeded", 2, 1, 1), ("claim", 3, 1, None), ("supersede", 4, 1, None)])
    assert verdicts == ["claimed"] + 4 * ["cancelled"] and state.status == "cancelled"
    with pytest.raises(ValueError):
        Lease().after("other", 0, 1, None, 10)


def log(seed, jobs=20, n=600):
    """Events in time order; job 0 has a third of them, and the last claims have no later event."""
    rng = random.Random(seed)
    kinds = ["claim"] * 5 + ["renew"] * 3 + ["succeeded", "failed", "supersede"]
    rows = [(0 if rng.random() < 0.3 else rng.randrange(jobs), k, START + 3 * k + rng.randrange(3), rng.choice(kinds), rng.randrange(2), rng.choice([None, None, 1, 2, 3])) for k in range(n)]
    return rows + [(jobs + k, n + k, START + 3 * n + k, "claim", 1, None) for k in range(3)] + [(jobs + 9, n + 9, START + 3 * n + 400, "claim", 1, None)]


def states(rows, seconds=40):
    """By hand: (verdicts by seq, leases that ended by the log's last event)."""
    verdicts, ended, state = {}, set(), {}
    for job, seq, at, kind, worker, fence in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        before = state.get(job, Lease())
        if before.over(at):
            ended.add((job, before.fence, before.expires))
        state[job], verdicts[seq] = before.after(kind, at, worker, fence, seconds)
    last = max(r[2] for r in rows)
    return verdicts, ended | {(j, s.fence, s.expires) for j, s in state.items() if s.over(last)}


def test_fold_goes_through_every_partition(spark):
    rows = log(1)
    got = fold(spark.createDataFrame(rows, SCHEMA).repartition(3), 40).collect()
    verdicts, ended = states(rows)
    assert {r["seq"]: r["verdict"] for r in got} == verdicts and len(got) == len(rows)
    assert fold(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r["ended"] for r in got} == {None, "lease expired"}


def test_timers_end_leases_also_after_a_restart(spark):
    """The log arrives in four slices of time; the stream stops after two and goes on from its checkpoint."""
    rows = log(2)
    _, want = states(rows)
    with Scratch(spark) as s, timed_state(spark):
        source, sink, checkpoint = s.path("source"), s.path("sink"), s.path("checkpoint")
        seen = []
        for half in (0, 1):
            for k in (2 * half, 2 * half + 1):
                part = [r for r in rows if min(3, (r[2] - START) * 4 // 1800) == k]
                spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
            query = expired_leases(stream.select(*EVENTS), 40).writeStream.option("checkpointLocation", checkpoint).option("path", sink).format("parquet").trigger(availableNow=True).start()
            query.awaitTermination()
            found = [tuple(r) for r in spark.read.parquet(sink).collect()]
            assert len(found) == len(set(found))
            seen.append(set(found))
        assert seen[0] < seen[1] == want
        assert any(job >= 20 for job, _, _ in want), "ended by a timer alone"
        assert not any(job == 29 for job, _, _ in want), "still held when the log ends"


def test_run_available_is_the_same(spark):
    rows = log(3)
    with Scratch(spark) as s, timed_state(spark):
        source, sink = s.path("source"), s.path("sink")
        spark.createDataFrame(rows, SCHEMA).write.parquet(source)
        run_available(expired_leases(spark.readStream.schema(SCHEMA).parquet(source), 40), s, lambda frame, epoch: frame.write.mode("overwrite").parquet(f"{sink}/batch={epoch}"))
        assert {tuple(r)[:3] for r in spark.read.parquet(sink).collect()} == states(rows)[1]
