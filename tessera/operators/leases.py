"""Job leases with fencing: a fold of an event log, in batches and as a stream whose timers end leases.

An event is a claim, a renewal, an end (succeeded or failed), a new request that supersedes the one in work, or a cancellation.  A claim of a queued
job gives its worker a lease and the next fencing number; later ends and renewals count only from that worker, with that number, before the lease is over.  A job that
is superseded while running goes back to the queue when it succeeds.  ``Lease.after`` is the one rule, of one event at a time; ``fold`` applies it to whole logs, and
``LeaseProcessor`` to a stream, where a timer ends a lease although no further event of its job comes.

``fold`` sorts the log by job and order, and goes through each partition as a stream that carries the state of one job, so neither a job nor a partition is held.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tessera.plans.dialect import relation
from tessera.sources.scratch import Scratch
from tessera.streaming.jobs import run_available

#: Seconds of a lease.
LEASE = 900

EVENTS = ["job_id", "seq", "happened", "kind", "worker", "fence"]
STEPS = "job_id long, seq long, verdict string, ended string, status string, owner long, fence long, expires long"
ENDED = "job_id long, fence long, expires long"


@dataclass(frozen=True)
class Lease:
    """A job's state: ``request`` counts requests, ``started`` is the one that the running attempt is for."""

    status: str = "queued"
    owner: int | None = None
    fence: int = 0
    expires: int | None = None
    request: int = 0
    started: int = 0

    def over(self, at: int) -> bool:
        return self.status == "running" and self.expires <= at

    def queued(self) -> Lease:
        return replace(self, status="queued", owner=None, expires=None)

    def after(self, kind: str, at: int, worker: int | None, fence: int | None, seconds: int) -> tuple[Lease, str]:
        """The state after an event, and its verdict; a lease that is over by then has ended first."""
        now = self.queued() if self.over(at) else self
        held = now.status == "running" and now.owner == worker and (fence is None or fence == now.fence)
        if now.status == "cancelled":
            return now, "cancelled"
        if kind == "claim":
            if now.status != "queued":
                return now, "not queued"
            return replace(now, status="running", owner=worker, fence=now.fence + 1, expires=at + seconds, started=now.request), "claimed"
        if kind == "renew":
            return (replace(now, expires=at + seconds), "renewed") if held else (now, "lease lost")
        if kind in ("succeeded", "failed"):
            if not held:
                return now, "lease lost"
            if kind == "succeeded" and now.request != now.started:
                return now.queued(), "requeued"
            return replace(now.queued(), status=kind), kind
        if kind == "supersede":
            now = replace(now, request=now.request + 1)
            return (now.queued() if now.status in ("succeeded", "failed") else now), "superseded"
        if kind == "cancel":
            return replace(now.queued(), status="cancelled"), "cancelled"
        raise ValueError(f"no such event: {kind}")


def fold(log: DataFrame, seconds: int = LEASE) -> DataFrame:
    """For each event of (job_id, seq, happened, kind, worker, fence): its verdict, whether a lease had ended by then, and the job's state after it.

    A job's events are taken by (happened, seq).  ``ended`` is 'lease expired' or null.
    """
    schema = pa.schema([("job_id", pa.int64()), ("seq", pa.int64()), ("verdict", pa.string()), ("ended", pa.string()), ("status", pa.string()), ("owner", pa.int64()), ("fence", pa.int64()), ("expires", pa.int64())])

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, state = None, Lease()
        for batch in batches:
            out = []
            for job_id, seq, at, kind, worker, fence in zip(*(batch.column(c).to_pylist() for c in EVENTS), strict=True):
                if job_id != job:
                    job, state = job_id, Lease()
                ended = "lease expired" if state.over(at) else None
                state, verdict = state.after(kind, at, worker, fence, seconds)
                out.append((job_id, seq, verdict, ended, state.status, state.owner, state.fence, state.expires))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return log.select(*EVENTS).repartition("job_id").sortWithinPartitions("job_id", "happened", "seq").mapInArrow(steps, STEPS)


class LeaseProcessor(StatefulProcessor):
    """Gives a row for each lease that ends unrenewed and unfinished: by a later event of the job, or by the timer alone."""

    def __init__(self, seconds: int = LEASE):
        self.seconds = seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("lease", "status string, owner long, fence long, expires long, request long, started long")

    def _state(self) -> Lease:
        row = self.held.get() if self.held.exists() else None
        return Lease() if row is None else Lease(*row)

    def _put(self, before: Lease, after: Lease) -> None:
        if after.expires != before.expires:
            if before.expires is not None:
                self.handle.deleteTimer(before.expires * 1000)
            if after.expires is not None:
                self.handle.registerTimer(after.expires * 1000)
        self.held.update((after.status, after.owner, after.fence, after.expires, after.request, after.started))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = state = self._state()
        events = pd.concat(list(rows)).sort_values(["at_s", "seq"])
        ended = []
        for at, kind, worker, fence in zip(events.at_s, events.kind, events.worker, events.fence, strict=True):
            if state.over(at):
                ended.append((key[0], state.fence, state.expires))
            state, _ = state.after(kind, int(at), int(worker), None if pd.isna(fence) else int(fence), self.seconds)
        self._put(before, state)
        yield pd.DataFrame(ended, columns=["job_id", "fence", "expires"]).astype("int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._state()
        ended = []
        if state.over(expiredTimerInfo.getExpiryTimeInMs() // 1000):
            ended.append((key[0], state.fence, state.expires))
            self._put(replace(state, expires=None), state.queued())
        yield pd.DataFrame(ended, columns=["job_id", "fence", "expires"]).astype("int64")


def expired_leases(stream: DataFrame, seconds: int = LEASE, late: str = "0 seconds") -> DataFrame:
    """(job_id, fence, expires) of leases that end, from a stream of events; ``late`` is how far events may be out of order.

    The session's state store must be one with timers and typed state (RocksDB).
    """
    timed = stream.select("job_id", "seq", F.col("happened").alias("at_s"), F.timestamp_seconds("happened").alias("at"), "kind", "worker", "fence").withWatermark("at", late)
    return timed.groupBy("job_id").transformWithStateInPandas(LeaseProcessor(seconds), ENDED, "append", "eventtime")


class timed_state:
    """Sets the state store for streams that are started inside, and sets it back."""

    KEY, STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(self.KEY, None)
        self.spark.conf.set(self.KEY, self.STORE)

    def __exit__(self, *_) -> None:
        if self.before is None:
            self.spark.conf.unset(self.KEY)
        else:
            self.spark.conf.set(self.KEY, self.before)


# ----------------------------------------------------------------------------------------------- registered queries

#: In the driver's log events of a job are a day apart.
DAY_LEASE = 100_000


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-04 and M-05: each event's verdict by the log's fold."""
    return fold(relation(spark, sf_dir, "lease_log"), DAY_LEASE)


def lease_timers(spark: SparkSession, sf_dir: str, slices: int = 3) -> DataFrame:
    """ST-05: leases that ended, from the log as a stream of slices of time; the last ones end by their timers."""
    log = relation(spark, sf_dir, "lease_log").select(*EVENTS)
    first, last = log.agg(F.min("happened"), F.max("happened")).first()
    with Scratch(spark) as s, timed_state(spark):
        source, sink = s.path("source"), s.path("sink", keep=True)
        for k in range(slices):
            low, high = first + (last - first) * k // slices, first + (last - first) * (k + 1) // slices
            log.where((F.col("happened") >= low) & (F.col("happened") < high) | (F.lit(k == slices - 1) & (F.col("happened") == last))).write.mode("append").parquet(source)
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1_000_000).parquet(source)
        run_available(expired_leases(stream, DAY_LEASE), s, lambda frame, epoch: frame.write.mode("overwrite").parquet(f"{sink}/batch={epoch}"))
        return spark.read.schema(ENDED).parquet(sink).select("job_id", "fence", "expires")


_HELD = "now = 'running' AND owner = worker AND (asked IS NULL OR asked = fence)"
_FOLD = f"""WITH RECURSIVE numbered AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY happened, seq) AS k FROM lease_log),
    fold AS (SELECT job_id, 0::bigint AS k, NULL::bigint AS seq, '' AS verdict, NULL::varchar AS ended, 'queued' AS status, NULL::bigint AS owner, 0::bigint AS fence, NULL::bigint AS expires, 0::bigint AS request, 0::bigint AS started, NULL::bigint AS ended_at
    FROM (SELECT DISTINCT job_id FROM lease_log)
    UNION ALL SELECT job_id, k, seq, verdict, ended,
        CASE verdict WHEN 'claimed' THEN 'running' WHEN 'requeued' THEN 'queued' WHEN 'succeeded' THEN 'succeeded' WHEN 'failed' THEN 'failed' WHEN 'cancelled' THEN 'cancelled'
            WHEN 'superseded' THEN CASE WHEN now IN ('succeeded', 'failed') THEN 'queued' ELSE now END ELSE now END,
        CASE WHEN verdict = 'claimed' THEN worker WHEN now = 'running' AND verdict NOT IN ('requeued', 'succeeded', 'failed', 'cancelled') THEN owner END,
        CASE WHEN verdict = 'claimed' THEN fence + 1 ELSE fence END,
        CASE WHEN verdict IN ('claimed', 'renewed') THEN happened + {DAY_LEASE} WHEN now = 'running' AND verdict NOT IN ('requeued', 'succeeded', 'failed', 'cancelled') THEN expires END,
        CASE WHEN verdict = 'superseded' THEN request + 1 ELSE request END, CASE WHEN verdict = 'claimed' THEN request ELSE started END, CASE WHEN ended IS NOT NULL THEN expires END
    FROM (SELECT *, CASE WHEN now = 'cancelled' OR kind = 'cancel' THEN 'cancelled' WHEN kind = 'supersede' THEN 'superseded' WHEN kind = 'claim' THEN CASE WHEN now = 'queued' THEN 'claimed' ELSE 'not queued' END
            WHEN NOT coalesce({_HELD}, FALSE) THEN 'lease lost' WHEN kind = 'renew' THEN 'renewed' WHEN kind = 'succeeded' AND request <> started THEN 'requeued' ELSE kind END AS verdict
        FROM (SELECT f.job_id, e.k, e.seq, e.happened, e.kind, e.worker, e.fence AS asked, f.owner, f.fence, f.expires, f.request, f.started,
            CASE WHEN f.status = 'running' AND f.expires <= e.happened THEN 'queued' ELSE f.status END AS now, CASE WHEN f.status = 'running' AND f.expires <= e.happened THEN 'lease expired' END AS ended
            FROM fold AS f JOIN numbered AS e ON e.job_id = f.job_id AND e.k = f.k + 1) AS x) AS y) """
QUERIES = {"M-04_claims": claims, "ST-05_lease_timers": lease_timers}
ORACLES = {
    "M-04_claims": _FOLD + "SELECT job_id, seq, verdict, ended, status, owner, fence, expires FROM fold WHERE k > 0",
    "ST-05_lease_timers": _FOLD + """SELECT job_id, CASE WHEN verdict = 'claimed' THEN fence - 1 ELSE fence END AS fence, ended_at AS expires FROM fold WHERE ended IS NOT NULL
        UNION ALL SELECT job_id, fence, expires FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY k DESC) AS back FROM fold) WHERE back = 1 AND status = 'running' AND expires <= (SELECT max(happened) FROM lease_log)""",
}
