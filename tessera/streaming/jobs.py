"""Incremental forms: file-source streams that end when their input does, with checkpoints in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.plans.dialect import relation
from tessera.sources.scratch import Scratch


def _events(spark: SparkSession, s: Scratch, sf_dir: str, files: int = 4, twice: bool = False) -> DataFrame:
    """The events as a stream of a few files, one a micro-batch; ``twice``: each row is in two of them."""
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = s.path("source")
    for shift in range(1 + twice):
        batch.withColumn("f", (F.col("event_id") + shift) % files).repartition(files, "f").drop("f").write.mode("append").parquet(path)
    return spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run_available(stream: DataFrame, s: Scratch, each, mode: str = "append") -> None:
    """Runs ``each(frame, epoch)`` over what is there, and ends."""
    at = s.path(f"checkpoint-{uuid.uuid4().hex}")
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", at).trigger(availableNow=True).start()
    query.awaitTermination()


def deduplicated(stream: DataFrame, key: str, at: str, keep: str) -> DataFrame:
    """The first row of each key, by state alone: a key is held until ``keep`` has passed since its first row, and then forgotten.

    Neither the sink nor earlier batches are read, and the state is bounded by the keys of that span.
    """
    return stream.withWatermark(at, keep).dropDuplicatesWithinWatermark([key])


def by_epoch(sink: str):
    """A sink for ``foreachBatch`` in which a repeated micro-batch replaces what it wrote before."""
    return lambda frame, epoch: frame.write.mode("overwrite").parquet(f"{sink}/batch={epoch}")


#: How long the log's keys are held: longer than the driver's log is.
KEPT = "3650 days"


def append_once(spark: SparkSession, sf_dir: str, twice: bool = False) -> DataFrame:
    """ST-01: rows are appended once per key; ST-04 has every row twice in its source, in files of different micro-batches."""
    with Scratch(spark) as s:
        sink = s.path("sink", keep=True)
        stream = _events(spark, s, sf_dir, twice=twice).select(F.concat_ws(":", "user_id", "event_type").alias("dedupe_key"), F.col("ts").cast("timestamp").alias("ts"))
        run_available(deduplicated(stream, "dedupe_key", "ts", KEPT).select("dedupe_key"), s, by_epoch(sink))
        return spark.read.schema("dedupe_key string").parquet(sink).select("dedupe_key")


def index_stream(spark: SparkSession, sf_dir: str, files: int = 3) -> DataFrame:
    """ST-01: segments that arrive in files go into a search index, one committed segment of it for each micro-batch; its blocks."""
    from tessera.operators.search import BLOCKS, SearchIndex

    segments = relation(spark, sf_dir, "segments").select("transcript_id", "ordinal", "start_ms", "end_ms", "text")
    with Scratch(spark) as s:
        source, index = s.path("source"), SearchIndex(spark, s.path("index", keep=True))
        segments.withColumn("f", F.pmod("transcript_id", F.lit(files))).repartition(files, "f").drop("f").write.parquet(source)
        stream = spark.readStream.schema(segments.schema).option("maxFilesPerTrigger", 1).parquet(source)
        run_available(stream, s, lambda frame, epoch: index.append(frame, f"epoch-{epoch}"))
        return spark.read.schema(BLOCKS).parquet(*[f"{c['folder']}/blocks" for c in index.commits()]).select("transcript_id", "ordinal", "start_ms")


def _latest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps (order, value); what is older than that changes nothing, however late it comes."""
    order, value = state.get if state.exists else (-1, "")
    for df in frames:
        row = df.loc[df.event_id.idxmax()]
        if int(row.event_id) > order:
            order, value = int(row.event_id), str(row.event_type)
    state.update((order, value))
    yield pd.DataFrame({"user_id": [key[0]], "seq": [order], "state": [value]})


def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-02 and ST-03: the newest event per user, kept in state; late rows never replace newer ones."""
    with Scratch(spark) as s:
        sink = s.path("sink", keep=True)
        stream = _events(spark, s, sf_dir).select("user_id", "event_id", "event_type")
        out = stream.groupBy("user_id").applyInPandasWithState(_latest, "user_id long, seq long, state string", "seq long, state string", "update", GroupStateTimeout.NoTimeout)
        run_available(out, s, lambda frame, epoch: frame.write.mode("overwrite").parquet(f"{sink}/batch={epoch}"), "update")
        changes = spark.read.schema("user_id long, seq long, state string").parquet(sink)
        return changes.groupBy("user_id").agg(F.max("seq").alias("seq"), F.max_by("state", "seq").alias("state"))


def lease_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-05: leases by the gap to the next heartbeat; as a stream this is a processing-time timeout."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    following = F.lead("at").over(Window.partitionBy("user_id").orderBy("at", "event_id"))
    return events.select("event_id", (F.coalesce(following, F.col("at") + 86400) - F.col("at") > 3600).alias("expired"))


def windowed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-06: durations cut at whole days and summed per day by a streaming aggregate."""
    with Scratch(spark) as s:
        sink = s.path("sink", keep=True)
        stream = _events(spark, s, sf_dir)
        start = F.unix_seconds(F.col("ts").cast("timestamp"))
        spans = stream.select(start.alias("a"), (start + F.floor("value")).alias("b")).withColumn("day", F.explode(F.sequence(F.floor(F.col("a") / 86400), F.floor(F.col("b") / 86400))))
        part = F.least("b", (F.col("day") + 1) * 86400) - F.greatest("a", F.col("day") * 86400)
        out = spans.groupBy("day").agg(F.sum(part).alias("seconds"))
        run_available(out, s, lambda frame, epoch: frame.write.mode("overwrite").parquet(f"{sink}/batch={epoch}"), "complete")
        each = spark.read.schema("day long, seconds long, batch int").parquet(sink)
        return each.groupBy("day").agg(F.max_by("seconds", "batch").alias("seconds"))


QUERIES = {"ST-01_append_once": append_once, "ST-01_index_stream": index_stream, "ST-04_dedupe_once": lambda spark, d: append_once(spark, d, twice=True), "ST-02_latest_state": latest_state, "ST-03_late_rows": latest_state, "ST-05_lease_expiry": lease_expiry, "ST-06_windowed_spans": windowed_spans}
_ONCE = "SELECT DISTINCT concat(user_id, ':', event_type) AS dedupe_key FROM events"
_LATEST = "SELECT user_id, max(event_id) AS seq, arg_max(event_type, event_id) AS state FROM events GROUP BY user_id"
ORACLES = {
    "ST-01_append_once": _ONCE,
    "ST-04_dedupe_once": _ONCE,
    "ST-01_index_stream": "SELECT transcript_id, ordinal, start_ms FROM segments",
    "ST-02_latest_state": _LATEST,
    "ST-03_late_rows": _LATEST,
    "ST-05_lease_expiry": "SELECT event_id, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id), t + 86400) - t > 3600 AS expired FROM (SELECT user_id, event_id, EPOCH[ts] AS t FROM events)",
    "ST-06_windowed_spans": "SELECT day, SUM_INT[least(b, (day + 1) * 86400) - greatest(a, day * 86400)] AS seconds FROM (SELECT a, b, unnest(range(a // 86400, b // 86400 + 1)) AS day FROM (SELECT EPOCH[ts] AS a, EPOCH[ts] + WHOLE[value] AS b FROM events)) GROUP BY day",
}
