"""Streams whose micro-batches are cut short and run again."""

import os
import shutil

from tessera.operators.search import SearchIndex
from tessera.sources.scratch import Scratch
from tessera.streaming.jobs import by_epoch, deduplicated

SCHEMA = "key string, ts timestamp, n long"


def local(path):
    return path.removeprefix("file://")


def start(spark, source, each, checkpoint, of=lambda s: s):
    stream = of(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source))
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def put(spark, source, rows):
    spark.createDataFrame(rows, "key string, s long, n long").selectExpr("key", "timestamp_seconds(s) AS ts", "n").coalesce(1).write.mode("append").parquet(source)


def uncommitted(checkpoint):
    """Takes back the last micro-batch's commit, as if the driver had died before it."""
    commits = f"{local(checkpoint)}/commits"
    last = max((f for f in os.listdir(commits) if f.isdigit()), key=int)
    os.remove(f"{commits}/{last}")
    crc = f"{commits}/.{last}.crc"
    if os.path.exists(crc):
        os.remove(crc)


def test_a_repeated_batch_changes_nothing_and_the_sink_is_not_read(spark):
    with Scratch(spark) as s:
        source, sink, checkpoint = s.path("source"), s.path("sink"), s.path("checkpoint")
        once = lambda stream: deduplicated(stream, "key", "ts", "100 seconds")
        put(spark, source, [("a", 1000, 1), ("b", 1001, 2), ("a", 1002, 3)])
        start(spark, source, by_epoch(sink), checkpoint, once)
        put(spark, source, [("b", 1010, 4), ("c", 1011, 5)])
        start(spark, source, by_epoch(sink), checkpoint, once)
        held = lambda: sorted(r["key"] for r in spark.read.schema(SCHEMA).parquet(sink).collect())
        assert held() == ["a", "b", "c"]
        uncommitted(checkpoint)
        start(spark, source, by_epoch(sink), checkpoint, once)
        assert held() == ["a", "b", "c"]
        # Gone from the sink, but not from the state: what was seen stays seen while it is held.
        shutil.rmtree(local(sink))
        put(spark, source, [("a", 1050, 6), ("d", 1051, 7)])
        start(spark, source, by_epoch(sink), checkpoint, once)
        assert held() == ["d"]


def test_keys_are_forgotten_after_their_span(spark):
    with Scratch(spark) as s:
        source, sink, checkpoint = s.path("source"), s.path("sink"), s.path("checkpoint")
        once = lambda stream: deduplicated(stream, "key", "ts", "100 seconds")
        for rows in ([("a", 1000, 1)], [("z", 9000, 2)], [("a", 9001, 3)]):
            put(spark, source, rows)
            start(spark, source, by_epoch(sink), checkpoint, once)
        assert sorted(r["key"] for r in spark.read.schema(SCHEMA).parquet(sink).collect()) == ["a", "a", "z"]


def test_an_index_takes_each_micro_batch_once(spark):
    with Scratch(spark) as s:
        source, checkpoint, index = s.path("source"), s.path("checkpoint"), SearchIndex(spark, s.path("index"))
        each = lambda frame, epoch: index.append(frame.selectExpr("n AS transcript_id", "0 AS ordinal", "0 AS start_ms", "1 AS end_ms", "key AS text"), f"epoch-{epoch}")
        for rows in ([("one two", 1000, 2), ("two", 1000, 3)], [("two three", 1001, 1)]):
            put(spark, source, rows)
            start(spark, source, each, checkpoint)
        uncommitted(checkpoint)
        start(spark, source, each, checkpoint)
        assert len(index.commits()) == 2
        assert sorted(r["transcript_id"] for r in index.matches(["two"], None).collect()) == [1, 2, 3]
