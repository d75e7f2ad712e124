"""Ranks over whole tables, without a window that holds one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.dialect import relation, spark_query
from tessera.sources.scratch import Scratch


def ranked(scratch: Scratch, df: DataFrame, order: list[Column], name: str = "rank_no", table: str = "ranked") -> DataFrame:
    """The rows with their rank from 1 by ``order``, which must tell all rows apart: a range sort, and the rows before each range from one count a range."""
    n = max(1, df.rdd.getNumPartitions())
    numbered = scratch.table(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__seq", F.monotonically_increasing_id()), table, keep=True).withColumn("__range", F.shiftright("__seq", 33))
    sizes = numbered.groupBy("__range").agg(F.count("*").alias("__n"), F.min("__seq").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("__range", (before - F.col("__first") + 1).alias("__shift"))  # a row for each range
    return numbered.join(F.broadcast(shifts), "__range").withColumn(name, (F.col("__seq") + F.col("__shift")).cast("long")).drop("__seq", "__range", "__shift")


def work_order(spark: SparkSession, sf_dir: str, limit: int | None = None) -> DataFrame:
    """L-01: parts in the order in which they are worked on: never attempted first, then by their newest attempt; all, or the first ``limit``."""
    parts = spark_query("SELECT p.part_id, p.video_code, p.page, a.last_at FROM parts AS p LEFT JOIN (SELECT part_id, max(finished) AS last_at FROM attempts GROUP BY part_id) AS a ON p.part_id = a.part_id WHERE p.status <> 'gone'")(spark, sf_dir)
    with Scratch(spark) as s:
        out = ranked(s, parts, [F.col("last_at").asc_nulls_first(), F.col("video_code").asc(), F.col("page").asc()]).select("part_id", "rank_no")
    return out if limit is None else out.where(F.col("rank_no") <= limit)


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-07: whether each run has more distinct parts than the run before it; the first one has."""
    runs = relation(spark, sf_dir, "attempts").groupBy("run_id").agg(F.count_distinct("part_id").alias("n"))
    with Scratch(spark) as s:
        rows = ranked(s, runs, [F.col("run_id").asc()])
    before = rows.select((F.col("rank_no") + 1).alias("rank_no"), F.col("n").alias("before_n"))
    return rows.join(before, "rank_no", "left").select("run_id", "n", F.coalesce(F.col("n") > F.col("before_n"), F.lit(True)).alias("progressed"))


QUERIES = {"L-01_work_order": work_order, "V-07_progress": progress}
ORACLES = {
    "L-01_work_order": "SELECT p.part_id, row_number() OVER (ORDER BY a.last_at NULLS FIRST, p.video_code, p.page) AS rank_no FROM parts AS p LEFT JOIN (SELECT part_id, max(finished) AS last_at FROM attempts GROUP BY part_id) AS a ON p.part_id = a.part_id WHERE p.status <> 'gone'",
    "V-07_progress": "SELECT run_id, n, coalesce(n > before_n, TRUE) AS progressed FROM (SELECT run_id, n, lag(n) OVER (ORDER BY run_id) AS before_n FROM (SELECT run_id, count(DISTINCT part_id) AS n FROM attempts GROUP BY run_id) AS c) AS w",
}
