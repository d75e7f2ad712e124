"""Joins and runs of time intervals.

Overlaps are joined on the recording first; a recording that holds very many segments is cut into time buckets,
so no task compares all of its pairs, and a pair that meets in several buckets is kept in its first only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.dialect import relation

#: Milliseconds of a time bucket.
BUCKET_MS = 60_000


def overlap_join(left: DataFrame, right: DataFrame, key: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """All pairs of one key that overlap; columns are prefixed with l_ and r_, but the key."""

    def dealt(df: DataFrame, p: str) -> DataFrame:
        df = df.select(F.col(key), *[F.col(c).alias(p + c) for c in df.columns if c != key])
        buckets = F.sequence(F.floor(F.col(p + "start_ms") / bucket_ms), F.floor((F.col(p + "end_ms") - 1) / bucket_ms))
        return df.where(F.col(p + "end_ms") > F.col(p + "start_ms")).withColumn("bucket", F.explode(buckets))

    both = dealt(left, "l_").join(dealt(right, "r_"), [key, "bucket"])
    overlap = (F.col("r_start_ms") < F.col("l_end_ms")) & (F.col("r_end_ms") > F.col("l_start_ms"))
    first = F.col("bucket") == F.floor(F.greatest("l_start_ms", "r_start_ms") / bucket_ms)
    return both.where(overlap & first).drop("bucket")


def best_overlap(left: DataFrame, right: DataFrame, key: str, entry: str) -> DataFrame:
    """Each right entry with the left span it overlaps most; ties go to the earliest span."""
    pairs = overlap_join(left, right, key).withColumn("overlap_ms", F.least("l_end_ms", "r_end_ms") - F.greatest("l_start_ms", "r_start_ms"))
    order = Window.partitionBy(key, f"r_{entry}").orderBy(F.desc("overlap_ms"), F.asc("l_start_ms"), F.asc("l_ordinal"))
    return pairs.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def blocks(segments: DataFrame, key: str, gap_ms: int = 1500, last_ms: int = 12_000) -> DataFrame:
    """Runs of segments that a gap over ``gap_ms`` from the previous segment's end parts; a block ends where the next begins."""
    order = Window.partitionBy(key).orderBy("ordinal")
    apart = F.col("start_ms") - F.lag("end_ms").over(order) > gap_ms
    out = segments.withColumn("cut", F.when(apart, 1).otherwise(0)).withColumn("block", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.groupBy(key, "block").agg(F.min_by("start_ms", "ordinal").alias("start_ms"), F.max("end_ms").alias("last_end"), F.count("*").alias("cues"))
    following = F.lead("start_ms").over(Window.partitionBy(key).orderBy("block"))
    return out.withColumn("end_ms", F.coalesce(following, F.greatest(F.col("last_end"), F.col("start_ms") + last_ms))).withColumnRenamed("block", "ordinal")


def _captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "segments").select("transcript_id", "ordinal", "start_ms", "end_ms")


def _shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.col("start_ms") + 700
    return _captions(spark, sf_dir).where("ordinal % 2 = 0").select("transcript_id", "ordinal", moved.alias("start_ms"), (moved + 1800).alias("end_ms"))


def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-10."""
    return overlap_join(_captions(spark, sf_dir), _shifted(spark, sf_dir), "transcript_id").select("transcript_id", "l_ordinal", "r_ordinal")


def best_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-11."""
    return best_overlap(_captions(spark, sf_dir), _shifted(spark, sf_dir), "transcript_id", "ordinal").select("transcript_id", "r_ordinal", "l_ordinal", "overlap_ms")


def aligned_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-09 and ST-07: blocks of cues, and how many captions fall to each."""
    block = blocks(_captions(spark, sf_dir), "transcript_id")
    taken = best_overlap(block, _shifted(spark, sf_dir), "transcript_id", "ordinal").groupBy("transcript_id", F.col("l_ordinal").alias("ordinal")).agg(F.count("*").alias("captions"))
    out = block.join(taken, ["transcript_id", "ordinal"], "left")
    return out.select("transcript_id", F.col("ordinal").alias("block"), "start_ms", "end_ms", "cues", F.coalesce("captions", F.lit(0).cast("long")).alias("captions"))


_BASE = "a AS (SELECT transcript_id, ordinal, start_ms, end_ms FROM segments), b AS (SELECT transcript_id, ordinal, start_ms + 700 AS start_ms, start_ms + 2500 AS end_ms FROM segments WHERE ordinal % 2 = 0)"
_BLOCKS = """runs_of AS (SELECT *, sum(CASE WHEN start_ms - before_end > 1500 THEN 1 ELSE 0 END) OVER (PARTITION BY transcript_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block FROM (SELECT *, lag(end_ms) OVER (PARTITION BY transcript_id ORDER BY ordinal) AS before_end FROM a)),
  g AS (SELECT transcript_id, block, arg_min(start_ms, ordinal) AS start_ms, max(end_ms) AS last_end, count(*) AS cues FROM runs_of GROUP BY transcript_id, block),
  k AS (SELECT transcript_id, block AS ordinal, start_ms, cues, coalesce(lead(start_ms) OVER (PARTITION BY transcript_id ORDER BY block), greatest(last_end, start_ms + 12000)) AS end_ms FROM g)"""
_JOINED = "x.transcript_id = y.transcript_id AND y.start_ms < x.end_ms AND y.end_ms > x.start_ms AND x.end_ms > x.start_ms"
_BEST = "SELECT x.transcript_id, y.ordinal AS r_ordinal, x.ordinal AS l_ordinal, least(x.end_ms, y.end_ms) - greatest(x.start_ms, y.start_ms) AS overlap_ms, row_number() OVER (PARTITION BY y.transcript_id, y.ordinal ORDER BY least(x.end_ms, y.end_ms) - greatest(x.start_ms, y.start_ms) DESC, x.start_ms, x.ordinal) AS nth FROM {} AS x JOIN b AS y ON " + _JOINED
QUERIES = {"J-10_overlap_pairs": overlap_pairs, "J-11_best_overlap": best_assignment, "T-09_route_alignment": aligned_routes}
ORACLES = {
    "J-10_overlap_pairs": f"WITH {_BASE} SELECT x.transcript_id, x.ordinal AS l_ordinal, y.ordinal AS r_ordinal FROM a AS x JOIN b AS y ON {_JOINED}",
    "J-11_best_overlap": f"WITH {_BASE} SELECT transcript_id, r_ordinal, l_ordinal, overlap_ms FROM ({_BEST.format('a')}) AS w WHERE nth = 1",
    "T-09_route_alignment": f"WITH {_BASE}, {_BLOCKS}, t AS (SELECT transcript_id, l_ordinal, count(*) AS captions FROM ({_BEST.format('k')}) AS w WHERE nth = 1 GROUP BY transcript_id, l_ordinal) SELECT k.transcript_id, k.ordinal AS block, k.start_ms, k.end_ms, k.cues, coalesce(t.captions, 0) AS captions FROM k LEFT JOIN t ON k.transcript_id = t.transcript_id AND k.ordinal = t.l_ordinal",
}
