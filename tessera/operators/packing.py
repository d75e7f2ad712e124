"""Artifact copies chosen for one batch: whole connected groups, old enough, in order of priority, within two budgets.

Copies are connected through the groups that refer to their objects; a component is taken or left as a whole.  A component that holds a copy younger than the
least age is left.  The others are gone through in order (largest first, or oldest first); one that would pass the budget of bytes or of objects is skipped, and the next is
tried.  An object counts once, however many of its copies are in the batch.

Components are labelled on tables (``min_labels``), their sums are aggregates, and the choice reads only components that still fit, a bounded page of them at a time: budgets
only shrink, so what doesn't fit now never will.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.dialect import relation, relation_over
from tessera.sources.scratch import Scratch

from .graph import counted_join, min_labels

PRIORITIES = ("largest", "oldest")


@dataclass(frozen=True)
class Policy:
    """``least_age`` in seconds before ``now``; ``batch_bytes`` and ``batch_objects`` are the budgets."""

    now: int
    least_age: int = 0
    priority: str = "largest"
    batch_bytes: int = 1 << 40
    batch_objects: int = 1000

    def __post_init__(self) -> None:
        if self.priority not in PRIORITIES or self.batch_objects < 1:
            raise ValueError("a policy has a known priority and room for an object")


def components(scratch: Scratch, copies: DataFrame, references: DataFrame) -> DataFrame:
    """The candidate copies (copy_id, object_id, byte_size, modified) with their component, the smallest copy_id that is connected.

    ``references``: (object_id, group_id).  A copy whose object no group refers to is a component of its own.
    """
    references = scratch.table(references.select("object_id", "group_id").distinct(), "references")
    several = copies.groupBy("copy_id").agg(F.min("object_id").alias("low"), F.max("object_id").alias("high")).where("low <> high")
    # Where a copy is of one object, an object's copies are connected alike, and its first one stands for them in the graph.
    key = "object_id" if several.isEmpty() else "copy_id"
    nodes = counted_join(copies, references.select("object_id").distinct(), "object_id", "left_semi").groupBy(*dict.fromkeys([key, "object_id"])).agg(F.min("copy_id").alias("first"))
    nodes = scratch.table(nodes, "nodes")
    members = scratch.table(counted_join(nodes, references, "object_id").select("first", "group_id").distinct(), "members")
    stars = counted_join(members, members.groupBy("group_id").agg(F.min("first").alias("b")), "group_id").select(F.col("first").alias("a"), "b")
    labels = counted_join(nodes, min_labels(scratch, stars), F.col("first") == F.col("node")).select(key, "label").distinct()
    return counted_join(copies, labels, key, "left").withColumn("component", F.coalesce("label", "copy_id")).drop("label")


def units(scratch: Scratch, copies: DataFrame, references: DataFrame, policy: Policy) -> tuple[DataFrame, DataFrame]:
    """(members, units): the copies old enough with their unit, and each unit's bytes, objects and place in the order (rank, unit).

    A unit is a component; components of one copy each whose object is the same are one unit, since the first of them pays for all.
    """
    labelled = scratch.table(components(scratch, copies, references), "labelled")
    late = labelled.where(F.col("modified") > policy.now - policy.least_age).select("component").distinct()
    grown = labelled.join(late, "component", "left_anti")
    tied = references.select("object_id").distinct().withColumn("tied", F.lit(True))
    grown = grown.join(tied, "object_id", "left")
    firsts = grown.where("tied IS NULL").groupBy("object_id").agg(F.min("copy_id").alias("lone"))
    members = scratch.table(grown.join(firsts, "object_id", "left").withColumn("unit", F.when(F.col("tied").isNull(), F.col("lone")).otherwise(F.col("component"))).drop("lone", "tied"), "unit_members", keep=True)
    # A component's size is that of its copies, its cost that of its objects; in a unit of lone copies each copy is a component.
    lone = F.col("component") != F.col("unit")
    objects = members.groupBy("unit", "object_id").agg(F.max("byte_size").alias("cost"), F.sum("byte_size").alias("size"), F.max("byte_size").alias("one"), F.min("modified").alias("oldest"), F.bool_or(lone).alias("lone"))
    sums = objects.groupBy("unit").agg(F.sum("cost").alias("bytes"), F.count("*").alias("objects"), F.sum(F.when(F.col("lone"), F.col("one")).otherwise(F.col("size"))).alias("size"), F.min("oldest").alias("oldest"))
    rank = -F.col("size") if policy.priority == "largest" else F.col("oldest")
    return members, scratch.table(sums.select("unit", "bytes", "objects", rank.alias("rank")), "units")


def chosen_units(units_: DataFrame, policy: Policy) -> list[int]:
    """The units of the batch, at most as many as its objects.

    Pages hold at most as many units as objects still fit, and each page's first unit is taken, so there are no more pages than objects.
    """
    taken, bytes_left, objects_left, last = [], policy.batch_bytes, policy.batch_objects, None
    while objects_left > 0:
        fits = units_.where((F.col("bytes") <= bytes_left) & (F.col("objects") <= objects_left))
        if last is not None:
            fits = fits.where((F.col("rank") > last[0]) | ((F.col("rank") == last[0]) & (F.col("unit") > last[1])))
        page = fits.orderBy("rank", "unit").limit(max(64, objects_left)).collect()
        if not page:
            break
        for r in page:
            if r["bytes"] <= bytes_left and r["objects"] <= objects_left:
                taken.append(r["unit"])
                bytes_left, objects_left = bytes_left - r["bytes"], objects_left - r["objects"]
        last = (page[-1]["rank"], page[-1]["unit"])
    return taken


def batch(scratch: Scratch, copies: DataFrame, references: DataFrame, policy: Policy) -> DataFrame:
    """(copy_id, object_id, component, byte_size) of the copies chosen under ``policy``."""
    members, sums = units(scratch, copies, references, policy)
    taken = chosen_units(sums, policy)
    rows = copies.sparkSession.createDataFrame([(u,) for u in taken], "unit long")
    return members.join(F.broadcast(rows), "unit", "left_semi").select("copy_id", "object_id", "component", "byte_size")


# ----------------------------------------------------------------------------------------------- registered queries

#: The driver's replicas were verified until November 2001.
POLICIES = {"largest": Policy(1_005_000_000, 5_000_000, "largest", 200_000, 60), "oldest": Policy(1_005_000_000, 20_000_000, "oldest", 150_000, 50)}


def _packed(priority: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with Scratch(spark) as s:
            s.table(relation(spark, sf_dir, "replicas"), "replicas")
            copies, groups = (relation_over(spark, name, replicas=s.path("replicas")) for name in ("object_copies", "object_groups"))
            return s.table(batch(s, s.table(copies, "copies"), groups, POLICIES[priority]), "batch", keep=True)

    run.__doc__ = f"G-08: a batch of the {priority} copies."
    return run


def _sql(p: Policy) -> str:
    rank = "-sum(size)" if p.priority == "largest" else "min(oldest)"
    return f"""WITH RECURSIVE members AS (SELECT DISTINCT copy_id, group_id FROM object_copies JOIN object_groups ON object_copies.object_id = object_groups.object_id),
        reach AS (SELECT copy_id AS root, copy_id FROM members UNION SELECT r.root, b.copy_id FROM reach AS r JOIN members AS a ON a.copy_id = r.copy_id JOIN members AS b ON b.group_id = a.group_id),
        labelled AS (SELECT c.*, coalesce(l.component, c.copy_id) AS component, l.component IS NULL AS lone FROM object_copies AS c LEFT JOIN (SELECT copy_id, min(root) AS component FROM reach GROUP BY copy_id) AS l ON l.copy_id = c.copy_id),
        grown AS (SELECT * FROM labelled WHERE component NOT IN (SELECT component FROM labelled WHERE modified > {p.now - p.least_age})),
        placed AS (SELECT *, CASE WHEN lone THEN min(copy_id) OVER (PARTITION BY object_id, lone) ELSE component END AS unit FROM grown),
        objects AS (SELECT unit, object_id, max(byte_size) AS cost, CASE WHEN bool_or(lone) THEN max(byte_size) ELSE sum(byte_size) END AS size, min(modified) AS oldest FROM placed GROUP BY unit, object_id),
        ranked AS (SELECT unit, sum(cost) AS bytes, count(*) AS objects, row_number() OVER (ORDER BY {rank}, unit) AS k FROM objects GROUP BY unit),
        walk AS (SELECT 0::bigint AS k, NULL::bigint AS unit, FALSE AS taken, 0::hugeint AS bytes, 0::bigint AS objects UNION ALL
            SELECT r.k, r.unit, w.bytes + r.bytes <= {p.batch_bytes} AND w.objects + r.objects <= {p.batch_objects}, w.bytes + CASE WHEN w.bytes + r.bytes <= {p.batch_bytes} AND w.objects + r.objects <= {p.batch_objects} THEN r.bytes ELSE 0 END,
            w.objects + CASE WHEN w.bytes + r.bytes <= {p.batch_bytes} AND w.objects + r.objects <= {p.batch_objects} THEN r.objects ELSE 0 END FROM walk AS w JOIN ranked AS r ON r.k = w.k + 1)
        SELECT copy_id, object_id, component, byte_size FROM placed WHERE unit IN (SELECT unit FROM walk WHERE taken)"""


QUERIES = {f"G-08_batch_{p}": _packed(p) for p in PRIORITIES}
ORACLES = {f"G-08_batch_{p}": _sql(POLICIES[p]) for p in PRIORITIES}
