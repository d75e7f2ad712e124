"""Closure and components on tables: cycle-safe, and without a node's links ever being gathered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.dialect import relation
from tessera.sources.scratch import Scratch


#: Rounds whose tables are kept apart before they are written as one.
ROUNDS_TOGETHER = 12
#: Rows, as counted, up to which a table is broadcast.
FEW = 100_000


def counted_join(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int | None = None) -> DataFrame:
    """A join that broadcasts the right side if its ``rows`` are few, and neither side otherwise: a written table of few MB can hold so many rows that they don't fit the driver."""
    if rows is not None and rows <= FEW:
        return left.join(F.broadcast(right), on, how)
    return left.hint("merge").join(right.hint("merge"), on, how)


def transitive_closure(scratch: Scratch, edges: DataFrame, seeds: DataFrame, name: str = "closure", max_rounds: int | None = None, starts: bool | None = None) -> DataFrame:
    """(seed, node): every node that is reached from each seed by one edge or more, each pair once.

    ``edges`` has (src, dst), ``seeds`` has (seed, node) where the walk starts; with ``starts`` these pairs are in the result whether reached or not, and with False none of
    them is.  Semi-naive: a round joins only the newest pairs with the edges, drops those seen before, and writes the rest as a table, so lineage stays short and cycles end.
    A pair goes on once, so one whose node has a single way in is found once; only pairs of other nodes, and the starts, are compared with those seen before.
    It goes on until nothing is new; where ``max_rounds`` is given and not enough, it raises.
    """
    pair = ["seed", "node"]
    ways = Window.partitionBy("dst")
    edges = scratch.table(edges.select("src", "dst").distinct().withColumn("several", F.count("*").over(ways) > 1), f"{name}_edges")
    own = scratch.table(seeds.select(pair).distinct(), f"{name}_starts", keep=True)
    n_own = n_front = own.count()
    front, rounds, seen, k = own, [], [], 0
    while True:
        if max_rounds is not None and k >= max_rounds:
            raise RuntimeError(f"{name}: not closed after {max_rounds} rounds")
        steps = counted_join(edges, front, F.col("node") == F.col("src"), rows=n_front).groupBy("seed", F.col("dst").alias("node")).agg(F.bool_or("several").alias("several"))
        if starts is None:
            new = counted_join(steps, own.withColumn("start", F.lit(True)), pair, "left", n_own).withColumn("start", F.coalesce("start", F.lit(False)))
        else:
            new = counted_join(steps, own, pair, "left_anti", n_own).withColumn("start", F.lit(False))
        for before, n_before in seen:
            new = counted_join(new, before, pair, "left_anti", n_before)
        found = scratch.table(new, f"{name}_new_{k}", keep=True)
        n, n_front, n_again = found.agg(F.count("*"), F.count_if(F.expr("NOT start")), F.count_if(F.expr("several OR start"))).first()
        if not n:
            break
        rounds.append(found.select(pair))
        front = found.where("NOT start").select(pair)
        if n_again:
            seen.append((found.where("several OR start").select(pair), n_again))
        if len(rounds) == 4 * ROUNDS_TOGETHER:
            rounds = [scratch.table(reduce(DataFrame.unionByName, rounds), f"{name}_until_{k}", keep=True)]
        if len(seen) == ROUNDS_TOGETHER:
            seen = [(scratch.table(reduce(DataFrame.unionByName, [t for t, _ in seen]), f"{name}_seen_{k}"), sum(m for _, m in seen))]
        k += 1
    return reduce(DataFrame.unionByName, [own, *rounds] if starts else rounds or [found.select(pair)])


def min_labels(scratch: Scratch, links: DataFrame, name: str = "labels", max_rounds: int | None = None) -> DataFrame:
    """(node, label): the smallest node of each component of the links (a, b); labels jump to their label's label in each round.

    It goes on until no label changes; where ``max_rounds`` is given and not enough, it raises."""
    both = scratch.table(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}_links")
    labels = scratch.table(both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("label")).withColumnRenamed("a", "node"), f"{name}_0")
    before, k, n = None, 0, labels.count()
    while True:
        k += 1
        if max_rounds is not None and k >= max_rounds:
            raise RuntimeError(f"{name}: labels still change after {max_rounds} rounds")
        near = counted_join(both, labels, both["b"] == labels["node"], rows=n).groupBy("a").agg(F.min("label").alias("near"))
        step = counted_join(labels, near, labels["node"] == near["a"], "left", n).select("node", F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = step.select(F.col("node").alias("of"), F.col("label").alias("jump"))
        labels = scratch.table(counted_join(step, jump, F.col("label") == F.col("of"), "left", n).select("node", F.least("label", F.coalesce("jump", "label")).alias("label")), f"{name}_{k}", keep=True)
        state = labels.agg(F.sum(F.col("label").cast("decimal(38,0)")), F.count("*")).first()
        if state == before:
            break
        before = state
    return labels


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a job to those that need it."""
    return relation(spark, sf_dir, "edges").select(F.col("needs").alias("src"), F.col("job_id").alias("dst"))


def blocked_by_cancelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-01: queued jobs that a cancelled one blocks, directly or through others."""
    jobs = relation(spark, sf_dir, "jobs")
    seeds = jobs.where("status = 'cancelled'").select(F.lit(0).alias("seed"), F.col("job_id").alias("node"))
    with Scratch(spark) as s:
        reached = transitive_closure(s, _edges(spark, sf_dir), seeds)
    return counted_join(jobs.where("status = 'queued'"), reached, F.col("job_id") == F.col("node"), "left_semi").select("job_id")


def reachable_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-02: every (job, part) where the job has the part or follows from one that has."""
    seeds = relation(spark, sf_dir, "jobs").select(F.col("part_id").alias("seed"), F.col("job_id").alias("node"))
    with Scratch(spark) as s:
        reached = transitive_closure(s, _edges(spark, sf_dir), seeds, starts=True)
    return reached.select(F.col("node").alias("job_id"), F.col("seed").alias("part_id"))


def downstream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-03 and A-23: per part the downstream jobs, whether one is live, and the latest time of any."""
    jobs = relation(spark, sf_dir, "jobs").select("job_id", "status", "available")
    out = counted_join(reachable_parts(spark, sf_dir), jobs, "job_id").groupBy("part_id")
    return out.agg(F.count("*").alias("jobs_n"), F.bool_or(F.col("status") == "queued").alias("live"), F.max("available").alias("last_at"))


def _roots(spark: SparkSession, sf_dir: str, roots: DataFrame | None) -> DataFrame:
    """(seed, node) of the jobs to start from: those of ``roots`` (job_id), or every job."""
    jobs = relation(spark, sf_dir, "jobs").select("job_id")
    jobs = jobs if roots is None else jobs.join(roots.select("job_id").distinct(), "job_id", "left_semi")
    return jobs.select(F.col("job_id").alias("seed"), F.col("job_id").alias("node"))


def dependency_closures(spark: SparkSession, sf_dir: str, roots: DataFrame | None = None) -> DataFrame:
    """G-06: each chosen job with itself and all jobs that it needs.

    From every job these are the pairs of those that follow, turned round: on that way most nodes have a single way in."""
    jobs = _roots(spark, sf_dir, roots)
    with Scratch(spark) as s:
        if roots is None:
            return transitive_closure(s, _edges(spark, sf_dir), jobs, starts=True).select(F.col("node").alias("root_id"), F.col("seed").alias("job_id"))
        needs = relation(spark, sf_dir, "edges").select(F.col("job_id").alias("src"), F.col("needs").alias("dst"))
        return transitive_closure(s, needs, jobs, starts=True).select(F.col("seed").alias("root_id"), F.col("node").alias("job_id"))


def dependents(spark: SparkSession, sf_dir: str, roots: DataFrame | None = None) -> DataFrame:
    """U-03: each chosen job with all jobs that follow from it; pairs are made once, however many ways lead there."""
    jobs = _roots(spark, sf_dir, roots)
    with Scratch(spark) as s:
        reached = transitive_closure(s, _edges(spark, sf_dir), jobs)
    return reached.select(F.col("seed").alias("root_id"), F.col("node").alias("job_id"))


def copy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-08: components of objects that share a target."""
    replicas = relation(spark, sf_dir, "replicas")
    stars = replicas.groupBy("target_id").agg(F.min("object_id").alias("b")).join(replicas, "target_id").select(F.col("object_id").alias("a"), "b")
    with Scratch(spark) as s:
        return min_labels(s, stars).select(F.col("node").alias("object_id"), F.col("label").alias("component"))


def provenance_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-09: everything a publication rests on, as content-hash nodes."""
    pubs, texts, audio = (relation(spark, sf_dir, n) for n in ("publications", "transcripts", "audio_links"))
    name = lambda kind, key: F.concat(F.lit(kind + ":"), F.col(key).cast("string"))
    edges = pubs.select(name("publication", "publication_id").alias("src"), name("transcript", "transcript_id").alias("dst"))
    edges = edges.unionByName(texts.select(name("transcript", "transcript_id").alias("src"), F.concat(F.lit("text:"), "sha").alias("dst")))
    edges = edges.unionByName(texts.join(audio, "part_id").select(name("transcript", "transcript_id").alias("src"), name("audio", "audio_id").alias("dst")))
    seeds = pubs.select(F.col("publication_id").alias("seed"), name("publication", "publication_id").alias("node"))
    with Scratch(spark) as s:
        return transitive_closure(s, edges, seeds).select(F.col("seed").alias("publication_id"), F.sha2("node", 256).alias("node_sha"))


def provenance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-10: how many nodes each traced publication rests on, and its sealed root."""
    each = provenance_edges(spark, sf_dir).groupBy("publication_id")
    return each.agg(F.count("*").alias("nodes"), F.sha2(F.array_join(F.array_sort(F.collect_set("node_sha")), ","), 256).alias("root"))


def chain_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-11: runs to delete: neither among the newest, nor recent, nor in the chain of one that stays."""
    runs = relation(spark, sf_dir, "runs")
    newest = runs.orderBy(F.desc("started"), F.desc("run_id")).limit(5).select("run_id")
    latest = runs.agg((F.max("started") - 86400).alias("cutoff"))
    kept = newest.union(runs.join(F.broadcast(latest), F.col("started") >= F.col("cutoff")).select("run_id")).distinct()
    base = runs.where("run_id % 4 <> 0").select(F.col("run_id").alias("src"), (F.col("run_id") - 1).alias("dst"))
    with Scratch(spark) as s:
        chain = transitive_closure(s, base, kept.select(F.lit(0).alias("seed"), F.col("run_id").alias("node"))).select(F.col("node").alias("run_id"))
    return runs.select("run_id").join(kept.union(chain), "run_id", "left_anti")


def key_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-07: merge of two archives: rows that are equal are skipped, colliding keys get new ones after the largest."""
    docs = relation(spark, sf_dir, "transcripts").select("transcript_id", "sha")
    ours, theirs = docs.where("transcript_id % 3 <> 1"), docs.select(F.floor(F.col("transcript_id") / 2).cast("long").alias("transcript_id"), "sha").where("transcript_id % 2 = 0")
    theirs = theirs.groupBy("sha").agg(F.min("transcript_id").alias("transcript_id"))
    new = theirs.join(ours.select("sha").distinct(), "sha", "left_anti")
    clash = new.join(ours.select("transcript_id"), "transcript_id", "left_semi")
    free = new.join(ours.select("transcript_id"), "transcript_id", "left_anti")
    taken = ours.select("transcript_id").union(new.select("transcript_id")).agg(F.max("transcript_id").alias("top"))
    # New keys only have to differ: they follow the clashing keys themselves.
    moved = clash.join(F.broadcast(taken)).select((F.col("top") + 1 + F.col("transcript_id")).alias("new_id"), "sha", F.lit("remapped").alias("how"))
    moved = moved.groupBy("sha", "how").agg(F.min("new_id").alias("new_id"))
    added = free.select("sha", F.lit("added").alias("how"), F.col("transcript_id").alias("new_id"))
    return added.unionByName(moved)


QUERIES = {
    "G-01_blocked_by_cancelled": blocked_by_cancelled,
    "G-02_reachable_parts": reachable_parts,
    "G-03_downstream_state": downstream_state,
    "A-23_lateness_clock": lambda spark, d: downstream_state(spark, d).select("part_id", "last_at"),
    "G-06_dependency_closure": dependency_closures,
    "G-07_key_remap": key_remap,
    "G-08_copy_groups": copy_groups,
    "G-09_provenance": provenance_edges,
    "G-10_provenance_report": provenance_report,
    "G-11_chain_retention": chain_retention,
    "U-03_recursive_union": dependents,
}
_PARTS = "WITH RECURSIVE reach AS (SELECT part_id, job_id FROM jobs UNION SELECT reach.part_id, edges.job_id FROM reach JOIN edges ON edges.needs = reach.job_id) "
_NEEDS = "WITH RECURSIVE reach AS (SELECT job_id AS root_id, job_id FROM jobs UNION SELECT reach.root_id, edges.needs AS job_id FROM reach JOIN edges ON edges.job_id = reach.job_id) "
_FOLLOW = "WITH RECURSIVE reach AS (SELECT edges.needs AS root_id, edges.job_id FROM edges JOIN jobs ON edges.needs = jobs.job_id UNION SELECT reach.root_id, edges.job_id FROM reach JOIN edges ON edges.needs = reach.job_id) "
_TRACE = """WITH RECURSIVE links AS (SELECT concat('publication:', publication_id) AS src, concat('transcript:', transcript_id) AS dst FROM publications UNION ALL SELECT concat('transcript:', transcript_id), concat('text:', sha) FROM transcripts UNION ALL SELECT concat('transcript:', t.transcript_id), concat('audio:', a.audio_id) FROM transcripts AS t JOIN audio_links AS a ON t.part_id = a.part_id),
  trace AS (SELECT publication_id, concat('publication:', publication_id) AS node, 0 AS depth FROM publications UNION SELECT trace.publication_id, links.dst, 1 FROM trace JOIN links ON links.src = trace.node) """
ORACLES = {
    "G-01_blocked_by_cancelled": "WITH RECURSIVE reach AS (SELECT job_id FROM jobs WHERE status = 'cancelled' UNION SELECT edges.job_id FROM reach JOIN edges ON edges.needs = reach.job_id), deep AS (SELECT DISTINCT edges.job_id FROM reach JOIN edges ON edges.needs = reach.job_id) SELECT job_id FROM jobs WHERE status = 'queued' AND job_id IN (SELECT job_id FROM deep)",
    "G-02_reachable_parts": _PARTS + "SELECT job_id, part_id FROM reach",
    "G-03_downstream_state": _PARTS + "SELECT r.part_id, count(*) AS jobs_n, bool_or(j.status = 'queued') AS live, max(j.available) AS last_at FROM reach AS r JOIN jobs AS j ON r.job_id = j.job_id GROUP BY r.part_id",
    "A-23_lateness_clock": _PARTS + "SELECT r.part_id, max(j.available) AS last_at FROM reach AS r JOIN jobs AS j ON r.job_id = j.job_id GROUP BY r.part_id",
    "G-06_dependency_closure": _NEEDS + "SELECT root_id, job_id FROM reach",
    "U-03_recursive_union": _FOLLOW + "SELECT root_id, job_id FROM reach",
    "G-09_provenance": _TRACE + "SELECT DISTINCT publication_id, SHA[node] AS node_sha FROM trace WHERE depth = 1",
    "G-10_provenance_report": _TRACE + "SELECT publication_id, count(*) AS nodes, SHA[string_agg(node_sha, ',' ORDER BY node_sha)] AS root FROM (SELECT DISTINCT publication_id, SHA[node] AS node_sha FROM trace WHERE depth = 1) GROUP BY publication_id",
    "G-11_chain_retention": "WITH RECURSIVE kept AS (SELECT run_id FROM (SELECT run_id FROM runs ORDER BY started DESC, run_id DESC LIMIT 5) UNION SELECT run_id FROM runs WHERE started >= (SELECT max(started) - 86400 FROM runs)), chain AS (SELECT run_id FROM kept UNION SELECT run_id - 1 FROM chain WHERE run_id % 4 <> 0 AND run_id IN (SELECT run_id FROM runs)) SELECT run_id FROM runs WHERE run_id NOT IN (SELECT run_id FROM chain)",
    "G-07_key_remap": """WITH ours AS (SELECT transcript_id, sha FROM transcripts WHERE transcript_id % 3 <> 1), theirs AS (SELECT sha, min(transcript_id) AS transcript_id FROM (SELECT transcript_id // 2 AS transcript_id, sha FROM transcripts) WHERE transcript_id % 2 = 0 GROUP BY sha),
      fresh AS (SELECT * FROM theirs WHERE sha NOT IN (SELECT sha FROM ours)), top AS (SELECT max(transcript_id) AS top FROM (SELECT transcript_id FROM ours UNION ALL SELECT transcript_id FROM fresh))
      SELECT sha, CASE WHEN transcript_id IN (SELECT transcript_id FROM ours) THEN 'remapped' ELSE 'added' END AS how, CASE WHEN transcript_id IN (SELECT transcript_id FROM ours) THEN (SELECT top FROM top) + 1 + transcript_id ELSE transcript_id END AS new_id FROM fresh""",
}
