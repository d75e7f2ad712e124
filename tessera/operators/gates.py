"""A gate of evidence against thresholds: every reason why a change of scale is not yet allowed.

Evidence and thresholds are rows of the same key, so each campaign can have its own.  Seven observations are held against their limits, three booleans must be true, the
denominators must agree and be enough, and all write targets must be isolated.  What is missing or out of its range is a reason of its own, and is compared with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.dialect import relation

#: The observation, its limit, the reason, and whether it is more or less than the limit that breaks it.
COMPARISONS = (
    ("age_seconds", "max_evidence_age_seconds", "evidence_stale", "more"),
    ("throughput_items_per_hour", "min_throughput_items_per_hour", "throughput_breach", "less"),
    ("api_risk_rate", "max_api_risk_rate", "api_risk_breach", "more"),
    ("peak_disk_bytes", "max_peak_disk_bytes", "disk_peak_breach", "more"),
    ("reclaim_rate", "min_reclaim_rate", "reclaim_breach", "less"),
    ("duplicate_work_count", "max_duplicate_work_count", "duplicate_work_detected", "more"),
    ("max_owner_count", "allowed_owner_count", "multiple_owners_detected", "more"),
)
#: Booleans that must be true, and the reason where one is not.
REQUIRED = (("crash_restart_passed", "crash_restart_failed"), ("checkpoint_reconciled", "checkpoint_unreconciled"), ("risk_taxonomy_unchanged", "risk_taxonomy_changed"))
#: The range of each number: at least one, not negative, above zero, or a share.
RANGES = {
    "whole": ("campaign_item_count", "campaign_denominator", "reconciliation_denominator", "max_owner_count", "min_campaign_item_count", "allowed_owner_count"),
    "natural": ("age_seconds", "throughput_items_per_hour", "peak_disk_bytes", "duplicate_work_count", "max_evidence_age_seconds", "max_peak_disk_bytes", "max_duplicate_work_count"),
    "positive": ("min_throughput_items_per_hour",),
    "share": ("api_risk_rate", "reclaim_rate", "max_api_risk_rate", "min_reclaim_rate"),
}
TARGETS = ("archive", "index", "ledger")


def _fits(kind: str, c: Column) -> Column:
    return {"whole": c >= 1, "natural": c >= 0, "positive": c > 0, "share": c.between(0, 1)}[kind] & ~F.isnan(c.cast("double"))


def evaluated(evidence: DataFrame, thresholds: DataFrame, key: str) -> DataFrame:
    """(key, allowed, reasons): the sorted reasons of each row of ``evidence``; ``isolated`` there is an array of write targets."""
    rows = evidence.join(thresholds, key, "left")
    side = {c: "evidence" if c in evidence.columns else "threshold" for kind in RANGES.values() for c in kind}
    good = {c: F.coalesce(_fits(kind, F.col(c)), F.lit(False)) for kind, names in RANGES.items() for c in names}
    reasons = [F.when(F.col(c).isNull(), f"{side[c]}_missing_{c}").when(~ok, f"{side[c]}_malformed_{c}") for c, ok in good.items()]
    reasons += [F.when(good[a] & good[b] & (F.col(a) > F.col(b) if way == "more" else F.col(a) < F.col(b)), reason) for a, b, reason, way in COMPARISONS]
    reasons += [F.when(~F.coalesce(F.col(c), F.lit(False)), reason) for c, reason in REQUIRED]
    count, denominator, other, least = "campaign_item_count", "campaign_denominator", "reconciliation_denominator", "min_campaign_item_count"
    reasons += [
        F.when(good[count] & good[denominator] & (F.col(count) > F.col(denominator)), "campaign_item_count_exceeds_denominator"),
        F.when(good[denominator] & good[other] & (F.col(denominator) != F.col(other)), "reconciliation_denominator_mismatch"),
        F.when(good[count] & good[least] & (F.col(count) < F.col(least)), "campaign_item_count_below_minimum"),
    ]
    reasons += [F.when(~F.coalesce(F.array_contains("isolated", t), F.lit(False)), f"write_isolation_missing_{t}") for t in TARGETS]
    found = F.array_sort(F.array_compact(F.array(*reasons)))
    return rows.select(key, found.alias("reasons")).select(key, (F.size("reasons") == 0).alias("allowed"), "reasons")


# ----------------------------------------------------------------------------------------------- registered queries


def threshold_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-06: the gate of each run of the log."""
    out = evaluated(relation(spark, sf_dir, "run_evidence").withColumn("isolated", F.split("isolated", ",")), relation(spark, sf_dir, "run_thresholds"), "run_id")
    return out.select("run_id", "allowed", F.array_join("reasons", ",").alias("reasons"))


def _sql() -> str:
    kinds = {"whole": "{0} >= 1", "natural": "{0} >= 0", "positive": "{0} > 0", "share": "{0} BETWEEN 0 AND 1"}
    limits = {limit for _, limit, _, _ in COMPARISONS} | {"min_campaign_item_count"}
    good = {c: f"coalesce({kinds[k].format(c)}, FALSE)" for k, names in RANGES.items() for c in names}
    cases = [f"CASE WHEN {c} IS NULL THEN '{'threshold' if c in limits else 'evidence'}_missing_{c}' WHEN NOT {ok} THEN '{'threshold' if c in limits else 'evidence'}_malformed_{c}' END" for c, ok in good.items()]
    cases += [f"CASE WHEN {good[a]} AND {good[b]} AND {a} {'>' if way == 'more' else '<'} {b} THEN '{reason}' END" for a, b, reason, way in COMPARISONS]
    cases += [f"CASE WHEN NOT coalesce({c}, FALSE) THEN '{reason}' END" for c, reason in REQUIRED]
    cases += [
        f"CASE WHEN {good['campaign_item_count']} AND {good['campaign_denominator']} AND campaign_item_count > campaign_denominator THEN 'campaign_item_count_exceeds_denominator' END",
        f"CASE WHEN {good['campaign_denominator']} AND {good['reconciliation_denominator']} AND campaign_denominator <> reconciliation_denominator THEN 'reconciliation_denominator_mismatch' END",
        f"CASE WHEN {good['campaign_item_count']} AND {good['min_campaign_item_count']} AND campaign_item_count < min_campaign_item_count THEN 'campaign_item_count_below_minimum' END",
    ]
    cases += [f"CASE WHEN NOT coalesce(list_contains(string_split(isolated, ','), '{t}'), FALSE) THEN 'write_isolation_missing_{t}' END" for t in TARGETS]
    return f"SELECT run_id, len(r) = 0 AS allowed, array_to_string(r, ',') AS reasons FROM (SELECT e.run_id, list_sort(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)) AS r FROM run_evidence AS e LEFT JOIN run_thresholds AS t ON t.run_id = e.run_id) AS g"


QUERIES = {"V-06_gate_reasons": threshold_gate}
ORACLES = {"V-06_gate_reasons": _sql()}
