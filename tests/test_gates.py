"""The gate: each reason alone, and none."""

import pytest
from pyspark.sql import functions as F

from tessera.operators.gates import evaluated

GOOD = {"campaign_item_count": 50, "campaign_denominator": 60, "reconciliation_denominator": 60, "age_seconds": 10, "throughput_items_per_hour": 5.0, "api_risk_rate": 0.1, "peak_disk_bytes": 10, "reclaim_rate": 0.5, "duplicate_work_count": 0, "max_owner_count": 1}
LIMITS = {"min_campaign_item_count": 50, "max_evidence_age_seconds": 10, "min_throughput_items_per_hour": 5.0, "max_api_risk_rate": 0.1, "max_peak_disk_bytes": 10, "min_reclaim_rate": 0.5, "max_duplicate_work_count": 0, "allowed_owner_count": 1}
FLAGS = {"crash_restart_passed": True, "checkpoint_reconciled": True, "risk_taxonomy_unchanged": True, "isolated": ["index", "ledger", "archive"]}
TYPES = {float: "double", int: "long", bool: "boolean", list: "array<string>"}


def reasons(spark, evidence=None, limits=None):
    sides = []
    for base, given in ((GOOD | FLAGS, evidence), (LIMITS, limits)):
        row = base | (given or {})
        sides.append(spark.createDataFrame([(1, *row.values())], "run long, " + ", ".join(f"{c} {TYPES[type(base[c])]}" for c in row)))
    (r,) = evaluated(*sides, "run").collect()
    assert r["allowed"] == (not r["reasons"])
    return r["reasons"]


@pytest.mark.parametrize(("evidence", "limits", "want"), [
    ({}, {}, []),
    ({"age_seconds": 11}, {}, ["evidence_stale"]),
    ({"throughput_items_per_hour": 4.9}, {}, ["throughput_breach"]),
    ({"api_risk_rate": 0.2}, {}, ["api_risk_breach"]),
    ({"peak_disk_bytes": 11}, {}, ["disk_peak_breach"]),
    ({"reclaim_rate": 0.4}, {}, ["reclaim_breach"]),
    ({"duplicate_work_count": 1}, {}, ["duplicate_work_detected"]),
    ({"max_owner_count": 2}, {}, ["multiple_owners_detected"]),
    ({"crash_restart_passed": False, "checkpoint_reconciled": None}, {}, ["checkpoint_unreconciled", "crash_restart_failed"]),
    ({"campaign_item_count": 61}, {}, ["campaign_item_count_exceeds_denominator"]),
    ({"reconciliation_denominator": 59}, {}, ["reconciliation_denominator_mismatch"]),
    ({"campaign_item_count": 49}, {}, ["campaign_item_count_below_minimum"]),
    ({"campaign_item_count": 0}, {}, ["evidence_malformed_campaign_item_count"]),
    ({"api_risk_rate": float("nan")}, {}, ["evidence_malformed_api_risk_rate"]),
    ({"reclaim_rate": None}, {"max_peak_disk_bytes": -1}, ["evidence_missing_reclaim_rate", "threshold_malformed_max_peak_disk_bytes"]),
    ({"isolated": ["index"]}, {}, ["write_isolation_missing_archive", "write_isolation_missing_ledger"]),
    ({"isolated": None}, {"allowed_owner_count": None}, ["threshold_missing_allowed_owner_count", *(f"write_isolation_missing_{t}" for t in ("archive", "index", "ledger"))]),
])
def test_each_reason(spark, evidence, limits, want):
    assert reasons(spark, evidence, limits) == want


def test_evidence_without_thresholds_is_refused(spark):
    evidence = spark.createDataFrame([(1, *GOOD.values(), *FLAGS.values())], "run long, " + ", ".join(f"{c} {TYPES[type(v)]}" for c, v in (GOOD | FLAGS).items()))
    limits = spark.range(0).select(F.col("id").alias("run"), *[F.lit(v).alias(c) for c, v in LIMITS.items()])
    (r,) = evaluated(evidence, limits, "run").collect()
    assert r["reasons"] == sorted(f"threshold_missing_{c}" for c in LIMITS)
