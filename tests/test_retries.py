"""Failure policies and the ten reasons of a retry decision."""

import pytest

from tessera.operators.retries import classified, decide, defaults

JOBS = "job_id long, status string, error_code string, attempts long, available long, finished long"


def categories(spark, *codes):
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(codes)], "job_id long, error_code string")
    return [r["category"] for r in classified(rows, defaults(spark)).select("job_id", "policy.category").orderBy("job_id").collect()]


def test_codes_and_statuses(spark):
    assert categories(spark, "ReadTimeout", "auth_error", "subtitle_empty", "audio_missing", "never_seen", None) == ["transient", "configuration", "source_quality", "artifact_unavailable", "unknown", "unknown"]
    assert categories(spark, *[f"provider_http_{n}" for n in (402, 401, 403, 408, 429, 500, 599, 404, 204)]) == ["billing", "configuration", "configuration", *["transient"] * 4, "provider_request", "provider_request"]
    assert categories(spark, "provider_http_600", "http_429", "provider_http_4290") == ["unknown"] * 3


def one(spark, job=(1, "failed", "transport_error", 1, 100, 100), **more):
    for name, schema in (("holds", "job_id long"), ("ledger", "job_id long, retries long, max_retries long, next_retry_at long, last_retry_at long"), ("replacements", "job_id long, status string")):
        if name in more:
            more[name] = spark.createDataFrame(more[name], schema)
    (r,) = decide(spark.createDataFrame([job], JOBS), defaults(spark), more.pop("now", 1000), **more).collect()
    return r["reason"], r["next_at"], r["retries"], r["budget"], r["allowed"]


@pytest.mark.parametrize(("more", "reason"), [
    ({}, "eligible"),
    ({"job": (1, "queued", None, 0, 0, None)}, "not_failed"),
    ({"holds": [(1,)], "control_known": False}, "retry_hold"),
    ({"control_known": False, "replacements": [(1, "queued")]}, "control_state_unknown"),
    ({"replacements": [(1, "failed"), (1, "running")]}, "replacement_exists"),
    ({"replacements": [(1, "failed"), (2, "running")]}, "eligible"),
    ({"job": (1, "failed", "audio_missing", 9, 0, None)}, "policy_denied"),
    ({"job": (1, "failed", "audio_missing", 9, 0, None), "automatic": False}, "manual_override_required"),
    ({"job": (1, "failed", "rate_limited", 1, 0, None), "automatic": False}, "eligible"),
    ({"job": (1, "failed", "transport_error", 3, 0, None)}, "budget_exhausted"),
    ({"ledger": [(1, None, 0, None, None)]}, "budget_exhausted"),
    ({"ledger": [(1, 2, None, None, None)]}, "budget_exhausted"),
    ({"job": (1, "failed", "transport_error", 2, 0, 500)}, "backoff"),
    ({"job": (1, "failed", "transport_error", 2, 0, 400)}, "eligible"),
    ({"ledger": [(1, None, None, 1001, None)]}, "backoff"),
    ({"ledger": [(1, 1, None, None, 401)]}, "backoff"),
    ({"override": True}, "invalid_manual_override"),
    ({"override": True, "automatic": False, "override_reason": " "}, "invalid_manual_override"),
    ({"job": (1, "failed", "audio_missing", 1, 0, None), "override": True, "automatic": False, "override_reason": "checked"}, "manual_override"),
])
def test_reasons_in_their_order(spark, more, reason):
    got = one(spark, **more)
    assert got[0] == reason and got[4] == (reason in ("eligible", "manual_override"))


def test_times_and_budgets(spark):
    assert one(spark, (1, "failed", "transport_error", 2, 50, 300)) == ("eligible", 900, 1, 2, True)
    assert one(spark, (1, "failed", "transport_error", 9, 50, 300), now=5000)[1:4] == (2100, 8, 2)
    assert one(spark, (1, "failed", "transport_error", 1, None, None))[1] == 0
