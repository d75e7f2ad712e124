"""Failed jobs: what kind of failure it was, when it may be tried again, and whether it is.

Policies are a table of error codes; ``DEFAULTS`` is one, and any other relation of the same columns will do.  A code that is not in the table is known by its HTTP status if it
names one, and otherwise as unknown, which nothing retries by itself.  A decision is the first of ten reasons that holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.dialect import relation

#: A category's retry policy, what to do, whether it is retried by itself, attempts, and seconds to wait before the first, second and later retries.
CATEGORIES = """
transient automatic retry_with_backoff yes 3 0,600,1800
configuration blocked restore_configuration_then_retry no 3 0,600,1800
billing blocked restore_balance_then_retry no 3 0,600,1800
source_quality repair repair_source_then_replace_job no 3 0,600,1800
revision_validation manual inspect_revision_or_repair_proofread no 3 0,600,1800
publication_contract repair repair_data_then_retry no 3 0,600,1800
artifact_unavailable blocked restore_artifacts_then_retry no 3 0,600,1800
provider_filter blocked review_provider_filter no 1 0,600,1800
provider_protocol blocked inspect_provider_completion no 1 0,600,1800
provider_request blocked inspect_provider_configuration no 3 0,600,1800
inference_runtime manual inspect_inference_runtime no 3 0,600,1800
lease_recovery blocked inspect_lease_recovery no 3 0,600,1800
source_rate_limit manual inspect_source_rate_limit no 3 0,600,1800
source_unavailable blocked inspect_source_availability no 3 0,600,1800
source_response manual inspect_source_response no 3 0,600,1800
remote_response manual inspect_remote_response no 3 0,600,1800
worker_lifecycle blocked inspect_worker_shutdown no 3 0,600,1800
metadata_conflict blocked inspect_metadata_owner no 3 0,600,1800
artifact_retention blocked inspect_retention_guard no 3 0,600,1800
artifact_transfer manual resume_artifact_transfer no 3 0,600,1800
unknown unknown inspect_failure no 3 0,600,1800
"""
#: The codes of each category.
CODES = """
transient TimeoutError TimeoutException ConnectError ConnectTimeout ReadTimeout WriteTimeout PoolTimeout NetworkError RemoteProtocolError transport_error transport_failed subtitle_candidate_timeout request_timeout
configuration auth_error auth_failed ASRDependencyError ASRRuntimeCompatibilityError RuntimeCacheError model_identity_unverified
source_quality editorial_source_repetition asr_quality_unusable asr_quality_unknown subtitle_body_unavailable subtitle_timeline_invalid subtitle_empty subtitle_candidate_budget_exhausted subtitle_failed AudioDecodeError shape_error
revision_validation RevisionValidationError
publication_contract publication_contract_failed webvtt_unrepresentable cue_timeline_invalid
artifact_unavailable artifact_input_unavailable artifact_input_identity_mismatch audio_missing audio_digest_mismatch audio_generation_changed audio_input_space_unavailable restore_unavailable
inference_runtime inference_timeout inference_session_failed ASRModelError
lease_recovery lease_expired migration_interrupted lease_renewal_failed
source_rate_limit rate_limited request_budget_exhausted
source_unavailable not_found
source_response response_error gateway_error
remote_response invalid_response
worker_lifecycle worker_drain_timeout
metadata_conflict metadata_owner_conflict metadata_part_identity_conflict metadata_part_topology_changed metadata_resume_requires_reenumeration
artifact_retention retention_guard
artifact_transfer transfer_interrupted
"""
#: A code that names a provider's HTTP status.
HTTP = r"^[a-z]+_http_([1-5][0-9]{2})$"
#: Statuses of a job that stands in for a failed one.
ACTIVE = ("queued", "running", "succeeded")
POLICY = "category string, retry_policy string, action string, automatic boolean, max_attempts int, backoff array<int>"


def _categories() -> dict[str, tuple]:
    rows = (line.split() for line in CATEGORIES.split("\n") if line)
    return {c: (c, policy, action, automatic == "yes", int(attempts), [int(x) for x in waits.split(",")]) for c, policy, action, automatic, attempts, waits in rows}


def defaults(spark: SparkSession) -> DataFrame:
    """The table of policies: (error_code, ...) of each known code, and one row without a code for each category."""
    of = _categories()
    rows = [(None, *p) for p in of.values()] + [(code, *of[line.split()[0]]) for line in CODES.split("\n") if line for code in line.split()[1:]]
    return spark.createDataFrame(rows, f"error_code string, {POLICY}")


def classified(jobs: DataFrame, policies: DataFrame) -> DataFrame:
    """The rows with the policy of their ``error_code``."""
    status = F.try_to_number(F.regexp_extract(F.coalesce("error_code", F.lit("")), HTTP, 1), F.lit("999")).cast("int")
    by_status = F.when(status.isNull(), "unknown").when(status == 402, "billing").when(status.isin(401, 403), "configuration").when(status.isin(408, 429) | (status >= 500), "transient").otherwise("provider_request")
    named = policies.where("error_code IS NOT NULL")
    other = policies.where("error_code IS NULL").drop("error_code")
    columns = [c for c in other.columns]
    rows = jobs.join(F.broadcast(named.select("error_code", F.struct(*columns).alias("named"))), "error_code", "left").withColumn("__category", by_status)
    rows = rows.join(F.broadcast(other.select(F.col("category").alias("__category"), F.struct(*columns).alias("other"))), "__category", "left").drop("__category")
    return rows.withColumn("policy", F.coalesce("named", "other")).drop("named", "other")


def decide(
    jobs: DataFrame, policies: DataFrame, now: int, holds: DataFrame | None = None, ledger: DataFrame | None = None, replacements: DataFrame | None = None,
    control_known: bool = True, automatic: bool = True, override: bool = False, override_reason: str | None = None,
) -> DataFrame:
    """(job_id, category, reason, allowed, next_at, retries, budget) of each of ``jobs`` (job_id, status, error_code, attempts, available, finished).

    ``holds``: (job_id) kept back; ``ledger``: (job_id, retries, max_retries, next_retry_at, last_retry_at), nulls where nothing is noted; ``replacements``: (job_id, status) of jobs in their place.
    The job's own count of attempts is the least that was used, whatever the ledger says.
    """
    rows = classified(jobs, policies)
    rows = rows.withColumn("held", F.lit(False)) if holds is None else rows.join(holds.select("job_id").distinct().withColumn("held", F.lit(True)), "job_id", "left")
    noted = ("retries", "max_retries", "next_retry_at", "last_retry_at")
    rows = rows.withColumns({c: F.lit(None).cast("long") for c in noted}) if ledger is None else rows.join(ledger.select("job_id", *noted), "job_id", "left")
    active = None if replacements is None else replacements.where(F.col("status").isin(*ACTIVE)).select("job_id").distinct().withColumn("replaced", F.lit(True))
    rows = rows.withColumn("replaced", F.lit(False)) if active is None else rows.join(active, "job_id", "left")
    nothing = F.lit(0)
    used = F.greatest(F.col("attempts") - 1, F.coalesce("retries", nothing), nothing)
    most = F.col("policy.max_attempts") - 1
    rows = rows.withColumn("used", used).withColumn("budget", F.least(most, F.coalesce("max_retries", most)))
    wait = F.get("policy.backoff", F.least("used", F.size("policy.backoff") - 1).cast("int"))
    next_at = F.greatest(F.coalesce("available", nothing), F.coalesce("next_retry_at", nothing), F.coalesce(F.col("finished") + wait, nothing), F.coalesce(F.col("last_retry_at") + wait, nothing))
    rows = rows.withColumn("next_at", next_at.cast("long"))
    reasoned = bool(override_reason and override_reason.strip())
    yes = F.lit
    reason = (
        F.when(~F.col("status").eqNullSafe("failed"), "not_failed").when(F.col("held"), "retry_hold").when(yes(not control_known), "control_state_unknown").when(F.col("replaced"), "replacement_exists")
        .when(yes(automatic) & ~F.col("policy.automatic"), "policy_denied").when(yes(not automatic and not override) & ~F.col("policy.retry_policy").isin("automatic", "manual"), "manual_override_required")
        .when(F.col("used") >= F.col("budget"), "budget_exhausted").when(F.col("next_at") > now, "backoff")
        .when(yes(override and (automatic or not reasoned)), "invalid_manual_override").when(yes(override), "manual_override").otherwise("eligible")
    )
    rows = rows.withColumn("reason", reason)
    return rows.select("job_id", "policy.category", "reason", F.col("reason").isin("eligible", "manual_override").alias("allowed"), "next_at", F.col("used").cast("long").alias("retries"), F.col("budget").cast("long").alias("budget"))


# ----------------------------------------------------------------------------------------------- registered queries

NOW = 960_000_000
_LEDGER = "SELECT job_id, CASE WHEN job_id % 2 = 0 THEN job_id % 3 END AS retries, CASE WHEN job_id % 5 = 1 THEN 1 END AS max_retries, CASE WHEN job_id % 7 = 3 THEN 970000000 END AS next_retry_at, CASE WHEN job_id % 11 = 2 THEN 959999000 END AS last_retry_at FROM retry_jobs WHERE job_id % 4 = 2"
_REPLACED = "SELECT repair_of AS job_id, status FROM jobs WHERE repair_of IS NOT NULL"


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z-01 to Z-03: every job's decision, by the default policies, a ledger, holds and replacements; by itself, and when asked for by hand."""
    from tessera.plans.dialect import spark_query

    jobs, ledger, replaced = relation(spark, sf_dir, "retry_jobs"), spark_query(_LEDGER)(spark, sf_dir), spark_query(_REPLACED)(spark, sf_dir)
    holds, table = jobs.where("job_id % 41 = 0"), defaults(spark)
    by_itself = decide(jobs, table, NOW, holds, ledger, replaced).withColumn("asked", F.lit("automatic"))
    by_hand = decide(jobs, table, NOW, holds, ledger, replaced, automatic=False).withColumn("asked", F.lit("manual"))
    return by_itself.unionByName(by_hand)


def failed_page(jobs: DataFrame, decided: DataFrame, attempts: DataFrame, replacements: DataFrame, after: int | None = None, limit: int | None = None) -> DataFrame:
    """Failed jobs with their decision, newest attempt and replacements, by job_id; those past ``after``, and the first ``limit`` of them, or all.

    ``attempts``: (job_id, seq, finished, outcome); ``replacements``: (job_id, by_id, status).
    """
    failed = jobs.where("status = 'failed'").select("job_id", "kind", "error_code")
    failed = failed if after is None else failed.where(F.col("job_id") > after)
    failed = failed if limit is None else failed.orderBy("job_id").limit(limit)
    newest = attempts.groupBy("job_id").agg(F.count("*").alias("attempts_n"), F.max_by("outcome", F.struct("finished", "seq")).alias("last_outcome"), F.max("finished").alias("last_at"))
    stands = replacements.groupBy("job_id").agg(F.count("*").alias("replacements_n"), F.min(F.when(F.col("status").isin(*ACTIVE), F.col("by_id"))).alias("active_id"))
    out = failed.join(decided, "job_id").join(newest, "job_id", "left").join(stands, "job_id", "left")
    none = F.lit(0).cast("long")
    return out.select("job_id", "kind", "error_code", "category", "reason", "next_at", F.coalesce("attempts_n", none).alias("attempts_n"), "last_outcome", "last_at", F.coalesce("replacements_n", none).alias("replacements_n"), "active_id")


def failed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-11: all failed jobs with what became of them."""
    from tessera.plans.dialect import spark_query

    jobs = spark_query("SELECT r.*, j.kind FROM retry_jobs AS r JOIN jobs AS j ON j.job_id = r.job_id")(spark, sf_dir)
    replaced = spark_query("SELECT repair_of AS job_id, job_id AS by_id, status FROM jobs WHERE repair_of IS NOT NULL")(spark, sf_dir)
    decided = decide(jobs.drop("kind"), defaults(spark), NOW, jobs.where("job_id % 41 = 0"), spark_query(_LEDGER)(spark, sf_dir), replaced)
    return failed_page(jobs, decided, relation(spark, sf_dir, "job_attempts"), replaced)


def _policies_sql() -> str:
    of = _categories()
    rows = [(code, *of[line.split()[0]]) for line in CODES.split("\n") if line for code in line.split()[1:]]
    return ", ".join(f"('{r[0]}', '{r[1]}', '{r[2]}', {r[4]}, {r[5]}, {r[6]})" for r in rows)


_OTHERS = ", ".join(f"('{p[0]}', '{p[1]}', {p[3]}, {p[4]}, {p[5]})" for p in _categories().values())
_SQL = f"""WITH named(code, category, retry_policy, automatic, max_attempts, backoff) AS (VALUES {_policies_sql()}), other(category, retry_policy, automatic, max_attempts, backoff) AS (VALUES {_OTHERS}), ledger AS ({_LEDGER}),
    coded AS (SELECT *, try_cast(nullif(regexp_extract(coalesce(error_code, ''), '{HTTP}', 1), '') AS int) AS status_no FROM retry_jobs),
    known AS (SELECT j.job_id, j.status, j.attempts, j.available, j.finished, coalesce(n.category, o.category) AS category, coalesce(n.retry_policy, o.retry_policy) AS retry_policy, coalesce(n.automatic, o.automatic) AS automatic, coalesce(n.max_attempts, o.max_attempts) AS max_attempts, coalesce(n.backoff, o.backoff) AS backoff
        FROM coded AS j LEFT JOIN named AS n ON n.code = j.error_code JOIN other AS o ON o.category = CASE WHEN status_no IS NULL THEN 'unknown' WHEN status_no = 402 THEN 'billing' WHEN status_no IN (401, 403) THEN 'configuration' WHEN status_no IN (408, 429) OR status_no >= 500 THEN 'transient' ELSE 'provider_request' END),
    used AS (SELECT k.*, l.next_retry_at, l.last_retry_at, greatest(k.attempts - 1, coalesce(l.retries, 0), 0) AS used, least(max_attempts - 1, coalesce(l.max_retries, max_attempts - 1)) AS budget FROM known AS k LEFT JOIN ledger AS l ON l.job_id = k.job_id),
    timed AS (SELECT *, greatest(coalesce(available, 0), coalesce(next_retry_at, 0), coalesce(finished + backoff[least(used, len(backoff) - 1) + 1], 0), coalesce(last_retry_at + backoff[least(used, len(backoff) - 1) + 1], 0)) AS next_at FROM used),
    asked AS (SELECT *, unnest(['automatic', 'manual']) AS asked FROM timed),
    reasoned AS (SELECT *, CASE WHEN status <> 'failed' THEN 'not_failed' WHEN job_id % 41 = 0 THEN 'retry_hold' WHEN job_id IN (SELECT job_id FROM ({_REPLACED}) AS r WHERE status IN ('queued', 'running', 'succeeded')) THEN 'replacement_exists'
        WHEN asked = 'automatic' AND NOT automatic THEN 'policy_denied' WHEN asked = 'manual' AND retry_policy NOT IN ('automatic', 'manual') THEN 'manual_override_required' WHEN used >= budget THEN 'budget_exhausted' WHEN next_at > {NOW} THEN 'backoff' ELSE 'eligible' END AS reason FROM asked)
    SELECT job_id, asked, category, reason, reason = 'eligible' AS allowed, next_at, used AS retries, budget FROM reasoned"""
QUERIES = {"Z-03_retry_decisions": decisions, "Q-11_failed_jobs": failed_jobs}
ORACLES = {
    "Z-03_retry_decisions": _SQL,
    "Q-11_failed_jobs": f"""WITH decided AS ({_SQL}), a AS (SELECT job_id, count(*) AS attempts_n, arg_max(outcome, (finished, seq)) AS last_outcome, max(finished) AS last_at FROM job_attempts GROUP BY job_id),
        s AS (SELECT repair_of AS job_id, count(*) AS replacements_n, min(CASE WHEN status IN ('queued', 'running', 'succeeded') THEN job_id END) AS active_id FROM jobs WHERE repair_of IS NOT NULL GROUP BY repair_of)
        SELECT j.job_id, k.kind, j.error_code, d.category, d.reason, d.next_at, coalesce(attempts_n, 0) AS attempts_n, last_outcome, last_at, coalesce(replacements_n, 0) AS replacements_n, active_id
        FROM retry_jobs AS j JOIN jobs AS k ON k.job_id = j.job_id JOIN decided AS d ON d.job_id = j.job_id AND d.asked = 'automatic' LEFT JOIN a ON a.job_id = j.job_id LEFT JOIN s ON s.job_id = j.job_id WHERE j.status = 'failed'""",
}
