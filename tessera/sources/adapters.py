"""The archive's relations, derived from the driver's tables by pure selects.

Every log has an explicit order column (``seq`` or its id), times are whole epoch seconds or milliseconds, and
nothing depends on the order of rows.
"""

from __future__ import annotations

from tessera.plans.dialect import RELATIONS

add = RELATIONS.add

add("creators", "SELECT c_custkey AS mid, c_name AS display_name FROM customer")
add("videos", "SELECT o_orderkey AS video_id, concat('VID', o_orderkey) AS video_code, o_custkey AS mid, concat(o_orderpriority, ' ', o_orderkey) AS title, EPOCH[o_orderdate] AS pubdate, o_orderstatus AS state FROM orders")
add(
    "parts",
    """SELECT l_orderkey * 8 + l_linenumber AS part_id, l_orderkey AS video_id, concat('VID', l_orderkey) AS video_code, cast(l_linenumber - 1 AS bigint) AS page,
    cast(max(l_quantity) * 1000 AS bigint) AS duration_ms, min(l_partkey) AS first_tag,
    CASE min(l_returnflag) WHEN 'N' THEN 'metadata_collected' WHEN 'A' THEN 'discovered' ELSE 'gone' END AS status
    FROM lineitem GROUP BY l_orderkey, l_linenumber""",
)
add("tags", "SELECT DISTINCT l_orderkey AS video_id, cast(l_linenumber AS bigint) AS place, p_brand AS tag_name, p_type AS tag_type FROM lineitem JOIN part ON l_partkey = p_partkey")
add(
    "log",
    """SELECT event_id AS seq, IDIV[event_id; 50] AS run_id, (event_id % 400) * 8 + 1 + event_id % 3 AS part_id, EPOCH[ts] AS finished, user_id, value,
    event_type, cast(JSON_TEXT[props; k] AS bigint) AS k FROM events""",
)
add(
    "attempts",
    """SELECT log.seq, log.run_id, log.part_id, log.finished, log.user_id, log.value,
    CASE event_type WHEN 'purchase' THEN 'stored' WHEN 'click' THEN 'unchanged' WHEN 'error' THEN 'failed' ELSE 'no-subtitle' END AS outcome,
    CASE WHEN event_type = 'error' THEN 'transport_error' WHEN event_type = 'signup' AND k % 2 = 0 THEN 'not_found' END AS error_code,
    event_type IN ('view', 'signup') AND NOT (event_type = 'signup' AND k % 2 = 0) AND k % 4 <> 0 AS credential_verified,
    event_type = 'signup' AND k % 4 = 0 AS absence_verified
    FROM log JOIN parts ON log.part_id = parts.part_id""",
)
add("runs", "SELECT run_id, CASE WHEN run_id % 10 = 9 THEN 'audio' ELSE 'subtitle' END AS kind, run_id % 4 <> 3 AS credential_present, min(finished) AS started FROM log GROUP BY run_id")
add(
    "transcripts",
    """SELECT doc_id AS transcript_id, part_id, source_kind, lang AS language, sha, text,
    cast(row_number() OVER (PARTITION BY part_id, source_kind, lang ORDER BY doc_id) AS bigint) AS version FROM
    (SELECT doc_id, (doc_id % 100) * 32 + 1 + doc_id % 3 AS part_id, CASE doc_id % 3 WHEN 0 THEN 'subtitle-cc' WHEN 1 THEN 'subtitle-ai' ELSE 'asr-local' END AS source_kind,
    lang, SHA[text] AS sha, text FROM documents) AS d""",
)
add("audio_links", "SELECT DISTINCT ((doc_id % 100) * 4 + 1) * 8 + 1 + doc_id % 2 AS part_id, doc_id % 37 AS audio_id FROM documents WHERE doc_id % 5 = 0")
add("audio_objects", "SELECT audio_id, SHA[TEXT[audio_id]] AS sha, 1000 + 17 * audio_id AS byte_size FROM (SELECT DISTINCT audio_id FROM audio_links) AS a")
add(
    "lines",
    "SELECT doc_id, cast(ordinal AS bigint) AS ordinal, line FROM documents LATERAL VIEW posexplode(split(text, chr(10))) AS ordinal, line",
    "SELECT doc_id, unnest(range(0, len(l))) AS ordinal, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)",
)
add(
    "segments",
    """SELECT transcript_id, ordinal, text, start_ms, start_ms + 40 * length(text) + CASE WHEN ordinal % 11 = 10 THEN -40 * length(text) - 100 ELSE 200 END AS end_ms FROM
    (SELECT doc_id AS transcript_id, ordinal, line AS text,
    cast(60 * coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) + 1000 * ordinal
    + CASE ordinal % 7 WHEN 3 THEN 2600 WHEN 5 THEN -1500 ELSE 0 END AS start_ms FROM lines) AS s""",
)
add("recordings", "SELECT transcript_id, max(end_ms) - transcript_id % 3 * 500 AS duration_ms FROM segments GROUP BY transcript_id")
add(
    "turns",
    """SELECT conv_id, turn, role, text, start_ms, start_ms + 60 * length(text) AS end_ms FROM
    (SELECT conv_id, turn, role, text, cast(70 * coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint)
    + CASE WHEN turn % 3 = 2 THEN 4000 ELSE 0 END AS start_ms FROM conversations) AS c""",
)
add("assessments", "SELECT doc_id AS assessment_id, (doc_id % 100) * 32 + 1 + doc_id % 3 AS part_id, cast(quality * 0.5 + toxic * 0.25 AS double) AS score, CASE WHEN doc_id % 7 = 0 THEN 'asr-admission' ELSE 'local' END AS assessor FROM labels")
add(
    "jobs",
    """SELECT o_orderkey AS job_id, CASE o_orderkey % 4 WHEN 0 THEN 'subtitle' WHEN 1 THEN 'audio' WHEN 2 THEN 'asr' ELSE 'proofread' END AS kind, o_custkey % 50 AS part_id,
    CASE WHEN o_orderkey % 97 = 0 THEN 'cancelled' WHEN o_orderstatus = 'F' THEN 'succeeded' WHEN o_orderstatus = 'O' THEN 'queued' ELSE 'failed' END AS status,
    o_orderkey % 5 AS priority, EPOCH[o_orderdate] AS created, EPOCH[o_orderdate] + o_orderkey % 1000 AS available,
    CASE WHEN o_orderstatus = 'P' THEN CASE o_orderkey % 3 WHEN 0 THEN 'transport_error' WHEN 1 THEN 'http_429' ELSE 'invalid_input' END END AS error_code, o_orderkey % 6 AS retries,
    CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey - 1 END AS repair_of FROM orders""",
)
add(
    "edges",
    """SELECT e.job_id, e.needs FROM (SELECT o_orderkey AS job_id, IDIV[o_orderkey; 3] AS needs FROM orders WHERE o_orderkey > 0
    UNION ALL SELECT o_orderkey AS job_id, 3 * o_orderkey + 1 AS needs FROM orders WHERE o_orderkey < 20) AS e JOIN orders ON e.needs = o_orderkey""",
)
add(
    "job_attempts",
    """SELECT log.seq, jobs.job_id, jobs.kind, jobs.part_id, log.finished - WHOLE[log.value] AS started, log.finished AS finished, CASE WHEN log.event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS outcome,
    CASE WHEN log.event_type = 'error' THEN 'transport_error' END AS error_code, CASE WHEN log.k % 5 = 0 THEN NULL ELSE log.k % 40 END AS digest, CASE WHEN log.k % 11 = 0 THEN 9999 ELSE 1000 * (log.k % 40) + 500 END AS audio_ms,
    log.k AS tokens FROM log JOIN jobs ON log.seq % 300 = jobs.job_id""",
)
add("publications", "SELECT seq AS publication_id, part_id, finished AS published, 3 * (seq % 100) AS transcript_id FROM attempts WHERE outcome = 'stored'")
add("replicas", "SELECT l_partkey AS object_id, l_suppkey AS target_id, max(EPOCH[l_shipdate]) AS verified, count(*) AS copies, max(cast(l_quantity * 100 AS bigint)) AS byte_size, CASE min(l_returnflag) WHEN 'R' THEN 'released' WHEN 'A' THEN 'missing' ELSE 'present' END AS presence FROM lineitem GROUP BY l_partkey, l_suppkey")
add("rights", "SELECT seq, part_id, finished AS seen_at, k, CASE event_type WHEN 'purchase' THEN 'granted' WHEN 'click' THEN 'granted' WHEN 'error' THEN 'hold' WHEN 'view' THEN 'revoked' ELSE 'released' END AS kind, finished + 86400 * (k % 30) AS expires FROM log")
add("observations", "SELECT seq, user_id AS video_id, finished AS seen_at, CASE event_type WHEN 'error' THEN 'unavailable' WHEN 'signup' THEN 'empty' WHEN 'view' THEN 'missing' ELSE 'present' END AS state, CASE WHEN event_type IN ('purchase', 'click') THEN concat('title ', k) END AS title FROM log")
add(
    "lease_log",
    """SELECT seq, seq % 300 AS job_id, finished AS happened, CASE event_type WHEN 'view' THEN 'claim' WHEN 'click' THEN 'renew' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE CASE WHEN k % 19 = 0 THEN 'cancel' WHEN k % 3 = 0 THEN 'supersede' ELSE 'claim' END END AS kind,
    cast(user_id % 2 AS bigint) AS worker, CASE WHEN event_type IN ('click', 'purchase', 'error') AND k % 4 = 0 THEN k % 3 + 1 END AS fence FROM log""",
)
add(
    "cues",
    """SELECT transcript_id, ordinal, start_ms, CASE WHEN ordinal % 31 = 4 THEN start_ms + 300 ELSE end_ms END AS end_ms,
    CASE WHEN ordinal % 29 = 3 THEN concat('，', text) WHEN ordinal % 31 = 4 THEN substr(text, 1, 4) WHEN ordinal % 37 IN (5, 6) THEN 'the same again' ELSE text END AS text,
    CASE WHEN transcript_id % 3 <> 0 THEN cast((transcript_id * 31 + ordinal * 7) % 1000 AS double) / 1000 END AS confidence FROM segments""",
)
add("bursts", "SELECT transcript_id, 0 AS ordinal, 1000 AS start_ms, 1000 + length(text) * (5 + transcript_id % 11) AS end_ms, text FROM transcripts WHERE source_kind = 'asr-local'")
add(
    "raw_cues",
    """SELECT transcript_id, ordinal, CASE WHEN transcript_id % 5 = 1 AND ordinal = 3 THEN cast('NaN' AS double) WHEN transcript_id % 23 = 7 AND ordinal = 2 THEN NULL ELSE cast(start_ms + 1600 AS double) / 1000 END AS start_s,
    CASE WHEN transcript_id % 29 = 8 AND ordinal = 4 THEN 2e9 ELSE cast(end_ms + 1600 + CASE WHEN transcript_id % 2 = 0 AND end_ms < start_ms THEN start_ms - end_ms + 200 ELSE 0 END AS double) / 1000 END AS end_s,
    CASE WHEN transcript_id % 4 = 3 THEN concat(text, chr(10), ' ', chr(10), 'x') WHEN length(trim(text)) = 0 AND transcript_id % 2 = 0 THEN 'x' ELSE text END AS text FROM segments""",
)
add(
    "coverage_facts",
    """SELECT transcript_id, duration_ms, decoded_s, produced_s, produced_s / CASE WHEN decoded_s > 0 THEN decoded_s ELSE 1 END + CASE WHEN transcript_id % 37 = 11 THEN 0.01 ELSE 0 END AS ratio, minimum,
    CASE WHEN transcript_id % 41 <> 12 THEN produced_s / CASE WHEN decoded_s > 0 THEN decoded_s ELSE 1 END < minimum END AS short, transcript_id % 17 = 3 AS review, transcript_id % 19 = 6 AS unresolved FROM
    (SELECT r.transcript_id, duration_ms, CASE WHEN r.transcript_id % 13 = 5 THEN NULL ELSE cast(duration_ms AS double) / 1000 + 2 END AS decoded_s,
    CASE WHEN r.transcript_id % 7 = 2 THEN 0.5 ELSE CASE WHEN span < cast(duration_ms AS double) / 1000 + 2 THEN span ELSE cast(duration_ms AS double) / 1000 + 2 END END AS produced_s, CASE WHEN r.transcript_id % 3 = 0 THEN 0.9 ELSE 0.2 END AS minimum
    FROM (SELECT transcript_id, duration_ms FROM recordings UNION ALL SELECT transcript_id + 100000000 AS transcript_id, duration_ms FROM recordings WHERE transcript_id % 31 = 9) AS r LEFT JOIN (SELECT transcript_id, max(end_s) - min(start_s) AS span FROM raw_cues WHERE start_s < 1e9 AND end_s < 1e9 GROUP BY transcript_id) AS c ON c.transcript_id = r.transcript_id) AS f""",
)
add("object_copies", "SELECT object_id * 1000 + target_id AS copy_id, object_id, byte_size, verified AS modified FROM replicas WHERE presence <> 'released' AND object_id % 4 <> 1")
add(
    "object_groups",
    """SELECT DISTINCT object_id, IDIV[object_id; 3] AS group_id FROM replicas WHERE object_id % 5 <> 2
    UNION ALL SELECT DISTINCT object_id, IDIV[object_id; 3] + 1 AS group_id FROM replicas WHERE object_id % 10 = 3""",
)
# A second archive: creators under other keys or with keys of others, videos with other titles, parts and jobs that follow them.
add("own_creators", "SELECT mid, display_name FROM creators WHERE mid % 9 <> 4")
add("their_creators", "SELECT CASE WHEN mid % 7 = 2 THEN mid + 9000000 WHEN mid % 11 = 5 THEN mid + 1 ELSE mid END AS mid, display_name FROM creators WHERE mid % 5 <> 3 AND NOT (mid % 11 = 6 OR (mid - 1) % 11 = 5 AND (mid - 1) % 7 <> 2)")
add("own_videos", "SELECT video_id, video_code, mid, title FROM videos WHERE video_id % 6 <> 1")
add(
    "their_videos",
    """SELECT v.video_id, v.video_code, CASE WHEN v.mid % 7 = 2 THEN v.mid + 9000000 ELSE v.mid END AS mid, CASE WHEN v.video_id % 97 = 5 THEN 'another title' ELSE v.title END AS title
    FROM (SELECT CASE WHEN video_id % 13 = 3 THEN video_id + 1000000 ELSE video_id END AS video_id, CASE WHEN video_id % 17 = 2 THEN concat(video_code, 'B') ELSE video_code END AS video_code, mid, title FROM videos WHERE video_id % 4 <> 2) AS v""",
)
add("own_parts", "SELECT part_id, video_id, page, status FROM parts WHERE part_id % 10 <> 7")
add("their_parts", "SELECT part_id, CASE WHEN video_id % 13 = 3 THEN video_id + 1000000 ELSE video_id END AS video_id, page, CASE WHEN part_id % 101 = 9 THEN 'gone' ELSE status END AS status FROM parts WHERE part_id % 3 <> 1")
add("own_jobs", "SELECT job_id, kind, part_id, status, repair_of FROM job_rows WHERE job_id % 8 <> 5")
add("job_rows", "SELECT job_id, kind, 8 * (job_id % 300) + 1 + job_id % 3 AS part_id, status, CASE WHEN job_id > 0 THEN job_id - 1 - job_id % 3 END AS repair_of FROM jobs")
add("their_jobs", "SELECT job_id, kind, part_id, CASE WHEN job_id % 500 = 77 THEN 'other' ELSE status END AS status, repair_of FROM job_rows WHERE job_id % 9 <> 4")
add("own_transcripts", "SELECT transcript_id, part_id, sha FROM transcripts WHERE transcript_id % 3 <> 1")
add("their_transcripts", "SELECT transcript_id, part_id, CASE WHEN transcript_id % 40 = 3 THEN concat(sha, 'x') ELSE sha END AS sha FROM transcripts WHERE transcript_id % 2 = 1")
add(
    "retry_jobs",
    """SELECT job_id, status, CASE job_id % 11 WHEN 0 THEN 'provider_http_429' WHEN 1 THEN 'provider_http_402' WHEN 2 THEN 'other_http_404' WHEN 3 THEN 'asr_quality_unusable' WHEN 4 THEN 'lease_expired' WHEN 5 THEN 'rate_limited' WHEN 6 THEN 'never_seen'
    WHEN 7 THEN NULL ELSE 'transport_error' END AS error_code, retries AS attempts, available, CASE WHEN job_id % 6 <> 1 THEN created + 90000000 END AS finished FROM jobs""",
)
add(
    "run_evidence",
    """SELECT run_id, n AS campaign_item_count, CASE WHEN run_id % 19 = 4 THEN n - 1 ELSE n + 5 END AS campaign_denominator, CASE WHEN run_id % 17 = 3 THEN n ELSE CASE WHEN run_id % 19 = 4 THEN n - 1 ELSE n + 5 END END AS reconciliation_denominator,
    CASE WHEN run_id % 23 = 5 THEN NULL ELSE last_at - first_at END AS age_seconds, n * 3600.0 / greatest(last_at - first_at, 1) AS throughput_items_per_hour, errors * 1.0 / n + CASE WHEN run_id % 29 = 6 THEN 1 ELSE 0 END AS api_risk_rate,
    cast(total * 1000 AS bigint) AS peak_disk_bytes, stored * 1.0 / n AS reclaim_rate, n - users AS duplicate_work_count, users AS max_owner_count,
    run_id % 6 <> 5 AS crash_restart_passed, CASE WHEN run_id % 7 <> 6 THEN TRUE END AS checkpoint_reconciled, run_id % 8 <> 7 AS risk_taxonomy_unchanged, CASE run_id % 5 WHEN 0 THEN 'archive,index' WHEN 1 THEN 'ledger' ELSE 'index,archive,ledger' END AS isolated
    FROM (SELECT run_id, count(*) AS n, min(finished) AS first_at, max(finished) AS last_at, COUNT_IF[event_type = 'error'] AS errors, COUNT_IF[event_type IN ('purchase', 'click')] AS stored, count(DISTINCT user_id) AS users, sum(value) AS total FROM log GROUP BY run_id) AS r""",
)
add(
    "run_thresholds",
    """SELECT run_id, CASE WHEN run_id % 31 = 7 THEN NULL ELSE 40 END AS min_campaign_item_count, 20000 + run_id % 3 * 400000 AS max_evidence_age_seconds, CASE WHEN run_id % 37 = 8 THEN 0.0 ELSE 5.0 END AS min_throughput_items_per_hour, 0.25 AS max_api_risk_rate,
    5000000 AS max_peak_disk_bytes, 0.4 AS min_reclaim_rate, 30 AS max_duplicate_work_count, 30 AS allowed_owner_count FROM (SELECT DISTINCT run_id FROM log) AS r WHERE run_id % 13 <> 9""",
)
