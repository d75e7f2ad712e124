"""Archive queries that one statement expresses: scans, joins, aggregates, windows, limits, sets and decisions.

Keys start with the inventory's ids.  Ordered results carry their rank as a column.
"""

from __future__ import annotations

#: Newest subtitle attempt of parts that are not gone and have no transcript: the eligible parts are chosen before the window.
_NEWEST = """newest AS (SELECT * FROM (SELECT a.part_id, a.seq, a.outcome, a.error_code, a.credential_verified, a.absence_verified, a.finished, runs.credential_present,
  row_number() OVER (PARTITION BY a.part_id ORDER BY a.finished DESC, runs.started DESC, a.run_id DESC, a.seq DESC) AS nth
  FROM attempts AS a JOIN runs ON a.run_id = runs.run_id WHERE runs.kind = 'subtitle') AS w WHERE nth = 1)"""
_LOOKS = "looks AS (SELECT a.part_id, count(DISTINCT a.run_id) AS looks FROM attempts AS a JOIN runs ON a.run_id = runs.run_id WHERE runs.kind = 'subtitle' AND runs.credential_present AND a.credential_verified AND a.outcome = 'no-subtitle' AND a.error_code IS NULL GROUP BY a.part_id)"
_ATTESTED = """(n.outcome = 'no-subtitle' AND ((n.error_code = 'not_found' AND n.absence_verified)
  OR (n.error_code IS NULL AND n.credential_present AND n.credential_verified AND coalesce(looks.looks, 0) >= 2)))"""
_HAS_TRANSCRIPT = "held AS (SELECT DISTINCT part_id FROM transcripts)"
_HAS_AUDIO = "sound AS (SELECT DISTINCT part_id FROM audio_links)"
_STATE = f"""state AS (SELECT parts.part_id, parts.video_id, parts.page, parts.status,
  CASE WHEN held.part_id IS NOT NULL THEN 'transcribed' WHEN sound.part_id IS NOT NULL THEN 'audio_ok' WHEN {_ATTESTED} THEN 'audio_pending' WHEN n.outcome = 'no-subtitle' THEN 'no_subtitle' ELSE 'discovered' END AS pipeline_state
  FROM parts LEFT JOIN held ON parts.part_id = held.part_id LEFT JOIN sound ON parts.part_id = sound.part_id LEFT JOIN newest AS n ON parts.part_id = n.part_id LEFT JOIN looks ON parts.part_id = looks.part_id)"""
_ALL_STATE = f"WITH {_NEWEST}, {_LOOKS}, {_HAS_TRANSCRIPT}, {_HAS_AUDIO}, {_STATE}"
_PREFERRED = """preferred AS (SELECT * FROM (SELECT part_id, transcript_id, source_kind, language, version, sha,
  row_number() OVER (PARTITION BY part_id ORDER BY CASE source_kind WHEN 'subtitle-cc' THEN 0 WHEN 'subtitle-ai' THEN 1 ELSE 2 END,
  CASE WHEN language = 'zh' THEN 0 WHEN language = 'en' THEN 1 ELSE 2 END, language, version DESC, transcript_id DESC) AS nth FROM transcripts) AS p WHERE nth = 1)"""
_PROJECTION = f"""{_PREFERRED}, pub AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY published DESC, publication_id DESC) AS nth FROM publications) AS w WHERE nth = 1),
      projection AS (SELECT p.part_id, v.pubdate, pref.transcript_id AS preferred_id, pub.transcript_id AS published_id, coalesce(pub.transcript_id = pref.transcript_id, FALSE) AS publication_current,
      CASE WHEN pub.part_id IS NOT NULL THEN 'archived' WHEN pref.source_kind = 'asr-local' THEN 'asr_done' WHEN pref.part_id IS NOT NULL THEN 'subtitle_done' ELSE 'meta_ok' END AS status
      FROM parts AS p JOIN videos AS v ON p.video_id = v.video_id LEFT JOIN preferred AS pref ON p.part_id = pref.part_id LEFT JOIN pub ON p.part_id = pub.part_id WHERE p.status <> 'gone')"""
_RETRY = """CASE WHEN status <> 'failed' THEN 'not_failed' WHEN job_id % 41 = 0 THEN 'retry_hold' WHEN job_id % 59 = 0 THEN 'control_state_unknown' WHEN repaired > 0 THEN 'replacement_exists'
  WHEN error_code = 'invalid_input' THEN 'policy_denied' WHEN error_code = 'http_429' AND retries = 0 THEN 'manual_override_required' WHEN retries >= 4 THEN 'budget_exhausted' WHEN available > 1700000000 THEN 'backoff' ELSE 'eligible' END"""

STATEMENTS: dict[str, str] = {
    # Sources and views
    "S-01_part_listing": "SELECT p.part_id, p.video_code, p.page, p.duration_ms, p.status, v.title, v.pubdate, c.mid, c.display_name, concat(p.video_code, ':p', p.page) AS work_id FROM parts AS p JOIN videos AS v ON p.video_id = v.video_id JOIN creators AS c ON v.mid = c.mid",
    "S-02_run_stats": """SELECT runs.run_id, runs.kind, runs.started, coalesce(a.parts_seen, 0) AS parts_seen, coalesce(b.users_seen, 0) AS users_seen FROM runs
      LEFT JOIN (SELECT run_id, count(DISTINCT part_id) AS parts_seen FROM attempts GROUP BY run_id) AS a ON runs.run_id = a.run_id
      LEFT JOIN (SELECT run_id, count(DISTINCT user_id) AS users_seen FROM log GROUP BY run_id) AS b ON runs.run_id = b.run_id""",
    "S-03_pending_metadata": "SELECT part_id, video_code, page, cast(row_number() OVER (ORDER BY video_code, page) AS bigint) AS rank_no FROM (SELECT part_id, video_code, page FROM parts WHERE status = 'discovered' ORDER BY video_code, page LIMIT 500) AS p",
    "S-04_neutral_parts": "SELECT 'video' AS platform, v.video_code AS source_video, p.page AS source_part, c.display_name AS creator FROM parts AS p JOIN videos AS v ON p.video_id = v.video_id LEFT JOIN creators AS c ON v.mid = c.mid",
    "S-05_neutral_sync": "SELECT concat('c', c.mid) AS neutral_id, 'creator' AS kind, c.display_name AS name FROM creators AS c UNION ALL SELECT v.video_code AS neutral_id, 'video' AS kind, v.title AS name FROM videos AS v UNION ALL SELECT concat(p.video_code, ':p', p.page) AS neutral_id, 'part' AS kind, v.title AS name FROM parts AS p JOIN videos AS v ON p.video_id = v.video_id",
    "S-06_keyset_page": "SELECT part_id, video_code, page FROM parts WHERE part_id > 4000 ORDER BY part_id LIMIT 256",
    "S-07_composite_keyset": "SELECT video_id, page, part_id FROM parts WHERE video_id > 700 OR (video_id = 700 AND page > 2)",
    "S-10_route_milliseconds": "SELECT transcript_id, count(*) AS segments, SUM_INT[CASE WHEN end_ms <= start_ms OR start_ms < 0 OR length(trim(text)) = 0 THEN 1 ELSE 0 END] AS violations, min(CASE WHEN end_ms <= start_ms OR start_ms < 0 OR length(trim(text)) = 0 THEN ordinal END) AS first_bad FROM segments GROUP BY transcript_id",
    "S-11_text_fallback": "SELECT p.part_id, coalesce(cc.text, ai.text, asr.text) AS text, CASE WHEN cc.text IS NOT NULL THEN 'cc' WHEN ai.text IS NOT NULL THEN 'ai' WHEN asr.text IS NOT NULL THEN 'asr' END AS source FROM parts AS p LEFT JOIN (SELECT part_id, min(text) AS text FROM transcripts WHERE source_kind = 'subtitle-cc' GROUP BY part_id) AS cc ON p.part_id = cc.part_id LEFT JOIN (SELECT part_id, min(text) AS text FROM transcripts WHERE source_kind = 'subtitle-ai' GROUP BY part_id) AS ai ON p.part_id = ai.part_id LEFT JOIN (SELECT part_id, min(text) AS text FROM transcripts WHERE source_kind = 'asr-local' GROUP BY part_id) AS asr ON p.part_id = asr.part_id",
    "S-13_digest_check": "SELECT doc_id, SHA[text] AS digest, BYTES[text] AS size_bytes, BYTES[text] <= 65536 AS within_cap FROM documents",
    "S-14_metadata_codec": "SELECT event_id, JSON_TEXT[props; k] AS k_text, NUMBER[JSON_TEXT[props; k]] AS k, JSON_TEXT[props; absent] AS absent FROM events",
    "S-15_export_rows": "SELECT concat(p.video_code, ':p', p.page) AS work_id, coalesce(v.title, '') AS title, coalesce(DATE_TEXT[v.pubdate], '') AS published, coalesce(TEXT[p.duration_ms], '') AS duration FROM parts AS p LEFT JOIN videos AS v ON p.video_id = v.video_id WHERE p.status <> 'gone'",
    "S-16_srt_render": "SELECT transcript_id, JOINED[concat(ordinal + 1, chr(10), PADDED[IDIV[start_ms; 3600000]; 2], ':', PADDED[IDIV[start_ms; 60000] % 60; 2], ':', PADDED[IDIV[start_ms; 1000] % 60; 2], ',', PADDED[start_ms % 1000; 3], chr(10), text, chr(10)); chr(10); ordinal] AS srt FROM segments WHERE start_ms >= 0 AND end_ms > start_ms GROUP BY transcript_id",
    # A cue that can't be written refuses its file; cues may overlap, but none starts before the one before it.
    "S-16_vtt_render": """SELECT transcript_id, max(refused) AS refused, CASE WHEN max(refused) = 0 THEN concat('WEBVTT', chr(10), chr(10), JOINED[concat(PADDED[IDIV[start_ms; 3600000]; 2], ':', PADDED[IDIV[start_ms; 60000] % 60; 2], ':', PADDED[IDIV[start_ms; 1000] % 60; 2], '.', PADDED[start_ms % 1000; 3], ' --> ', PADDED[IDIV[end_ms; 3600000]; 2], ':', PADDED[IDIV[end_ms; 60000] % 60; 2], ':', PADDED[IDIV[end_ms; 1000] % 60; 2], '.', PADDED[end_ms % 1000; 3], chr(10),
      replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10)); chr(10); ordinal]) END AS vtt FROM (SELECT transcript_id, ordinal, text, greatest(start_ms, 0) AS start_ms, greatest(end_ms, 0) AS end_ms,
      CASE WHEN start_ms < 0 OR end_ms <= start_ms OR start_ms < coalesce(lag(start_ms) OVER (PARTITION BY transcript_id ORDER BY ordinal), 0) OR length(trim(text)) = 0 THEN 1 ELSE 0 END AS refused FROM (SELECT transcript_id, ordinal, CASE WHEN transcript_id % 2 = 0 THEN 4000 * ordinal ELSE start_ms END AS start_ms, CASE WHEN transcript_id % 2 = 0 THEN 4000 * ordinal + 5000 ELSE end_ms END AS end_ms, CASE WHEN transcript_id % 2 = 0 AND length(trim(text)) = 0 THEN '-' ELSE text END AS text FROM segments) AS c) AS s GROUP BY transcript_id""",
    "S-17_time_format": "SELECT transcript_id, ordinal, concat(PADDED[IDIV[start_ms; 3600000]; 2], ':', PADDED[IDIV[start_ms; 60000] % 60; 2], ':', PADDED[IDIV[start_ms; 1000] % 60; 2], '.', PADDED[start_ms % 1000; 3]) AS stamp FROM segments WHERE start_ms >= 0",
    "S-18_bundle_marker": "SELECT transcript_id, SHA[text] AS txt_sha, SHA[concat('---', chr(10), transcript_id, chr(10), text)] AS md_sha, length(text) AS chars FROM transcripts",
    "S-19_public_catalog": """WITH q AS (SELECT p.part_id, p.publication_id, p.published, t.sha, IDIV[p.published; 86400] AS day FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY published DESC, publication_id DESC) AS nth FROM publications) AS p JOIN transcripts AS t ON p.transcript_id = t.transcript_id WHERE nth = 1),
      earlier AS (SELECT day, sum(n) OVER (ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS n_before FROM (SELECT day, count(*) AS n FROM q GROUP BY day) AS g)
      SELECT q.part_id, q.publication_id, q.published, q.sha, cast(e.n_before + row_number() OVER (PARTITION BY q.day ORDER BY q.published DESC, q.part_id) AS bigint) AS rank_no FROM q JOIN earlier AS e ON q.day = e.day""",
    "S-21_snapshot_delta": "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'removed' WHEN b.doc_id IS NULL THEN 'added' ELSE 'changed' END AS change FROM (SELECT doc_id, SHA[text] AS sha FROM documents WHERE doc_id % 10 <> 3) AS a FULL JOIN (SELECT doc_id, SHA[CASE WHEN doc_id % 7 = 0 THEN upper(text) ELSE text END] AS sha FROM documents WHERE doc_id % 10 <> 4) AS b ON a.doc_id = b.doc_id WHERE a.sha IS DISTINCT FROM b.sha",
    # Predicates
    "F-01_null_safe": "SELECT a.seq, a.error_code IS NOT DISTINCT FROM b.error_code AS same_code FROM attempts AS a JOIN attempts AS b ON a.seq = b.seq + 1",
    "F-02_literal_match": "SELECT doc_id, instr(ASCII_LOWER[text], 'the_') > 0 AS literal_underscore, instr(ASCII_LOWER[text], 'license') > 0 AS license FROM documents",
    "F-03_folded_match": "SELECT doc_id, instr(lower(text), lower('ÉLE')) > 0 AS found FROM documents",
    "F-04_classification": "SELECT part_id, CASE WHEN status = 'gone' THEN 'blocked' WHEN duration_ms > 40000 THEN 'long' WHEN duration_ms > 20000 THEN 'medium' ELSE 'short' END AS bucket FROM parts",
    "F-05_half_open_window": "SELECT video_id, pubdate FROM videos WHERE pubdate >= 757382400 AND pubdate < 788918400",
    "F-06_window_overlap": "SELECT seq, job_id, started, finished FROM job_attempts WHERE (started < 1704200000 AND finished > 1704100000) OR (started = finished AND started >= 1704100000 AND started < 1704200000)",
    "F-07_key_list": "SELECT p.part_id FROM parts AS p WHERE p.video_id IN (SELECT video_id FROM videos WHERE mid % 11 = 0) AND NOT EXISTS (SELECT 1 FROM audio_links AS a WHERE a.part_id = p.part_id)",
    "F-08_selection": "SELECT v.wanted, CASE WHEN p.part_id IS NULL THEN 'unknown' WHEN p.status = 'gone' THEN 'gone' ELSE 'selected' END AS class FROM (SELECT DISTINCT (event_id % 400) * 8 + 1 + event_id % 3 AS wanted FROM events) AS v LEFT JOIN parts AS p ON v.wanted = p.part_id",
    "F-09_multi_field": "SELECT job_id, kind, status FROM jobs WHERE kind IN ('asr', 'audio') AND status IN ('failed', 'queued') AND priority IN (1, 2) ORDER BY job_id LIMIT 200 OFFSET 50",
    "F-10_scope": "SELECT job_id FROM jobs WHERE created BETWEEN 757382400 AND 788918400 AND status IN ('succeeded', 'failed')",
    "F-11_scope_tokens": "SELECT t.token, count(p.part_id) AS matched, count(p.part_id) = 0 AS unavailable FROM (SELECT DISTINCT concat('VID', event_id % 500) AS token FROM events) AS t LEFT JOIN parts AS p ON t.token = p.video_code GROUP BY t.token",
    "F-12_budget_gate": "SELECT p.part_id, coalesce(a.byte_size > 1300, TRUE) AS blocked FROM parts AS p LEFT JOIN (SELECT l.part_id, max(o.byte_size) AS byte_size FROM audio_links AS l JOIN audio_objects AS o ON l.audio_id = o.audio_id GROUP BY l.part_id) AS a ON p.part_id = a.part_id",
    "F-13_retention": "SELECT r.object_id, SORTED_SET[r.blocker] AS blockers FROM (SELECT object_id, 'pin' AS blocker FROM replicas WHERE object_id % 17 = 0 UNION ALL SELECT object_id, 'single' AS blocker FROM replicas GROUP BY object_id HAVING count(*) < 3 UNION ALL SELECT object_id, 'recent' AS blocker FROM replicas WHERE verified > 900000000) AS r GROUP BY r.object_id",
    "F-14_path_safety": "SELECT page_id, instr(url, '..') > 0 AS climbs, MATCHES[url; '^[a-z]+://'] AS absolute, MATCHES[url; '[A-Z]'] AS has_upper FROM pages",
    "F-14_path_collision": "SELECT lower(path) AS folded, count(*) AS n FROM (SELECT DISTINCT GROUP_OF[url; '^[a-z]+://[^/]+(/[^?#]*)'; 1] AS path FROM pages) AS p GROUP BY lower(path) HAVING count(*) > 1",
    # Joins
    "J-01_inner": "SELECT p.part_id, v.title FROM parts AS p JOIN videos AS v ON p.video_id = v.video_id",
    "J-02_left": "SELECT c.mid, count(v.video_id) AS videos FROM creators AS c LEFT JOIN videos AS v ON c.mid = v.mid GROUP BY c.mid",
    "J-03_conditional_key": "SELECT p.part_id, a.audio_id FROM parts AS p LEFT JOIN audio_links AS a ON p.part_id = a.part_id AND p.status = 'discovered'",
    "J-04_semi": "SELECT p.part_id FROM parts AS p WHERE EXISTS (SELECT 1 FROM audio_links AS a WHERE a.part_id = p.part_id)",
    "J-05_anti": "SELECT p.part_id FROM parts AS p WHERE NOT EXISTS (SELECT 1 FROM transcripts AS t WHERE t.part_id = p.part_id)",
    "J-06_existence_value": "SELECT p.part_id, d.part_id IS NOT NULL AS has_audio FROM parts AS p LEFT JOIN (SELECT DISTINCT part_id FROM audio_links) AS d ON p.part_id = d.part_id",
    "J-07_latest_scalar": "SELECT part_id, max_by(outcome, seq) AS last_outcome, max(seq) AS last_seq FROM attempts GROUP BY part_id",
    "J-08_correlated_counts": "SELECT j.job_id, coalesce(e.needs_all, 0) AS prerequisites, coalesce(e.open, 0) AS blockers FROM jobs AS j LEFT JOIN (SELECT edges.job_id, count(*) AS needs_all, COUNT_IF[p.status <> 'succeeded'] AS open FROM edges JOIN jobs AS p ON edges.needs = p.job_id GROUP BY edges.job_id) AS e ON j.job_id = e.job_id",
    "J-09_not_first": "SELECT seq, job_id, row_number() OVER (PARTITION BY job_id ORDER BY started, seq) > 1 AS is_retry FROM job_attempts",
    "J-12_prefilter": "SELECT a.seq, a.part_id FROM attempts AS a WHERE a.part_id IN (SELECT part_id FROM parts WHERE status <> 'gone')",
    "J-13_computed_key": "SELECT s.transcript_id, s.ordinal, length(s.text) AS chars FROM segments AS s JOIN (SELECT DISTINCT concat('t', doc_id, ':', doc_id % 5) AS block FROM documents) AS b ON concat('t', s.transcript_id, ':', s.ordinal) = b.block",
    "J-14_json_key": "SELECT e.event_id, r.kind FROM (SELECT event_id, cast(JSON_TEXT[props; k] AS bigint) AS k FROM events) AS e JOIN runs AS r ON e.k = r.run_id",
    "J-15_latest_observation": "SELECT o.video_id, o.seq, o.state FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seen_at DESC, seq DESC) AS nth FROM observations) AS o WHERE nth = 1",
    "J-16_broken_pointers": "SELECT p.publication_id, t.transcript_id IS NULL AS missing, t.part_id IS DISTINCT FROM p.part_id AS foreign_part FROM publications AS p LEFT JOIN transcripts AS t ON p.transcript_id = t.transcript_id",
    "J-17_multi_hop": "SELECT a.seq, coalesce(j.part_id, a.part_id, -1) AS part_id FROM job_attempts AS a LEFT JOIN jobs AS j ON a.job_id = j.job_id LEFT JOIN parts AS p ON j.part_id = p.part_id",
    # Aggregates
    "A-01_count_by_key": "SELECT kind, status, count(*) AS n FROM jobs GROUP BY kind, status",
    "A-02_count_distinct": "SELECT run_id, count(DISTINCT part_id) AS part_n, count(DISTINCT outcome) AS outcomes FROM attempts GROUP BY run_id",
    "A-03_reused": "SELECT audio_id, count(DISTINCT part_id) AS part_n FROM audio_links GROUP BY audio_id HAVING count(DISTINCT part_id) > 1",
    "A-04_dedup_report": """WITH o AS (SELECT audio_id, count(DISTINCT part_id) AS n FROM audio_links GROUP BY audio_id), g AS (SELECT sha, source_kind, language, count(*) AS row_n, count(DISTINCT part_id) AS part_n FROM transcripts GROUP BY sha, source_kind, language HAVING count(DISTINCT part_id) > 1)
      SELECT (SELECT count(*) FROM o) AS objects, (SELECT SUM_INT[n] FROM o) AS links, (SELECT count(*) FROM o WHERE n > 1) AS reused_objects, (SELECT SUM_INT[n - 1] FROM o) AS reused_parts, (SELECT count(*) FROM g) AS transcript_groups, (SELECT coalesce(SUM_INT[row_n], 0) FROM g) AS transcript_rows""",
    "A-05_conditional_sums": "SELECT kind, COUNT_IF[status = 'failed'] AS failed, COUNT_IF[status = 'queued'] AS queued, SUM_INT[CASE WHEN status = 'succeeded' THEN retries ELSE 0 END] AS retries FROM jobs GROUP BY kind",
    "A-06_failure_groups": "SELECT kind, error_code, SUM_INT[current_n] AS current_n, SUM_INT[history_n] AS history_n, max(last_at) AS last_at FROM (SELECT kind, error_code, 1 AS current_n, 0 AS history_n, available AS last_at FROM jobs WHERE status = 'failed' UNION ALL SELECT kind, error_code, 0 AS current_n, 1 AS history_n, finished AS last_at FROM job_attempts WHERE outcome = 'failed') AS u GROUP BY kind, error_code",
    "A-07_run_outcome": "SELECT run_id, CASE WHEN count(*) = COUNT_IF[outcome = 'failed'] THEN 'failed' WHEN COUNT_IF[outcome = 'failed'] > 0 THEN 'partial' ELSE 'complete' END AS outcome FROM attempts GROUP BY run_id",
    "A-08_scalar_counts": "SELECT (SELECT count(*) FROM videos) AS videos_n, (SELECT count(*) FROM parts) AS parts_n, (SELECT count(*) FROM transcripts) AS transcripts_n, (SELECT count(*) FROM jobs WHERE status = 'failed') AS failed_n",
    "A-09_ordered_tags": "SELECT video_id, JOINED[tag_name; chr(10); place, tag_name] AS tag_text FROM tags GROUP BY video_id",
    "A-10_transcript_text": "SELECT transcript_id, JOINED[text; chr(10); ordinal] AS text FROM segments GROUP BY transcript_id",
    "A-11_distinct_in_order": "SELECT video_id, JOINED[tag_name; ','; place, tag_name] AS names FROM (SELECT video_id, tag_name, min(place) AS place FROM tags GROUP BY video_id, tag_name) AS t GROUP BY video_id",
    "A-12_percentiles": "SELECT kind, PERCENTILE[cast(finished - started AS double); 0.5] AS p50, PERCENTILE[cast(finished - started AS double); 0.95] AS p95 FROM job_attempts GROUP BY kind",
    "A-13_throughput": """WITH span AS (SELECT min(started) + 86400 AS a, max(finished) - 86400 AS b FROM job_attempts), w AS (SELECT j.*, span.a, span.b, row_number() OVER (PARTITION BY job_id ORDER BY started, seq) > 1 AS again FROM job_attempts AS j CROSS JOIN span WHERE j.started < span.b AND j.finished > span.a),
      good AS (SELECT kind, digest, audio_ms FROM w WHERE outcome = 'succeeded' AND digest IS NOT NULL AND finished < b AND started >= a), clash AS (SELECT digest FROM good GROUP BY digest HAVING min(audio_ms) <> max(audio_ms)),
      heard AS (SELECT kind, SUM_INT[audio_ms] AS audio_ms FROM (SELECT DISTINCT kind, digest, audio_ms FROM good AS g WHERE NOT EXISTS (SELECT 1 FROM clash WHERE clash.digest = g.digest)) AS d GROUP BY kind)
      SELECT w.kind, count(*) AS tries, COUNT_IF[w.outcome = 'failed'] AS failed, COUNT_IF[w.again] AS retries, SUM_INT[least(w.finished, w.b) - greatest(w.started, w.a)] AS wall_s, max(heard.audio_ms) AS unique_audio_ms, COUNT_IF[w.outcome = 'succeeded' AND w.digest IS NULL] AS unknown_n FROM w LEFT JOIN heard ON w.kind = heard.kind GROUP BY w.kind""",
    "A-14_window_outcomes": "SELECT outcome, count(*) AS n FROM job_attempts WHERE started < 1704800000 AND finished >= 1704100000 GROUP BY outcome",
    "A-15_low_scores": "SELECT part_id, count(*) AS n, avg(score) AS mean_score, COUNT_IF[score < 0.4] AS low_n, coalesce(JOINED[CASE WHEN score < 0.4 THEN TEXT[assessment_id] END; ','; assessment_id], '') AS low_ids FROM assessments GROUP BY part_id",
    "A-16_coverage_span": "SELECT s.transcript_id, least(max(s.end_ms) - min(s.start_ms), max(r.duration_ms)) AS produced_ms, CASE WHEN max(r.duration_ms) > 0 THEN cast(least(max(s.end_ms) - min(s.start_ms), max(r.duration_ms)) AS double) / max(r.duration_ms) < 0.97 END AS is_short FROM segments AS s JOIN recordings AS r ON s.transcript_id = r.transcript_id GROUP BY s.transcript_id",
    "A-17_token_usage": "SELECT kind, SUM_INT[tokens] AS tokens, COUNT_IF[digest IS NULL] AS missing, CASE WHEN COUNT_IF[digest IS NULL] > 0 THEN NULL ELSE SUM_INT[tokens * 3] END AS cost FROM job_attempts GROUP BY kind",
    "A-18_call_budget": "SELECT job_id, tokens % 3 AS chunk, count(*) AS used, max_by(outcome, seq) AS last_outcome, count(*) >= 3 AS exhausted FROM job_attempts GROUP BY job_id, tokens % 3",
    "A-19_next_version": "SELECT part_id, source_kind, language, max(version) + 1 AS next_version FROM transcripts GROUP BY part_id, source_kind, language",
    "A-20_coverage_rollup": f"{_ALL_STATE} SELECT CASE WHEN pipeline_state = 'transcribed' THEN 'complete' WHEN status = 'gone' THEN 'defect' ELSE 'backlog' END AS category, count(*) AS n FROM state GROUP BY CASE WHEN pipeline_state = 'transcribed' THEN 'complete' WHEN status = 'gone' THEN 'defect' ELSE 'backlog' END",
    "A-21_defect_summary": "SELECT CASE WHEN end_ms <= start_ms THEN 'empty' WHEN start_ms < 0 THEN 'negative' ELSE 'sound' END AS class, count(*) AS n, count(DISTINCT transcript_id) AS transcripts_n FROM segments GROUP BY CASE WHEN end_ms <= start_ms THEN 'empty' WHEN start_ms < 0 THEN 'negative' ELSE 'sound' END",
    "A-22_transfer_summary": "SELECT presence, count(*) AS items, SUM_INT[byte_size] AS bytes FROM replicas GROUP BY presence",
    "A-24_issue_histogram": """WITH firsts AS (SELECT code, job_id FROM (SELECT error_code AS code, job_id, row_number() OVER (PARTITION BY error_code ORDER BY job_id) AS nth FROM jobs WHERE error_code IS NOT NULL) AS i WHERE nth <= 32)
      SELECT c.code, c.n, c.n > 32 AS truncated, s.sample FROM (SELECT error_code AS code, count(*) AS n FROM jobs WHERE error_code IS NOT NULL GROUP BY error_code) AS c JOIN (SELECT code, JOINED[TEXT[job_id]; ','; job_id] AS sample FROM firsts GROUP BY code) AS s ON c.code = s.code""",
    # Windows
    "W-01_newest_attempt": f"WITH {_NEWEST} SELECT part_id, seq, outcome, error_code FROM newest",
    "W-02_newest_for_audio": f"WITH {_NEWEST}, {_LOOKS} SELECT n.part_id, n.outcome, coalesce(looks.looks, 0) AS looks, {_ATTESTED} AS attested FROM newest AS n LEFT JOIN looks ON n.part_id = looks.part_id",
    "W-03_latest_publication": "SELECT p.part_id, p.publication_id, t.sha FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY published DESC, publication_id DESC) AS nth FROM publications) AS p LEFT JOIN transcripts AS t ON p.transcript_id = t.transcript_id WHERE nth = 1",
    "W-04_latest_ok_page": "SELECT l.run_id, l.user_id, l.part_id FROM log AS l JOIN (SELECT user_id, run_id FROM (SELECT user_id, run_id, row_number() OVER (PARTITION BY user_id ORDER BY max(finished) DESC, run_id DESC) AS nth FROM log WHERE event_type <> 'error' GROUP BY user_id, run_id) AS w WHERE nth = 1) AS p ON l.user_id = p.user_id AND l.run_id = p.run_id",
    "W-05_newest_failed": "SELECT user_id, event_type, seq FROM (SELECT user_id, event_type, seq, k, row_number() OVER (PARTITION BY user_id, k % 3 ORDER BY seq DESC) AS nth FROM log) AS w WHERE nth = 1 AND event_type = 'error'",
    "W-06_top_replacements": "SELECT job_id, attempt_seq, cast(nth AS bigint) AS nth FROM (SELECT j.job_id, a.seq AS attempt_seq, row_number() OVER (PARTITION BY j.job_id ORDER BY CASE WHEN a.outcome = 'succeeded' THEN 0 ELSE 1 END, a.seq DESC) AS nth FROM jobs AS j JOIN job_attempts AS a ON j.job_id = a.job_id WHERE j.status = 'failed') AS w WHERE nth <= 100",
    "W-07_top_prerequisites": "SELECT job_id, needs, cast(nth AS bigint) AS nth FROM (SELECT job_id, needs, row_number() OVER (PARTITION BY job_id ORDER BY needs) AS nth FROM edges) AS w WHERE nth <= 100",
    "W-08_preferred_transcript": f"WITH {_PREFERRED} SELECT part_id, transcript_id, source_kind, language, version FROM preferred",
    "W-09_caption_ranking": "SELECT transcript_id, part_id, cast(row_number() OVER (PARTITION BY part_id ORDER BY CASE language WHEN 'de' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END, CASE source_kind WHEN 'subtitle-cc' THEN 0 ELSE 1 END, transcript_id) AS bigint) AS rank_no FROM transcripts WHERE source_kind <> 'asr-local'",
    "W-10_rights_event": "SELECT part_id, seq, kind FROM (SELECT part_id, seq, kind, row_number() OVER (PARTITION BY part_id, CASE WHEN k % 4 = 0 THEN NULL ELSE k % 2 END ORDER BY CASE WHEN kind = 'hold' THEN 0 ELSE 1 END, seen_at DESC, seq DESC) AS nth FROM rights) AS w WHERE nth = 1",
    # Graph queries without recursion
    "G-04_ready_jobs": """WITH ready AS (SELECT j.job_id, j.priority, j.created FROM jobs AS j WHERE j.status = 'queued' AND j.available <= 1700000000 AND NOT EXISTS (SELECT 1 FROM edges JOIN jobs AS p ON edges.needs = p.job_id WHERE p.status <> 'succeeded' AND edges.job_id = j.job_id)),
      earlier AS (SELECT priority, created, sum(n) OVER (ORDER BY priority DESC, created ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS n_before FROM (SELECT priority, created, count(*) AS n FROM ready GROUP BY priority, created) AS g)
      SELECT r.job_id, cast(e.n_before + row_number() OVER (PARTITION BY r.priority, r.created ORDER BY r.job_id) AS bigint) AS rank_no FROM ready AS r JOIN earlier AS e ON r.priority = e.priority AND r.created = e.created""",
    "G-05_explain_jobs": "SELECT j.job_id, j.status, coalesce(e.needs, '') AS needs, coalesce(e.blockers, '') AS blockers, a.last_outcome FROM jobs AS j LEFT JOIN (SELECT edges.job_id, JOINED[TEXT[edges.needs]; ','; edges.needs] AS needs, JOINED[CASE WHEN p.status <> 'succeeded' THEN TEXT[edges.needs] END; ','; edges.needs] AS blockers FROM edges JOIN jobs AS p ON edges.needs = p.job_id GROUP BY edges.job_id) AS e ON j.job_id = e.job_id LEFT JOIN (SELECT job_id, max_by(outcome, seq) AS last_outcome FROM job_attempts GROUP BY job_id) AS a ON j.job_id = a.job_id",
    "G-12_planning_graph": "SELECT p.part_id, k.kind, concat(k.kind, ':', p.part_id) AS dedupe_key, CASE k.kind WHEN 'asr' THEN concat('audio:', p.part_id) WHEN 'proofread' THEN concat('asr:', p.part_id) WHEN 'render' THEN concat('proofread:', p.part_id) END AS needs FROM parts AS p CROSS JOIN (SELECT 'subtitle' AS kind UNION ALL SELECT 'audio' UNION ALL SELECT 'asr' UNION ALL SELECT 'proofread' UNION ALL SELECT 'render') AS k WHERE p.status <> 'gone'",
    # Orders and limits
    # A rank over all rows: rows before the day, counted by day, and the place within it; no window holds the table.
    "L-02_queue_order": """WITH q AS (SELECT p.part_id, p.video_code, p.page, v.pubdate FROM parts AS p JOIN videos AS v ON p.video_id = v.video_id),
      earlier AS (SELECT pubdate, sum(n) OVER (ORDER BY pubdate DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS n_before FROM (SELECT pubdate, count(*) AS n FROM q GROUP BY pubdate) AS g)
      SELECT q.part_id, cast(e.n_before + row_number() OVER (PARTITION BY q.pubdate ORDER BY q.video_code, q.page) AS bigint) AS rank_no FROM q JOIN earlier AS e ON q.pubdate = e.pubdate""",
    "L-03_limit_by_part": "SELECT t.part_id, t.transcript_id FROM transcripts AS t JOIN (SELECT DISTINCT part_id FROM transcripts ORDER BY part_id LIMIT 50) AS p ON t.part_id = p.part_id",
    "L-04_truncation": "SELECT count(*) > 100 AS truncated, least(count(*), 100) AS kept FROM (SELECT seq FROM attempts WHERE outcome = 'failed' ORDER BY seq LIMIT 101) AS a",
    "L-05_page_with_total": "SELECT f.job_id, t.total FROM (SELECT job_id FROM jobs WHERE status = 'failed' ORDER BY job_id LIMIT 20 OFFSET 40) AS f CROSS JOIN (SELECT count(*) AS total FROM jobs WHERE status = 'failed') AS t",
    "L-06_shared_limit": "SELECT source, id, cast(row_number() OVER (ORDER BY source, id) AS bigint) AS rank_no FROM (SELECT source, id FROM (SELECT 0 AS source, video_id AS id FROM videos WHERE title LIKE '1-%' UNION ALL SELECT 1 AS source, doc_id AS id FROM documents) AS u ORDER BY source, id LIMIT 100) AS q",
    "L-07_top_groups": "SELECT sha, n FROM (SELECT sha, count(*) AS n FROM transcripts GROUP BY sha HAVING count(*) > 1) AS g ORDER BY n DESC, sha LIMIT 20",
    "L-09_latest_runs": "SELECT run_id, kind, started FROM runs ORDER BY started DESC, run_id DESC LIMIT 25",
    "L-10_first_error": "SELECT run_id, min_by(error_code, seq) AS first_error FROM attempts WHERE error_code IS NOT NULL GROUP BY run_id",
    # Sets
    "U-01_union_views": "SELECT 'video' AS platform, part_id FROM parts WHERE status = 'discovered' UNION ALL SELECT 'audio' AS platform, part_id FROM audio_links",
    "U-02_zero_filled": "SELECT part_id, SUM_INT[t] AS transcripts_n, SUM_INT[a] AS audio_n FROM (SELECT part_id, 1 AS t, 0 AS a FROM transcripts UNION ALL SELECT part_id, 0 AS t, 1 AS a FROM audio_links) AS u GROUP BY part_id",
    "U-04_union_distinct": "SELECT part_id FROM transcripts UNION SELECT part_id FROM publications",
    "U-05_set_difference": "SELECT part_id FROM parts EXCEPT SELECT part_id FROM attempts",
    "U-06_replace_set": "SELECT video_id, tag_name FROM tags WHERE video_id % 5 <> 0 UNION SELECT video_id, 'replaced' AS tag_name FROM videos WHERE video_id % 5 = 0",
    # Named queries
    "Q-01_pending_subtitles": f"WITH {_NEWEST}, {_HAS_TRANSCRIPT} SELECT p.part_id, p.video_code, p.page, n.outcome, n.error_code, n.finished, CASE WHEN n.part_id IS NULL THEN 0 ELSE 1 END AS attempted FROM parts AS p LEFT JOIN newest AS n ON p.part_id = n.part_id WHERE p.status <> 'gone' AND NOT EXISTS (SELECT 1 FROM held WHERE held.part_id = p.part_id)",
    "Q-02_missing_subtitle": f"WITH {_HAS_TRANSCRIPT} SELECT p.part_id, v.title, v.pubdate FROM parts AS p JOIN videos AS v ON p.video_id = v.video_id WHERE p.status <> 'gone' AND NOT EXISTS (SELECT 1 FROM held WHERE held.part_id = p.part_id)",
    "Q-03_missing_audio": f"WITH {_NEWEST}, {_LOOKS}, {_HAS_TRANSCRIPT}, {_HAS_AUDIO} SELECT p.part_id, n.error_code FROM parts AS p JOIN newest AS n ON p.part_id = n.part_id LEFT JOIN looks ON p.part_id = looks.part_id WHERE p.status <> 'gone' AND NOT EXISTS (SELECT 1 FROM held WHERE held.part_id = p.part_id) AND NOT EXISTS (SELECT 1 FROM sound WHERE sound.part_id = p.part_id) AND {_ATTESTED}",
    "Q-04_missing_transcript": f"WITH {_HAS_TRANSCRIPT}, {_HAS_AUDIO} SELECT p.part_id, p.status FROM parts AS p WHERE EXISTS (SELECT 1 FROM sound WHERE sound.part_id = p.part_id) AND NOT EXISTS (SELECT 1 FROM held WHERE held.part_id = p.part_id)",
    "Q-05_pipeline_state": f"{_ALL_STATE} SELECT part_id, pipeline_state FROM state",
    "Q-06_provider_queue": f"{_ALL_STATE} SELECT 'a' AS provider, part_id FROM state WHERE pipeline_state = 'audio_pending' AND status <> 'gone' UNION ALL SELECT 'b' AS provider, part_id FROM parts WHERE status = 'discovered' AND part_id % 2 = 0",
    "Q-07_projection": f"WITH {_PROJECTION} SELECT part_id, pubdate, preferred_id, published_id, publication_current, status FROM projection",
    "Q-08_coverage_report": f"WITH {_PROJECTION} SELECT status, count(*) AS works, count(preferred_id) AS with_text, count(published_id) AS published_n, COUNT_IF[publication_current] AS current_n, COUNT_IF[published_id IS NOT NULL AND NOT publication_current] AS stale_n FROM projection GROUP BY status",
    "Q-09_integrity_report": f"""WITH {_PROJECTION} SELECT defect, count(*) AS n, min(part_id) AS first_part FROM (SELECT part_id, CASE WHEN published_id IS NOT NULL AND preferred_id IS NULL THEN 'published_without_transcript' WHEN published_id IS NOT NULL AND NOT publication_current THEN 'stale_publication' WHEN status = 'meta_ok' AND pubdate IS NULL THEN 'undated' END AS defect FROM projection
      UNION ALL SELECT t.part_id, 'orphan_transcript' AS defect FROM transcripts AS t WHERE NOT EXISTS (SELECT 1 FROM parts AS p WHERE p.part_id = t.part_id)
      UNION ALL SELECT p.part_id, 'broken_publication' AS defect FROM publications AS p WHERE NOT EXISTS (SELECT 1 FROM transcripts AS t WHERE t.transcript_id = p.transcript_id)) AS d WHERE defect IS NOT NULL GROUP BY defect""",
    "Q-10_export": f"WITH {_PREFERRED} SELECT concat(p.video_code, ':p', p.page) AS work_id, REPLACED[v.title; '[0-9]{{4,}}'; '#'] AS title, pref.sha FROM parts AS p JOIN videos AS v ON p.video_id = v.video_id JOIN preferred AS pref ON p.part_id = pref.part_id",
    "Q-11_workflow_status": f"""SELECT 'jobs' AS part, kind, status AS name, count(*) AS n, max(available) AS last_at FROM jobs GROUP BY kind, status
      UNION ALL SELECT 'decisions' AS part, kind, decision AS name, count(*) AS n, max(available) AS last_at FROM (SELECT kind, available, {_RETRY} AS decision FROM (SELECT j.*, coalesce(r.n, 0) AS repaired FROM jobs AS j LEFT JOIN (SELECT repair_of, count(*) AS n FROM jobs WHERE repair_of IS NOT NULL GROUP BY repair_of) AS r ON j.job_id = r.repair_of) AS q) AS d GROUP BY kind, decision
      UNION ALL SELECT 'current_failures' AS part, kind, error_code AS name, count(*) AS n, max(available) AS last_at FROM jobs WHERE status = 'failed' GROUP BY kind, error_code
      UNION ALL SELECT 'past_failures' AS part, kind, error_code AS name, count(*) AS n, max(finished) AS last_at FROM job_attempts WHERE outcome = 'failed' GROUP BY kind, error_code""",
    "Q-12_metadata_search": """WITH t AS (SELECT video_id, JOINED[tag_name; chr(10); place, tag_name] AS tag_text FROM tags GROUP BY video_id), m AS (SELECT v.video_id, v.pubdate, v.video_code, instr(ASCII_LOWER[v.title], 'high') > 0 AS in_title, instr(ASCII_LOWER[coalesce(t.tag_text, '')], 'brand#2') > 0 AS in_tags FROM videos AS v LEFT JOIN t ON v.video_id = t.video_id)
      SELECT m.video_id, p.part_id, CASE WHEN in_title THEN 0 ELSE 1 END AS field_rank, concat(CASE WHEN in_title THEN 'title,' ELSE '' END, CASE WHEN in_tags THEN 'tags' ELSE '' END) AS matched_fields FROM m JOIN parts AS p ON m.video_id = p.video_id WHERE in_title OR in_tags""",
    "Q-14_combined_search": "SELECT source, id, cast(row_number() OVER (ORDER BY source, id) AS bigint) AS rank_no FROM (SELECT source, id FROM (SELECT 0 AS source, video_id AS id FROM videos WHERE instr(ASCII_LOWER[title], 'urgent') > 0 UNION ALL SELECT 1 AS source, doc_id AS id FROM documents WHERE instr(ASCII_LOWER[text], 'license') > 0) AS u ORDER BY source, id LIMIT 200) AS q",
    "Q-15_planning_facts": f"WITH {_PREFERRED} SELECT p.part_id, s.score, pref.transcript_id FROM parts AS p LEFT JOIN (SELECT part_id, max_by(score, assessment_id) AS score FROM assessments WHERE assessor <> 'asr-admission' GROUP BY part_id) AS s ON p.part_id = s.part_id LEFT JOIN preferred AS pref ON p.part_id = pref.part_id AND pref.source_kind <> 'asr-local'",
    "Q-16_metadata_batch": "SELECT v.video_id, v.title, c.display_name, o.state, n.names FROM videos AS v LEFT JOIN creators AS c ON v.mid = c.mid LEFT JOIN (SELECT video_id, max_by(state, seq) AS state FROM observations GROUP BY video_id) AS o ON v.video_id = o.video_id LEFT JOIN (SELECT video_id, JOINED[tag_name; ','; place, tag_name] AS names FROM tags GROUP BY video_id) AS n ON v.video_id = n.video_id",
    "Q-17_readiness": "SELECT j.status, count(*) AS n, COUNT_IF[coalesce(e.open, 0) > 0] AS blocked FROM jobs AS j LEFT JOIN (SELECT edges.job_id, COUNT_IF[p.status <> 'succeeded'] AS open FROM edges JOIN jobs AS p ON edges.needs = p.job_id GROUP BY edges.job_id) AS e ON j.job_id = e.job_id GROUP BY j.status",
    "Q-18_asr_quality": "SELECT assessment_id, greatest(CASE WHEN score < 0.2 THEN 3 WHEN score < 0.5 THEN 2 ELSE 0 END, CASE WHEN assessor = 'asr-admission' THEN 1 ELSE 0 END) AS severity FROM assessments",
    "Q-19_inventory": "SELECT object_id, count(*) AS copies, COUNT_IF[presence = 'present'] AS present_n, max(byte_size) AS byte_size, CASE WHEN COUNT_IF[presence = 'present'] > 1 THEN max(byte_size) * (COUNT_IF[presence = 'present'] - 1) ELSE 0 END AS reclaimable FROM replicas GROUP BY object_id",
    "Q-20_publication_state": "SELECT part_id, count(*) AS releases, max(publication_id) AS head, min(published) AS first_at, max(published) AS last_at FROM publications GROUP BY part_id",
    "Q-21_series": "SELECT c.mid, JOINED[v.video_code; ','; v.pubdate, v.video_code] AS members FROM creators AS c JOIN videos AS v ON c.mid = v.mid GROUP BY c.mid",
    "Q-22_audio_reconciliation": "SELECT coalesce(l.audio_id, o.object_id) AS audio_id, CASE WHEN o.object_id IS NULL THEN 'missing' WHEN l.audio_id IS NULL THEN 'unrecorded' WHEN o.presence = 'missing' THEN 'unreadable' ELSE 'recorded' END AS class FROM (SELECT DISTINCT audio_id FROM audio_links) AS l FULL JOIN (SELECT object_id, min(presence) AS presence FROM replicas GROUP BY object_id) AS o ON l.audio_id = o.object_id",
    # Scalars and text
    "T-01_parse_time": "SELECT page_id, NUMBER[GROUP_OF[stamp; '^(\\d{1,3}):(\\d\\d):(\\d\\d)[,.](\\d{1,3})$'; 1]] * 3600000 + NUMBER[GROUP_OF[stamp; '^(\\d{1,3}):(\\d\\d):(\\d\\d)[,.](\\d{1,3})$'; 2]] * 60000 + NUMBER[GROUP_OF[stamp; '^(\\d{1,3}):(\\d\\d):(\\d\\d)[,.](\\d{1,3})$'; 3]] * 1000 + NUMBER[rpad(GROUP_OF[stamp; '^(\\d{1,3}):(\\d\\d):(\\d\\d)[,.](\\d{1,3})$'; 4], 3, '0')] AS ms FROM (SELECT page_id, concat(page_id % 5, ':', PADDED[page_id % 60; 2], ':', PADDED[page_id * 7 % 60; 2], CASE WHEN page_id % 2 = 0 THEN ',' ELSE '.' END, page_id % 97) AS stamp FROM pages) AS p",
    "T-02_timeline_defects": """SELECT transcript_id, max(CASE WHEN start_ms < 0 OR end_ms <= start_ms OR end_ms > duration_ms + 1 THEN 1 ELSE 0 END) AS out_of_range, max(CASE WHEN start_ms < before_start THEN 1 ELSE 0 END) AS non_monotonic, max(CASE WHEN start_ms < before_end THEN 1 ELSE 0 END) AS overlap
      FROM (SELECT s.*, r.duration_ms, lag(start_ms) OVER (PARTITION BY s.transcript_id ORDER BY ordinal) AS before_start, lag(end_ms) OVER (PARTITION BY s.transcript_id ORDER BY ordinal) AS before_end FROM segments AS s JOIN recordings AS r ON s.transcript_id = r.transcript_id) AS w GROUP BY transcript_id""",
    "T-05_interval_merge": """WITH v AS (SELECT transcript_id, ordinal, start_ms, end_ms, max(end_ms) OVER (PARTITION BY transcript_id ORDER BY start_ms, end_ms, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM segments WHERE end_ms > start_ms AND start_ms >= 0),
      i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach + 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY transcript_id ORDER BY start_ms, end_ms, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM v),
      m AS (SELECT transcript_id, island, max(end_ms) - min(start_ms) AS ms FROM i GROUP BY transcript_id, island) SELECT transcript_id, count(*) AS spans, SUM_INT[ms] AS captured_ms FROM m GROUP BY transcript_id""",
    "T-06_longest_gap": """WITH v AS (SELECT s.transcript_id, ordinal, start_ms, end_ms, duration_ms, max(end_ms) OVER (PARTITION BY s.transcript_id ORDER BY start_ms, end_ms, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM segments AS s JOIN recordings AS r ON s.transcript_id = r.transcript_id WHERE end_ms > start_ms AND start_ms >= 0)
      SELECT transcript_id, greatest(max(greatest(start_ms - coalesce(reach, 0), 0)), max(duration_ms) - max(end_ms), 0) AS longest_gap_ms, SUM_INT[greatest(end_ms - greatest(coalesce(reach, 0), start_ms), 0)] AS union_ms FROM v GROUP BY transcript_id""",
    "T-17_snippets": "SELECT doc_id, CASE WHEN place = 0 THEN substr(text, 1, 120) ELSE concat(CASE WHEN place > 31 THEN '...' ELSE '' END, substr(text, greatest(place - 30, 1), 120), '...') END AS snippet FROM (SELECT doc_id, text, instr(ASCII_LOWER[text], 'license') AS place FROM documents) AS d",
    "T-19_token_estimate": "SELECT doc_id, cast(ceil(BYTES[text] / 3.0) AS bigint) AS tokens FROM documents",
    "T-20_cover_once": "SELECT transcript_id, count(*) AS n, count(*) = max(ordinal) + 1 AND min(ordinal) = 0 AND count(DISTINCT ordinal) = count(*) AS covers FROM segments GROUP BY transcript_id",
    "T-21_lineage_groups": "SELECT SHA[text] AS sha, count(*) AS n, min(transcript_id) AS first_id, count(DISTINCT transcript_id) AS transcripts_n FROM segments GROUP BY SHA[text] HAVING count(*) > 1",
    "T-24_segment_hash": "SELECT transcript_id, SHA[JOINED[concat('[', start_ms, ',', end_ms, ',', trim(text), ']'); ','; ordinal]] AS content_sha FROM segments GROUP BY transcript_id",
    "T-25_date": "SELECT video_id, CASE WHEN pubdate > 0 THEN DATE_TEXT[pubdate] END AS day FROM videos",
    "T-26_language_key": "SELECT doc_id, REPLACED[lower(trim(concat(' AI-', upper(lang), '_x '))); '^ai-|_.*$'; ''] AS language_key FROM documents",
    "T-27_work_id": "SELECT part_id, GROUP_OF[work_id; '^(VID[0-9]+):p([0-9]+)$'; 1] AS video, NUMBER[GROUP_OF[work_id; '^(VID[0-9]+):p([0-9]+)$'; 2]] AS page FROM (SELECT part_id, concat(video_code, ':p', page) AS work_id FROM parts) AS p",
    "T-30_bundle_identity": "SELECT page_id, GROUP_OF[url; '/([a-z]{2})/'; 1] AS section, GROUP_OF[url; '/([a-z]{2})/'; 1] = GROUP_OF[html; '<html lang=\"([a-z]{2})\"'; 1] AS agrees FROM pages",
    "T-31_usage": "SELECT event_id, coalesce(NUMBER[JSON_TEXT[props; tokens]], NUMBER[JSON_TEXT[props; k]], 0) AS tokens FROM events",
    "X-01_redact_text": "SELECT doc_id, REPLACED[REPLACED[text; 'https?://[^\\s]+'; '[url]']; '(?i)(password|passwd|secret|token|api_?key)[\"\\x27]?\\s*[:=]\\s*[\"\\x27]?[A-Za-z0-9+/_.=-]+'; '[credential]'] AS clean FROM documents",
    "X-02_redact_export": """SELECT doc_id, SHA[clean] AS clean_sha, length(clean) AS clean_chars FROM (SELECT doc_id, REPLACED[REPLACED[REPLACED[said; '(?i)(?:sessdata|access[_-]?token|authorization|cookie|token|signature|sign|deadline)\\s*(?:=|:)\\s*[^\\s,;]+'; '[redacted]']; '(?i)https?://[^\\s"\\x27]+(?:sign|deadline|token|auth)[^\\s"\\x27]*'; '[redacted]'];
      '(?is)Traceback \\(most recent call last\\):.*'; '[redacted]'] AS clean FROM (SELECT doc_id, concat(text, CASE doc_id % 5 WHEN 0 THEN ' see https://cdn.example.org/a?auth_key=1&x=2 and go' WHEN 1 THEN ' Cookie: abc=1; rest' WHEN 2 THEN concat(' Traceback (most recent call last):', chr(10), ' in secret') WHEN 3 THEN ' an ordinary https://example.org/page stays' ELSE '' END) AS said FROM documents) AS d) AS c""",
    # State
    "M-01_upsert": "SELECT coalesce(n.video_id, v.video_id) AS video_id, coalesce(n.title, v.title) AS title, greatest(coalesce(n.seen_at, 0), v.pubdate) AS updated FROM videos AS v FULL JOIN (SELECT video_id, max_by(title, seq) AS title, max(seen_at) AS seen_at FROM observations WHERE title IS NOT NULL GROUP BY video_id) AS n ON v.video_id = n.video_id",
    "M-02_insert_absent": "SELECT dedupe_key FROM (SELECT concat(kind, ':', part_id) AS dedupe_key FROM jobs WHERE job_id % 2 = 1) AS n EXCEPT SELECT concat(kind, ':', part_id) AS dedupe_key FROM jobs WHERE job_id % 2 = 0",
    "M-03_versioned_append": "SELECT part_id, source_kind, language, sha, min(transcript_id) AS first_id, cast(row_number() OVER (PARTITION BY part_id, source_kind, language ORDER BY min(transcript_id)) AS bigint) AS version, count(*) - 1 AS unchanged FROM transcripts GROUP BY part_id, source_kind, language, sha",
    "M-05_terminal_fold": "SELECT job_id, max_by(outcome, seq) AS last_outcome, count(*) AS tries, bool_or(outcome = 'succeeded') AS ever FROM job_attempts GROUP BY job_id",
    "M-06_observation_fold": "SELECT n.video_id, f.title, n.newest_state FROM (SELECT video_id, max_by(state, seq) AS newest_state FROM observations GROUP BY video_id) AS n LEFT JOIN (SELECT video_id, title FROM (SELECT video_id, title, row_number() OVER (PARTITION BY video_id ORDER BY seq DESC) AS nth FROM observations WHERE state IN ('present', 'empty')) AS w WHERE nth = 1) AS f ON n.video_id = f.video_id",
    "M-07_transitions": "SELECT seq, part_id, before_kind, kind, NOT (before_kind IS NULL OR concat(before_kind, '>', kind) IN ('granted>revoked', 'granted>hold', 'hold>released', 'released>granted', 'revoked>granted')) AS violation FROM (SELECT seq, part_id, kind, lag(kind) OVER (PARTITION BY part_id ORDER BY seen_at, seq) AS before_kind FROM rights) AS r",
    "M-08_resume_cursor": "SELECT a.run_id, a.ids IS NOT DISTINCT FROM b.ids AS same FROM (SELECT run_id, JOINED[TEXT[part_id]; ','; seq] AS ids FROM attempts GROUP BY run_id) AS a LEFT JOIN (SELECT run_id, JOINED[TEXT[part_id]; ','; seq] AS ids FROM attempts WHERE seq % 101 <> 0 GROUP BY run_id) AS b ON a.run_id = b.run_id",
    # The index holds what was committed up to a high-water mark, and of that only segments that have not changed since.
    "M-09_index_append": "SELECT s.transcript_id, s.ordinal FROM segments AS s LEFT JOIN (SELECT transcript_id, ordinal FROM segments WHERE transcript_id <= (SELECT IDIV[max(doc_id); 2] FROM documents) AND ordinal % 2 = 0) AS held ON s.transcript_id = held.transcript_id AND s.ordinal = held.ordinal WHERE held.transcript_id IS NULL",
    "M-10_cancellation": "SELECT job_id, CASE WHEN status IN ('queued', 'failed') AND part_id % 9 = 0 THEN 'cancelled' ELSE status END AS status FROM jobs",
    "M-11_run_books": "SELECT runs.run_id, runs.kind, count(a.seq) AS tries, COUNT_IF[a.outcome = 'failed'] AS failed FROM runs LEFT JOIN attempts AS a ON runs.run_id = a.run_id GROUP BY runs.run_id, runs.kind",
    "M-04_lease_decision": "SELECT job_id, CASE WHEN available < 800000000 THEN 'expire' WHEN status = 'queued' THEN 'claim' ELSE 'skip' END AS lease FROM jobs",
    # Decisions
    "Z-01_failure_taxonomy": "SELECT error_code, CASE WHEN error_code IS NULL THEN 'none' WHEN error_code LIKE 'http_%' AND NUMBER[GROUP_OF[error_code; 'http_([0-9]+)'; 1]] IN (429, 503) THEN 'throttled' WHEN error_code = 'transport_error' THEN 'transport' ELSE 'input' END AS category, count(*) AS n FROM jobs GROUP BY error_code",
    "Z-02_next_retry": "SELECT job_id, greatest(available, created + CASE least(retries, 3) WHEN 0 THEN 60 WHEN 1 THEN 300 WHEN 2 THEN 1800 ELSE 7200 END) AS next_at FROM jobs WHERE status = 'failed'",
    "Z-03_retry_decision": f"SELECT job_id, {_RETRY} AS decision FROM (SELECT j.*, coalesce(r.n, 0) AS repaired FROM jobs AS j LEFT JOIN (SELECT repair_of, count(*) AS n FROM jobs WHERE repair_of IS NOT NULL GROUP BY repair_of) AS r ON j.job_id = r.repair_of) AS q",
    "Z-04_producer_policy": "SELECT p.part_id, CASE WHEN s.score < 0.4 THEN 'asr' ELSE 'none' END AS plan FROM parts AS p LEFT JOIN (SELECT part_id, max_by(score, assessment_id) AS score FROM assessments GROUP BY part_id) AS s ON p.part_id = s.part_id",
    "Z-05_rights_status": "SELECT part_id, CASE WHEN hold_n > 0 THEN 'hold' WHEN last_kind = 'released' THEN 'unknown' WHEN last_kind = 'revoked' THEN 'revoked' WHEN last_expires < 1705000000 THEN 'expired' ELSE 'granted' END AS status FROM (SELECT part_id, COUNT_IF[kind = 'hold'] AS hold_n, max_by(kind, seq) AS last_kind, max_by(expires, seq) AS last_expires FROM rights GROUP BY part_id) AS r",
    "Z-06_worker_state": "SELECT user_id, CASE WHEN age > 864000 THEN 'stopped' WHEN age > 86400 THEN 'stale' ELSE 'live' END AS state FROM (SELECT user_id, (SELECT max(finished) FROM log) - max(finished) AS age FROM log GROUP BY user_id) AS w",
    "Z-07_refresh_need": "SELECT video_id, CASE WHEN newest_state = 'unavailable' THEN 'later' WHEN age > 172800 THEN 'refresh' ELSE 'fresh' END AS need FROM (SELECT video_id, max_by(state, seq) AS newest_state, (SELECT max(seen_at) FROM observations) - max(seen_at) AS age FROM observations GROUP BY video_id) AS o",
    # Secondary
    "V-01_replay": "SELECT digest, seq, job_id FROM (SELECT digest, seq, job_id, row_number() OVER (PARTITION BY digest ORDER BY finished DESC, seq DESC) AS nth FROM job_attempts WHERE outcome = 'succeeded' AND digest IS NOT NULL) AS w WHERE nth = 1",
    "V-02_replicas": "SELECT r.object_id, s_name AS target, cast(row_number() OVER (PARTITION BY r.object_id ORDER BY r.verified DESC, r.target_id) AS bigint) AS rank_no FROM replicas AS r JOIN supplier ON r.target_id = s_suppkey",
    "V-03_presence": "SELECT object_id, max_by(presence, verified * 100000 + target_id) AS presence FROM replicas GROUP BY object_id",
    "V-04_object_state": "SELECT object_id, bool_or(presence = 'present') AS durable, COUNT_IF[presence <> 'released'] = 6 AS complete FROM replicas GROUP BY object_id",
    "V-05_dependency_repair": "SELECT e.job_id, e.needs FROM edges AS e JOIN jobs AS a ON e.job_id = a.job_id JOIN jobs AS b ON e.needs = b.job_id WHERE a.kind IN ('audio', 'asr') AND b.kind = 'subtitle' AND a.status IN ('queued', 'failed')",
    "V-06_threshold_gate": "SELECT kind, SORTED_SET[reason] AS reasons FROM (SELECT kind, 'failures' AS reason FROM jobs GROUP BY kind HAVING COUNT_IF[status = 'failed'] > 10 UNION ALL SELECT kind, 'queue' AS reason FROM jobs GROUP BY kind HAVING COUNT_IF[status = 'queued'] > 10) AS g GROUP BY kind",
    "V-08_observation_closure": "SELECT o.seq FROM observations AS o WHERE o.video_id IN (SELECT video_id FROM videos WHERE mid % 3 = 0)",
    "V-09_retry_guard": f"SELECT kind, decision, count(*) AS n FROM (SELECT kind, CASE WHEN kind NOT IN ('asr', 'audio') THEN 'not_allowed' ELSE {_RETRY} END AS decision FROM (SELECT j.*, 0 AS repaired FROM jobs AS j) AS q) AS d GROUP BY kind, decision",
    "V-10_package_retention": "SELECT r.run_id, n.run_id IS NOT NULL OR r.started >= (SELECT max(started) FROM runs) - 86400 AS kept FROM runs AS r LEFT JOIN (SELECT run_id FROM runs ORDER BY started DESC, run_id DESC LIMIT 10) AS n ON r.run_id = n.run_id",
    "V-11_increasing_time": "SELECT part_id, greatest(1704067200, max(published) + 1) AS next_at FROM publications GROUP BY part_id",
    "V-13_nested_values": "SELECT v.video_id, count(p.part_id) AS part_n, JOINED[CASE WHEN p.part_id IS NOT NULL THEN concat(p.page, ':', p.duration_ms) END; ','; p.page] AS part_text FROM videos AS v LEFT JOIN parts AS p ON v.video_id = p.video_id GROUP BY v.video_id",
    "V-14_binding_check": "SELECT p.publication_id, t.sha IS DISTINCT FROM q.sha AS differs FROM publications AS p JOIN transcripts AS t ON p.transcript_id = t.transcript_id LEFT JOIN (SELECT part_id, max_by(sha, transcript_id) AS sha FROM transcripts GROUP BY part_id) AS q ON p.part_id = q.part_id",
    "V-15_issue_register": "SELECT SHA[concat(transcript_id, ':', ordinal)] AS issue_id, transcript_id, ordinal FROM segments WHERE end_ms <= start_ms",
    "V-16_deadlines": "SELECT part_id, least(7200000, greatest(600000, 120000 + duration_ms * 3)) AS timeout_ms FROM parts",
    "V-17_caption_choice": "SELECT part_id, min_by(transcript_id, cast(length(text) AS bigint) * 1000000 + transcript_id) AS transcript_id FROM transcripts WHERE length(trim(text)) > 0 AND source_kind <> 'asr-local' GROUP BY part_id",
    "V-20_reference_conflicts": "SELECT page, count(DISTINCT sha) AS shas FROM (SELECT part_id % 50 AS page, sha FROM transcripts UNION ALL SELECT audio_id AS page, sha FROM audio_objects) AS r GROUP BY page HAVING count(DISTINCT sha) > 1",
    "V-12_field_projection": "SELECT o.video_id, v.title AS title, o.newest_seq, o.newest_seq IS NULL OR v.video_id IS NULL AS unbound FROM (SELECT video_id, max(CASE WHEN state = 'present' THEN seq END) AS newest_seq FROM observations GROUP BY video_id) AS o LEFT JOIN videos AS v ON o.video_id = v.video_id",
    "V-18_chain_recovery": "SELECT j.job_id, SHA[concat(j.job_id, ':', coalesce(TEXT[r.job_id], ''), ':', j.status)] AS plan_id, r.job_id IS NULL AS missing_base FROM jobs AS j LEFT JOIN jobs AS r ON j.repair_of = r.job_id WHERE j.repair_of IS NOT NULL",
    "V-19_sample_evidence": "SELECT t.sha, count(*) AS requests, count(p.publication_id) AS answered, count(DISTINCT t.part_id) AS part_n FROM transcripts AS t LEFT JOIN publications AS p ON t.transcript_id = p.transcript_id GROUP BY t.sha",
    "S-20_coverage_sink": f"{_ALL_STATE} SELECT concat(pipeline_state, ',', TEXT[count(*)]) AS csv_line FROM state GROUP BY pipeline_state",
    "ST-07_session_blocks": """SELECT conv_id, cast(session AS bigint) AS session_no, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS turn_n FROM (SELECT *, sum(CASE WHEN start_ms - before_end > 1500 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session
      FROM (SELECT conv_id, turn, start_ms, end_ms, lag(end_ms) OVER (PARTITION BY conv_id ORDER BY turn) AS before_end FROM turns) AS w) AS g GROUP BY conv_id, session""",
    "X-03_links_in_texts": "SELECT doc_id, REPLACED[text; 'https?://[^\\s/@]+@[^\\s]+|https?://[^\\s]*[?&](token|sig|key|auth)=[^\\s]*'; '[redacted]'] AS clean FROM documents",
}
