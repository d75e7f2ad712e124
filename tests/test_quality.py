"""Content signals, the repetition gate and admission, case by case."""

import pytest

from tessera.functions import quality as q

CUES = "transcript_id long, ordinal long, start_ms long, end_ms long, text string, confidence double"


def cues(*rows):
    return [(1, k, a, b, t, c) for k, (a, b, t, c) in enumerate(rows)]


@pytest.mark.parametrize(("rows", "want"), [
    (cues((0, 2000, "a plain cue", 0.9)), set()),
    (cues((0, 2000, "a plain cue", 0.4)), {"low_confidence"}),
    (cues((0, 2000, "，opens on a mark", None)), {"leading_mark"}),
    (cues((0, 2000, ",ascii marks open cues", None)), set()),
    (cues((0, 999, "five5", None)), {"fragment"}),
    (cues((0, 999, "、six 66、", None)), {"leading_mark"}),
    (cues((0, 1000, "five5", None)), set()),
    (cues((0, 2000, "x" * 30 + "y" * 31, None)), {"overlong", "repeated_ngram"}),
    (cues((0, 2000, "the same", None), (2000, 4000, "the same", None)), {"duplicate_adjacent"}),
    (cues((0, 2000, "the same", None), (2000, 4000, "between them", None), (4000, 6000, "the same", None)), set()),
    (cues((0, 2000, "abcdefgh1", None), (2000, 4000, "abcdefgh2", None), (4000, 6000, "abcdefgh3", None)), {"repeated_ngram"}),
    (cues((0, 2000, "abcdefgh1", None), (2000, 4000, "abcdefgh2", None), (4000, 6000, "abcdefgh", None)), set()),
    (cues((0, 2000, None, None), (2000, 4000, None, None)), set()),
])
def test_each_signal(spark, rows, want):
    (got,) = q.content_signals(spark.createDataFrame(rows, CUES)).collect()
    assert {k for k, v in got.asDict().items() if v and k not in ("transcript_id", "low_n")} == want


def test_only_what_is_looked_at_counts(spark):
    filler = "".join(chr(0x4E00 + k % 20_000) for k in range(210_000))
    early = cues((0, 10**9, "abcdefgh" + filler[:1000] + "abcdefgh" + filler[1000:3000] + "abcdefgh!", None))
    late = cues((0, 10**9, filler[:100_000], None), (10**9, 2 * 10**9, filler[5_000:20_000] + "abcdefgh" * 3, None))
    assert q.content_signals(spark.createDataFrame(early, CUES)).first()["repeated_ngram"] == 1
    assert q.content_signals(spark.createDataFrame(late, CUES)).count() == 1


def test_the_gate_needs_length_density_and_repetition(spark):
    burst = "one two three four " * 60
    rows = [(1, 0, 0, 5000, burst), (2, 0, 0, 60_000, burst), (3, 0, 0, 5000, burst[:990]), (4, 0, 0, 0, " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400))), (5, 0, 0, 5000, "词" * 1000), (6, 0, 0, 5000, "1" * 1000), (7, 0, 0, 5000, None)]
    got = {r["transcript_id"]: (r["repeats"], r["refused"]) for r in q.dense_repetition(spark.createDataFrame(rows, "transcript_id long, ordinal long, start_ms long, end_ms long, text string")).collect()}
    assert got == {1: (60, True), 4: (1, False), 5: (997, True), 6: (0, False)}


FACTS = "transcript_id long, duration_ms long, decoded_s double, produced_s double, ratio double, minimum double, short boolean, review boolean, unresolved boolean"
MEASURED = (1, 10_000, 10.0, 9.0, 0.9, 0.5, False, False, False)


@pytest.mark.parametrize(("segments", "facts", "status", "coverage", "issues"), [
    ([(0.0, 4.0, "a"), (3.0, 9.0, "b")], MEASURED, "usable", "measured", ""),
    ([(0.0, 4.0, "a"), (3.0, 9.0, "b")], (1, 10_000, None, None, None, None, None, False, False), "unknown", "unknown", ""),
    ([], (1, 10_000, None, None, None, None, None, False, False), "unusable", "unknown", "asr_empty_output:1"),
    ([(0.0, 9.0, "a")], (1, 10_000, 10.0, 9.0, 0.9, 0.95, True, False, False), "needs-review", "short", "asr_coverage_short:1"),
    ([(0.0, 9.0, "a")], (1, 10_000, 10.0, 9.0, 0.9, 0.95, False, False, False), "unusable", "invalid", "asr_coverage_invalid:1"),
    ([(0.0, 9.0, "a")], (1, 10_000, 10.0, 9.0, 0.8, 0.5, False, False, False), "unusable", "invalid", "asr_coverage_invalid:1"),
    ([(0.0, 9.06, "a")], MEASURED, "unusable", "invalid", "asr_coverage_inconsistent:1"),
    ([(0.0, 9.04, "a")], MEASURED, "usable", "measured", ""),
    ([(0.0, 4.0, "a"), (3.0, 9.0, "b")], (*MEASURED[:7], True, False), "needs-review", "measured", "asr_diagnostics_review_required:1"),
    ([(0.0, 4.0, "a"), (3.0, 9.0, "b")], (*MEASURED[:7], True, True), "unusable", "measured", "asr_alignment_unresolved:1,asr_diagnostics_review_required:1"),
    ([(0.0, float("nan"), "a"), (0.0, 9.0, "b")], MEASURED, "unusable", "measured", "asr_timestamp_nonfinite:1"),
    ([(None, 1.0, "a"), (0.0, 9.0, "b")], MEASURED, "unusable", "measured", "asr_timestamp_invalid:1"),
    ([(5.0, 6.0, "a"), (0.0, 2e9, "b"), (0.0, 9.0, "c")], MEASURED, "unusable", "measured", "asr_timestamp_backward:1,asr_timestamp_out_of_range:1"),
    ([(-1.0, 8.0, "a"), (1.0, 1.0, "b")], MEASURED, "unusable", "measured", "asr_timestamp_negative:1,asr_timestamp_nonpositive:1"),
    ([(0.0, 10.051, "a")], (1, 10_000, 10.0, 10.0, 1.0, 0.5, False, False, False), "unusable", "measured", "asr_timestamp_out_of_bounds:1"),
    ([(0.0, 10.05, "a")], (1, 10_000, 10.0, 10.0, 1.0, 0.5, False, False, False), "usable", "measured", ""),
    ([(0.0, 9.0, " \t")], MEASURED, "unusable", "measured", "asr_text_empty:1"),
    ([(0.0, 9.0, "a\r\n \r\nb")], MEASURED, "unusable", "measured", "asr_text_unrepresentable:1"),
    ([(0.0, 9.0, "a\0b")], MEASURED, "unusable", "measured", "asr_text_unrepresentable:1"),
    ([(0.0, 9.0, "\na\nb\n\n")], MEASURED, "usable", "measured", ""),
])
def test_admission(spark, segments, facts, status, coverage, issues):
    rows = spark.createDataFrame([(1, k, *s) for k, s in enumerate(segments)], "transcript_id long, ordinal long, start_s double, end_s double, text string")
    (got,) = q.admission(rows, spark.createDataFrame([facts], FACTS)).collect()
    assert (got["status"], got["coverage"], got["issues"], got["segment_count"]) == (status, coverage, issues, len(segments))
    assert got["timeline"] == ("invalid" if "asr_timestamp_" in issues else "valid")
