"""Quality of transcripts: content signals, the gate against dense repetition, and admission with its issue codes.

Operators over relations of cues; thresholds are parameters.  Whatever is sequential (adjacent cues, the cue before) is a window over one transcript by its cues' order.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.dialect import relation

from .text import LOOKED_AT, REPEATS, WINDOW_CHARS, most_repeated

#: Fixed values of content signals: marks that no cue opens with, and the bounds of a fragment and of an overlong cue.
LEADING, FRAGMENT_CHARS, FRAGMENT_MS, OVERLONG, LOW_CONFIDENCE = "，。！？、；：", 6, 1000, 60, 0.4
#: Fixed values of the gate: characters of a segment, characters a second, characters looked at, words of a run, and its occurrences.
DENSE_CHARS, DENSE_RATE, DENSE_LOOKED_AT, RUN_WORDS, RUN_REPEATS = 1000, 100, 100_000, 4, 24
#: Fixed values of admission: the timeline's bound and the tolerance in milliseconds, and that of a coverage's ratio.
MAX_TIMELINE_MS, TOLERANCE_MS, RATIO_TOLERANCE = 10**12, 50, 1e-6


def repeats_windows(texts: pd.Series) -> pd.Series:
    """Whether a window of each text occurs often enough; the last full window isn't counted.

    Python slices a text in constant time, where the engine's substring goes through it from its start."""
    return pd.Series([max(Counter([t[k : k + WINDOW_CHARS] for k in range(len(t) - WINDOW_CHARS)]).values(), default=0) >= REPEATS for t in texts], dtype=bool)


def content_signals(cues: DataFrame, low_confidence: float = LOW_CONFIDENCE, overlong: int = OVERLONG) -> DataFrame:
    """One row per transcript of (transcript_id, ordinal, start_ms, end_ms, text, confidence): whether each signal is there, and how many cues are low.

    Only as much of a transcript is gathered as is looked at for repetition.
    """
    order = Window.partitionBy("transcript_id").orderBy("ordinal")
    text = F.coalesce("text", F.lit(""))
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = cues.withColumn("text", text).withColumn("same", (F.col("text") != "") & (F.col("text") == F.lag("text").over(order))).withColumn("before", before)
    bare = F.btrim("text", F.lit(LEADING))
    seen = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int"))
    flags = rows.groupBy("transcript_id").agg(
        F.count(F.when(F.col("confidence") <= low_confidence, 1)).alias("low_n"),
        seen(F.substring("text", 1, 1).isin(*LEADING)).alias("leading_mark"),
        seen((F.length(bare) < FRAGMENT_CHARS) & (F.col("end_ms") - F.col("start_ms") < FRAGMENT_MS)).alias("fragment"),
        seen(F.length("text") > overlong).alias("overlong"),
        seen(F.col("same")).alias("duplicate_adjacent"),
        F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("before") < LOOKED_AT, F.struct("ordinal", "text")))), lambda x: x["text"]), ""), 1, LOOKED_AT).alias("joined"),
    )
    repeated = (F.pandas_udf(repeats_windows, "boolean"))("joined").cast("int")
    return flags.select("transcript_id", "low_n", (F.col("low_n") > 0).cast("int").alias("low_confidence"), "leading_mark", "fragment", "overlong", "duplicate_adjacent", repeated.alias("repeated_ngram"))


def folded(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def dense_repetition(segments: DataFrame, characters: int = DENSE_CHARS, rate: int = DENSE_RATE, repeats: int = RUN_REPEATS) -> DataFrame:
    """The dense segments of (transcript_id, ordinal, start_ms, end_ms, text), how often their most frequent run of words occurs, and whether that refuses them.

    Long text alone, fast speech alone and rhetorical repetition refuse nothing.
    """
    span = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(1))
    dense = segments.where((F.length("text") >= characters) & (F.length("text") * 1000 > span * rate))
    words = F.regexp_extract_all(folded(F.substring("text", 1, DENSE_LOOKED_AT)), F.lit("[a-z]+|[一-鿿]"), F.lit(0))
    rows = dense.select("transcript_id", "ordinal", F.length("text").cast("long").alias("characters"), words.alias("words"))
    runs = F.when(F.size("words") >= RUN_WORDS, F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - RUN_WORDS + 1, F.lit(1))), lambda k: F.array_join(F.slice(F.col("words"), k, F.lit(RUN_WORDS)), " ")))
    return rows.select("transcript_id", "ordinal", "characters", F.coalesce(most_repeated(runs), F.lit(0)).cast("long").alias("repeats")).withColumn("refused", F.col("repeats") >= repeats)


def admission(cues: DataFrame, facts: DataFrame, tolerance_ms: int = TOLERANCE_MS) -> DataFrame:
    """One row per transcript of ``facts``: its status, what its timeline and coverage are, and its issues by code.

    ``cues``: (transcript_id, ordinal, start_s, end_s, text) with times in seconds as they came; ``facts``: (transcript_id, duration_ms, decoded_s, produced_s, ratio, minimum, short,
    review, unresolved), where a coverage whose numbers are all null was not measured.  Unknown is no defect: quiet gaps and overlaps are no issues.
    """
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) <= MAX_TIMELINE_MS)
    names = ("decoded_s", "produced_s", "ratio", "minimum")
    given = F.lit(False)
    whole = F.col("short").isNotNull()
    for c in names:
        given, whole = given | F.col(c).isNotNull(), whole & number(c)
    sane = (F.col("decoded_s") > 0) & (F.col("produced_s") >= 0) & (F.col("produced_s") <= F.col("decoded_s")) & F.col("ratio").between(0, 1) & (F.col("minimum") > 0) & (F.col("minimum") <= 1)
    agrees = (F.abs(F.col("ratio") - F.try_divide("produced_s", "decoded_s")) <= RATIO_TOLERANCE) & (F.col("short") == (F.col("ratio") < F.col("minimum")))
    facts = facts.withColumn("measured", given).withColumn("valid", given & whole & F.coalesce(sane & agrees, F.lit(False)))
    bound = F.when(F.col("valid"), F.round(F.col("decoded_s") * 1000).cast("long")).otherwise(F.col("duration_ms"))
    facts = facts.withColumn("bound", F.when(bound > 0, bound))

    start, end = F.col("start_s"), F.col("end_s")
    missing = start.isNull() | end.isNull()
    infinite = F.isnan(start) | F.isnan(end) | start.isin(float("inf"), float("-inf")) | end.isin(float("inf"), float("-inf"))
    beyond = (F.abs(start) > MAX_TIMELINE_MS / 1000) | (F.abs(end) > MAX_TIMELINE_MS / 1000)
    first = F.when(missing, "asr_timestamp_invalid").when(infinite, "asr_timestamp_nonfinite").when(beyond, "asr_timestamp_out_of_range")
    rows = cues.join(facts.select("transcript_id", "bound"), "transcript_id").withColumn("broken", first)
    start_ms, end_ms = F.round(start * 1000).cast("long"), F.round(end * 1000).cast("long")
    fine = rows.where("broken IS NULL").withColumn("start_ms", start_ms).withColumn("end_ms", end_ms)
    lines = F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), r"^\s+|\s+$", "")
    blank = F.col("text").isNull() | F.col("text").rlike(r"^\s*$")
    codes = F.array_compact(F.array(
        F.when(start < 0, "asr_timestamp_negative"),
        F.when((end <= start) | (F.col("end_ms") <= F.col("start_ms")), "asr_timestamp_nonpositive"),
        F.when(F.col("start_ms") < F.lag("start_ms").over(Window.partitionBy("transcript_id").orderBy("ordinal")), "asr_timestamp_backward"),
        F.when(end * 1000 > F.col("bound") + tolerance_ms, "asr_timestamp_out_of_bounds"),
        F.when(blank, "asr_text_empty").when(F.instr("text", "\0").__gt__(0) | lines.rlike(r"\n\s*\n"), "asr_text_unrepresentable"),
    ))
    fine = fine.withColumn("codes", codes)
    per_cue = fine.select("transcript_id", "codes", F.col("start_s").alias("a"), F.col("end_s").alias("b")).unionByName(rows.where("broken IS NOT NULL").select("transcript_id", F.array("broken").alias("codes"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b")))
    spans = per_cue.groupBy("transcript_id").agg(F.count("*").alias("segment_count"), (F.max("b") - F.min("a")).alias("span"), F.count("a").alias("spanned"))
    counted = per_cue.select("transcript_id", F.explode("codes").alias("code")).groupBy("transcript_id", "code").agg(F.count("*").alias("n"))
    counted = counted.groupBy("transcript_id").agg(F.collect_list(F.struct("code", "n")).alias("of_cues"))
    out = facts.join(spans, "transcript_id", "left").join(counted, "transcript_id", "left").withColumn("segment_count", F.coalesce("segment_count", F.lit(0)))
    inconsistent = F.col("valid") & (F.col("spanned") > 0) & (F.abs(F.least("span", "decoded_s") - F.col("produced_s")) > tolerance_ms / 1000)
    own = F.array_compact(F.array(*[
        F.when(c, F.struct(F.lit(code).alias("code"), F.lit(1).cast("long").alias("n")))
        for code, c in (
            ("asr_alignment_unresolved", F.col("unresolved")), ("asr_coverage_inconsistent", inconsistent), ("asr_coverage_invalid", F.col("measured") & ~F.col("valid")),
            ("asr_coverage_short", F.col("valid") & F.col("short")), ("asr_diagnostics_review_required", F.col("review")), ("asr_empty_output", F.col("segment_count") == 0),
        )
    ]))
    out = out.withColumn("counts", F.array_sort(F.concat(own, F.coalesce("of_cues", F.array().cast("array<struct<code: string, n: bigint>>"))))).withColumn("found", F.transform("counts", lambda x: x["code"]))
    soft = ["asr_coverage_short", "asr_diagnostics_review_required"]
    has = lambda code: F.array_contains("found", code)
    unfit = ["asr_empty_output", "asr_timestamp_invalid", "asr_timestamp_nonfinite", "asr_timestamp_out_of_range", "asr_timestamp_negative", "asr_timestamp_nonpositive", "asr_text_empty"]
    status = F.when(F.size(F.array_except("found", F.array(*map(F.lit, soft)))) > 0, "unusable").when(has(soft[0]) | has(soft[1]), "needs-review").when(F.col("bound").isNull() | ~F.col("valid"), "unknown").otherwise("usable")
    coverage = F.when(has("asr_coverage_invalid") | has("asr_coverage_inconsistent"), "invalid").when(F.col("valid") & F.col("short"), "short").when(F.col("valid"), "measured").otherwise("unknown")
    return out.select(
        "transcript_id", status.alias("status"), (~F.arrays_overlap("found", F.array(*map(F.lit, unfit)))).alias("representable"),
        F.when(F.exists("found", lambda c: c.startswith("asr_timestamp_")), "invalid").otherwise("valid").alias("timeline"), coverage.alias("coverage"), "segment_count",
        F.array_join(F.transform("counts", lambda x: F.concat(x["code"], F.lit(":"), x["n"].cast("string"))), ",").alias("issues"),
    )


# ----------------------------------------------------------------------------------------------- registered queries


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-03."""
    return content_signals(relation(spark, sf_dir, "cues"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-13."""
    return dense_repetition(relation(spark, sf_dir, "bursts"))


def admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-14."""
    return admission(relation(spark, sf_dir, "raw_cues"), relation(spark, sf_dir, "coverage_facts"))


QUERIES = {"T-03_content_signals": signals, "T-13_dense_text": dense, "T-14_admission": admitted}
ORACLES = {
    "T-03_content_signals": f"""WITH j AS (SELECT transcript_id, substr(string_agg(text, '' ORDER BY ordinal), 1, {LOOKED_AT}) AS t FROM cues GROUP BY transcript_id),
        g AS (SELECT transcript_id, w, count(*) AS n FROM (SELECT transcript_id, unnest(list_transform(range(1, length(t) - {WINDOW_CHARS - 1}), lambda k: substr(t, k, {WINDOW_CHARS}))) AS w FROM j WHERE length(t) > {WINDOW_CHARS}) GROUP BY ALL),
        m AS (SELECT transcript_id, max(n) AS most FROM g GROUP BY transcript_id)
        SELECT c.transcript_id, count(*) FILTER (confidence <= {LOW_CONFIDENCE}) AS low_n, cast(count(*) FILTER (confidence <= {LOW_CONFIDENCE}) > 0 AS int) AS low_confidence,
        max(cast(substr(text, 1, 1) IN ({', '.join(f"'{x}'" for x in LEADING)}) AS int)) AS leading_mark, max(cast(length(trim(text, '{LEADING}')) < {FRAGMENT_CHARS} AND end_ms - start_ms < {FRAGMENT_MS} AS int)) AS fragment,
        max(cast(length(text) > {OVERLONG} AS int)) AS overlong, max(cast(coalesce(text <> '' AND text = before_text, FALSE) AS int)) AS duplicate_adjacent, max(cast(coalesce(most >= {REPEATS}, FALSE) AS int)) AS repeated_ngram
        FROM (SELECT *, lag(text) OVER (PARTITION BY transcript_id ORDER BY ordinal) AS before_text FROM cues) AS c LEFT JOIN m ON m.transcript_id = c.transcript_id GROUP BY c.transcript_id""",
    "T-13_dense_text": f"""WITH d AS (SELECT *, regexp_extract_all(replace(lower(substr(text, 1, {DENSE_LOOKED_AT})), 'ß', 'ss'), '[a-z]+|[一-鿿]') AS w FROM bursts WHERE length(text) >= {DENSE_CHARS} AND length(text) * 1000 > greatest(end_ms - start_ms, 1) * {DENSE_RATE}),
        g AS (SELECT transcript_id, ordinal, run, count(*) AS n FROM (SELECT transcript_id, ordinal, unnest(list_transform(range(1, len(w) - {RUN_WORDS - 2}), lambda k: w[k:k + {RUN_WORDS - 1}])) AS run FROM d WHERE len(w) >= {RUN_WORDS}) GROUP BY ALL)
        SELECT d.transcript_id, d.ordinal, max(length(text)) AS characters, coalesce(max(n), 0) AS repeats, coalesce(max(n), 0) >= {RUN_REPEATS} AS refused FROM d LEFT JOIN g USING (transcript_id, ordinal) GROUP BY d.transcript_id, d.ordinal""",
    "T-14_admission": f"""WITH f AS (SELECT *, coalesce(decoded_s, produced_s, ratio, minimum) IS NOT NULL AS measured,
            coalesce(short IS NOT NULL AND decoded_s > 0 AND decoded_s <= {MAX_TIMELINE_MS} AND produced_s >= 0 AND produced_s <= decoded_s AND ratio BETWEEN 0 AND 1 AND minimum > 0 AND minimum <= 1 AND abs(ratio - produced_s / decoded_s) <= {RATIO_TOLERANCE} AND short = (ratio < minimum), FALSE) AS valid FROM coverage_facts),
        b AS (SELECT *, CASE WHEN CASE WHEN valid THEN round(decoded_s * 1000) ELSE duration_ms END > 0 THEN CASE WHEN valid THEN round(decoded_s * 1000) ELSE duration_ms END END AS bound FROM f),
        c AS (SELECT r.*, b.bound, CASE WHEN start_s IS NULL OR end_s IS NULL THEN 'asr_timestamp_invalid' WHEN isnan(start_s) OR isnan(end_s) OR isinf(start_s) OR isinf(end_s) THEN 'asr_timestamp_nonfinite' WHEN abs(start_s) > {MAX_TIMELINE_MS // 1000} OR abs(end_s) > {MAX_TIMELINE_MS // 1000} THEN 'asr_timestamp_out_of_range' END AS broken FROM raw_cues AS r JOIN b USING (transcript_id)),
        g AS (SELECT *, lag(round(start_s * 1000)) OVER (PARTITION BY transcript_id ORDER BY ordinal) AS before_ms, regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS lines FROM c WHERE broken IS NULL),
        i AS (SELECT transcript_id, broken AS code FROM c WHERE broken IS NOT NULL
            UNION ALL SELECT transcript_id, 'asr_timestamp_negative' FROM g WHERE start_s < 0 UNION ALL SELECT transcript_id, 'asr_timestamp_nonpositive' FROM g WHERE end_s <= start_s OR round(end_s * 1000) <= round(start_s * 1000)
            UNION ALL SELECT transcript_id, 'asr_timestamp_backward' FROM g WHERE round(start_s * 1000) < before_ms UNION ALL SELECT transcript_id, 'asr_timestamp_out_of_bounds' FROM g WHERE end_s * 1000 > bound + {TOLERANCE_MS}
            UNION ALL SELECT transcript_id, CASE WHEN regexp_matches(text, '^\\s*$') THEN 'asr_text_empty' ELSE 'asr_text_unrepresentable' END FROM g WHERE regexp_matches(text, '^\\s*$') OR regexp_matches(lines, '\\n\\s*\\n')
            UNION ALL SELECT transcript_id, 'asr_coverage_invalid' FROM b WHERE measured AND NOT valid UNION ALL SELECT transcript_id, 'asr_coverage_short' FROM b WHERE valid AND short
            UNION ALL SELECT transcript_id, 'asr_diagnostics_review_required' FROM b WHERE review UNION ALL SELECT transcript_id, 'asr_alignment_unresolved' FROM b WHERE unresolved
            UNION ALL SELECT transcript_id, 'asr_empty_output' FROM b WHERE transcript_id NOT IN (SELECT transcript_id FROM c)
            UNION ALL SELECT b.transcript_id, 'asr_coverage_inconsistent' FROM b JOIN (SELECT transcript_id, max(end_s) - min(start_s) AS span FROM g GROUP BY transcript_id) AS s USING (transcript_id) WHERE valid AND abs(least(span, decoded_s) - produced_s) > {TOLERANCE_MS / 1000}),
        n AS (SELECT transcript_id, code, count(*) AS n FROM i GROUP BY ALL), a AS (SELECT transcript_id, string_agg(concat(code, ':', n), ',' ORDER BY code) AS issues, list(code) AS codes FROM n GROUP BY transcript_id)
        SELECT b.transcript_id, CASE WHEN len(list_filter(coalesce(codes, []), lambda x: x NOT IN ('asr_coverage_short', 'asr_diagnostics_review_required'))) > 0 THEN 'unusable' WHEN len(coalesce(codes, [])) > 0 THEN 'needs-review' WHEN bound IS NULL OR NOT valid THEN 'unknown' ELSE 'usable' END AS status,
        len(list_filter(coalesce(codes, []), lambda x: x IN ('asr_empty_output', 'asr_timestamp_invalid', 'asr_timestamp_nonfinite', 'asr_timestamp_out_of_range', 'asr_timestamp_negative', 'asr_timestamp_nonpositive', 'asr_text_empty'))) = 0 AS representable,
        CASE WHEN len(list_filter(coalesce(codes, []), lambda x: starts_with(x, 'asr_timestamp_'))) > 0 THEN 'invalid' ELSE 'valid' END AS timeline,
        CASE WHEN list_contains(coalesce(codes, []), 'asr_coverage_invalid') OR list_contains(coalesce(codes, []), 'asr_coverage_inconsistent') THEN 'invalid' WHEN valid AND short THEN 'short' WHEN valid THEN 'measured' ELSE 'unknown' END AS coverage,
        (SELECT count(*) FROM c WHERE c.transcript_id = b.transcript_id) AS segment_count, coalesce(issues, '') AS issues FROM b LEFT JOIN a ON a.transcript_id = b.transcript_id""",
}
