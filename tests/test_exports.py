"""Exports: values that are hard to write, replacement, and what is refused."""

import os

import pytest

from tessera.operators.retries import failed_page
from tessera.sources.exports import export, imported, srt_time
from tessera.sources.scratch import Scratch

SCHEMA = "id long, text string, tags array<string>, inner struct<a: long, b: string>, x double"
ROWS = [(1, 'a, "b"\nc', ["x", None], (1, None), 1.5), (2, None, None, None, None), (3, "é词 '", [], (None, ""), -0.0), (4, "back\\slash", ["]"], (5, '"'), 1e300)]


def test_json_keeps_nulls_and_nesting(spark):
    with Scratch(spark) as s:
        path = export(spark.createDataFrame(ROWS, SCHEMA), s.path("out"), "json")
        got = sorted(imported(spark, path, "json", SCHEMA).collect())
        assert [(r[0], r[1], r[2], r[3] and tuple(r[3]), r[4]) for r in got] == ROWS


def test_csv_has_a_header_and_empty_fields_for_nulls(spark):
    with Scratch(spark) as s:
        path = export(spark.createDataFrame(ROWS, SCHEMA), s.path("out"), "csv", ["text", "id", "tags"], files=1)
        (part,) = [f for f in os.listdir(path.removeprefix("file://")) if f.endswith(".csv")]
        lines = open(f"{path.removeprefix('file://')}/{part}").read()
        assert lines.startswith("text,id,tags\n") and "\n,2,\n" in lines
        got = sorted(imported(spark, path, "csv", "text string, id long, tags string").collect(), key=lambda r: r["id"])
        assert [(r["id"], r["text"]) for r in got] == [(r[0], r[1]) for r in ROWS] and got[0]["tags"] == '["x",null]'


def test_a_new_export_takes_the_place_of_the_old_one(spark):
    with Scratch(spark) as s:
        path = s.path("out")
        for n in (5, 3):
            export(spark.range(n), path, "json")
            assert imported(spark, path, "json", "id long").count() == n
        with pytest.raises(Exception, match="divide|DIVIDE"):
            export(spark.sql("SELECT id, 1 div (id - 1) AS x FROM range(3)"), path, "json")
        assert imported(spark, path, "json", "id long").count() == 3
        with pytest.raises(ValueError):
            export(spark.range(1), path, "xml")
        with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
            imported(spark, path, "json", "id array<long>").collect()


def test_srt_times(spark):
    rows = spark.createDataFrame([(0,), (3_599_999,), (360_000_001,)], "ms long")
    assert [r[0] for r in rows.select(srt_time(rows.ms)).collect()] == ["00:00:00,000", "00:59:59,999", "100:00:00,001"]


def test_pages_of_failed_jobs(spark):
    jobs = spark.createDataFrame([(k, "asr", "x", "failed" if k % 2 else "queued") for k in range(10)], "job_id long, kind string, error_code string, status string")
    decided = spark.createDataFrame([(k, "unknown", "policy_denied", 0) for k in range(10)], "job_id long, category string, reason string, next_at long")
    attempts = spark.createDataFrame([(3, 1, 10, "failed"), (3, 2, 10, "succeeded"), (3, 0, 11, "lost")], "job_id long, seq long, finished long, outcome string")
    stands = spark.createDataFrame([(3, 8, "failed"), (3, 6, "queued"), (3, 7, "running")], "job_id long, by_id long, status string")
    rows = {r["job_id"]: r for r in failed_page(jobs, decided, attempts, stands).collect()}
    assert sorted(rows) == [1, 3, 5, 7, 9]
    assert (rows[3]["attempts_n"], rows[3]["last_outcome"], rows[3]["last_at"], rows[3]["replacements_n"], rows[3]["active_id"]) == (3, "lost", 11, 3, 6)
    assert (rows[1]["attempts_n"], rows[1]["last_outcome"], rows[1]["replacements_n"], rows[1]["active_id"]) == (0, None, 0, None)
    assert sorted(r["job_id"] for r in failed_page(jobs, decided, attempts, stands, after=3, limit=2).collect()) == [5, 7]
