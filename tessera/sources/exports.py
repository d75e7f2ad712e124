"""Exports as files: CSV and JSON lines with pinned columns, and cue files, each set replaced as a whole.

Tasks write the files under a new name in the shared folder; only when all are there does the new set take the place of the old one, so a reader finds one or the other, and
what a killed export wrote is never read.  CSV has a header and writes nulls as empty fields, as a table for people does; JSON keeps nulls, nested values and types.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.statements import STATEMENTS
from tessera.plans.dialect import relation, spark_query

from .scratch import Scratch

FORMATS = ("csv", "json")


def export(df: DataFrame, path: str, kind: str, columns: list[str] | None = None, files: int | None = None) -> str:
    """Writes ``columns`` in their order and replaces what was at ``path``; returns the path."""
    if kind not in FORMATS:
        raise ValueError(f"no such format: {kind}")
    rows = df.select(*(columns or df.columns))
    if files is not None:
        rows = rows.repartition(files)
    spark = df.sparkSession
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    if kind == "csv":
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in rows.dtypes]
        rows.select(*flat).write.option("header", True).option("nullValue", "").option("emptyValue", '""').option("quoteAll", False).option("escape", '"').csv(new)
    else:
        rows.write.option("ignoreNullFields", False).json(new)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    paths = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in (new, old)]
    held = fs.exists(at)
    if held and not fs.rename(at, paths[1]):
        raise RuntimeError(f"{path} can't be replaced")
    if not fs.rename(paths[0], at):
        if held:
            fs.rename(paths[1], at)
        raise RuntimeError(f"{path} can't be written")
    if held:
        fs.delete(paths[1], True)
    return path


def imported(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """What ``export`` wrote, by a schema; a row that doesn't fit it is an error."""
    if kind == "csv":
        return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option("mode", "FAILFAST").csv(path)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def srt_time(ms: Column) -> Column:
    two = lambda x: F.when(x > 99, x.cast("string")).otherwise(F.lpad(x.cast("string"), 2, "0"))
    whole = lambda by: F.floor(ms / by).cast("long")
    return F.concat(two(whole(3_600_000)), F.lit(":"), two(whole(60_000) % 60), F.lit(":"), two(whole(1000) % 60), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))


#: Members of a bundle, and the marker that names them with their digests.
MEMBERS, MARKER = ("txt", "srt", "vtt", "json", "md"), "bundle"


def bundles(transcripts: DataFrame, segments: DataFrame) -> DataFrame:
    """(transcript_id, member, content): five members of each transcript of (transcript_id, title, source), and a marker with their SHA-256.

    ``segments``: (transcript_id, ordinal, start_ms, end_ms, text), gathered by transcript; the cue members hold those that can be written, times that run on and some text.
    """
    ms = lambda c, dot: F.regexp_replace(srt_time(F.col(c)), ",", dot)
    fine = (F.col("start_ms") >= 0) & (F.col("end_ms") > F.col("start_ms")) & (F.length(F.trim("text")) > 0)
    line = F.struct(
        "ordinal", "text", fine.alias("fine"),
        F.concat(ms("start_ms", ","), F.lit(" --> "), ms("end_ms", ","), F.lit("\n"), "text", F.lit("\n")).alias("srt"),
        F.concat(ms("start_ms", "."), F.lit(" --> "), ms("end_ms", "."), F.lit("\n"), F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("\n")).alias("vtt"),
        F.to_json(F.struct(F.col("start_ms").alias("from"), F.col("end_ms").alias("to"), F.col("text").alias("content"))).alias("json"),
    )
    rows = segments.groupBy("transcript_id").agg(F.array_sort(F.collect_list(line)).alias("all")).join(transcripts, "transcript_id")
    cues = F.filter("all", lambda x: x["fine"])
    txt = F.concat(F.array_join(F.transform("all", lambda x: x["text"]), "\n"), F.lit("\n"))
    contents = {
        "txt": txt,
        "srt": F.array_join(F.transform(cues, lambda x, k: F.concat((k + 1).cast("string"), F.lit("\n"), x["srt"])), "\n"),
        "vtt": F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(cues, lambda x: x["vtt"]), "\n")),
        "json": F.concat(F.lit('{"segments":['), F.array_join(F.transform("all", lambda x: x["json"]), ","), F.lit('],"source":'), F.to_json(F.array("source")), F.lit("}\n")),
        "md": F.concat(F.lit("---\ntitle: "), F.col("title"), F.lit("\nsource: "), F.col("source"), F.lit("\n---\n\n"), txt),
    }
    made = rows.select("transcript_id", *[c.alias(m) for m, c in contents.items()])
    marker = F.concat_ws("\n", *[F.concat(F.sha2(F.encode(m, "UTF-8"), 256), F.lit(f"  {m}")) for m in MEMBERS])
    each = F.array(*[F.struct(F.lit(m).alias("member"), F.col(m).alias("content")) for m in MEMBERS], F.struct(F.lit(MARKER).alias("member"), marker.alias("content")))
    return made.select("transcript_id", F.inline(each))


# ----------------------------------------------------------------------------------------------- registered queries

_COLUMNS = "work_id string, title string, sha string, tags array<string>, duration_ms long, note string"
_ROWS = """SELECT concat(p.video_code, ':p', p.page) AS work_id, concat(v.title, CASE WHEN p.part_id % 7 = 0 THEN concat(', "quoted"', chr(10), 'second line') ELSE '' END) AS title, CASE WHEN p.part_id % 3 = 0 THEN NULL ELSE SHA[p.video_code] END AS sha,
    array(p.status, v.state) AS tags, p.duration_ms, CASE WHEN p.part_id % 4 = 0 THEN NULL ELSE 'kept' END AS note FROM parts AS p JOIN videos AS v ON p.video_id = v.video_id"""


def exported(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = Scratch(spark).path("export", keep=True)
        rows = spark_query(_ROWS)(spark, sf_dir)
        export(rows.limit(1), path, kind)
        export(rows, path, kind, ["work_id", "title", "sha", "tags", "duration_ms", "note"])
        schema = _COLUMNS if kind == "json" else _COLUMNS.replace("array<string>", "string")
        out = imported(spark, path, kind, schema)
        return out.withColumn("tags", F.to_json("tags")) if kind == "json" else out

    run.__doc__ = f"S-15: an export as {kind} files, in place of an earlier one, read back."
    return run


def srt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-16: cues as files of SRT lines, one cue a row and a transcript's cues in order, read back as text and counted by transcript."""
    cues = relation(spark, sf_dir, "segments").where("start_ms >= 0 AND end_ms > start_ms")
    text = F.concat(F.col("ordinal") + 1, F.lit("|"), srt_time(F.col("start_ms")), F.lit(" --> "), srt_time(F.col("end_ms")), F.lit("|"), F.col("text"))
    path = Scratch(spark).path("srt", keep=True)
    export(cues.repartition("transcript_id").sortWithinPartitions("transcript_id", "ordinal").select("transcript_id", text.alias("cue")), path, "json")
    return imported(spark, path, "json", "transcript_id long, cue string").groupBy("transcript_id").agg(F.count("*").alias("cues"), F.min(F.split("cue", r"\|").getItem(1)).alias("first_at"))


def bundle_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-18: bundles written as files and read back: each member's bytes and digest."""
    texts = relation(spark, sf_dir, "transcripts").select("transcript_id", F.concat(F.lit("T"), "transcript_id").alias("title"), F.col("source_kind").alias("source"))
    path = export(bundles(texts, relation(spark, sf_dir, "segments")), Scratch(spark).path("bundles", keep=True), "json")
    got = imported(spark, path, "json", "transcript_id long, member string, content string")
    return got.select("transcript_id", "member", F.octet_length("content").cast("long").alias("bytes"), F.sha2(F.encode("content", "UTF-8"), 256).alias("sha256"))


#: The columns of a coverage report, pinned.
COVERAGE = {"status": "string", "works": "long", "with_text": "long", "published_n": "long", "current_n": "long", "stale_n": "long"}


def coverage(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark_query(STATEMENTS["Q-08_coverage_report"])(spark, sf_dir)
        path = export(rows, Scratch(spark).path("coverage", keep=True), kind, [*COVERAGE], files=1)
        return imported(spark, path, kind, ", ".join(f"{c} {t}" for c, t in COVERAGE.items()))

    run.__doc__ = f"S-20: the coverage report as a {kind} file, read back."
    return run


_STAMP = "PADDED[IDIV[{0}; 3600000]; 2], ':', PADDED[IDIV[{0}; 60000] % 60; 2], ':', PADDED[IDIV[{0}; 1000] % 60; 2], '{1}', PADDED[{0} % 1000; 3]".format
_BUNDLES = f"""WITH lines_of AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY ordinal) AS k FROM segments WHERE start_ms >= 0 AND end_ms > start_ms AND length(trim(text)) > 0),
    c AS (SELECT transcript_id, string_agg(concat(k, chr(10), {_STAMP("start_ms", ",")}, ' --> ', {_STAMP("end_ms", ",")}, chr(10), text, chr(10)), chr(10) ORDER BY ordinal) AS srt,
        string_agg(concat({_STAMP("start_ms", ".")}, ' --> ', {_STAMP("end_ms", ".")}, chr(10), replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10)), chr(10) ORDER BY ordinal) AS vtt FROM lines_of GROUP BY transcript_id),
    a AS (SELECT transcript_id, concat(string_agg(text, chr(10) ORDER BY ordinal), chr(10)) AS txt, string_agg(concat('{{"from":', start_ms, ',"to":', end_ms, ',"content":', to_json(text), '}}'), ',' ORDER BY ordinal) AS parts FROM segments GROUP BY transcript_id),
    m AS (SELECT t.transcript_id, txt, coalesce(srt, '') AS srt, concat('WEBVTT', chr(10), chr(10), coalesce(vtt, '')) AS vtt, concat('{{"segments":[', parts, '],"source":["', source_kind, '"]}}', chr(10)) AS json, concat('---', chr(10), 'title: T', t.transcript_id, chr(10), 'source: ', source_kind, chr(10), '---', chr(10), chr(10), txt) AS md
        FROM transcripts AS t JOIN a ON a.transcript_id = t.transcript_id LEFT JOIN c ON c.transcript_id = t.transcript_id),
    w AS (SELECT *, concat({", chr(10), ".join(f"sha256({x}), '  {x}'" for x in MEMBERS)}) AS bundle FROM m), e AS ({" UNION ALL ".join(f"SELECT transcript_id, '{x}' AS member, {x} AS content FROM w" for x in (*MEMBERS, MARKER))})
    SELECT transcript_id, member, strlen(content) AS bytes, sha256(content) AS sha256 FROM e"""
QUERIES = {f"S-20_coverage_{kind}": coverage(kind) for kind in FORMATS} | {"S-18_bundles": bundle_digests, "S-15_export_csv": exported("csv"), "S-15_export_json": exported("json"), "S-16_srt_files": srt_files}
_ORACLE = """SELECT concat(p.video_code, ':p', p.page) AS work_id, concat(v.title, CASE WHEN p.part_id % 7 = 0 THEN concat(', "quoted"', chr(10), 'second line') ELSE '' END) AS title, CASE WHEN p.part_id % 3 = 0 THEN NULL ELSE SHA[p.video_code] END AS sha,
    concat('["', p.status, '","', v.state, '"]') AS tags, p.duration_ms, CASE WHEN p.part_id % 4 = 0 THEN NULL ELSE 'kept' END AS note FROM parts AS p JOIN videos AS v ON p.video_id = v.video_id"""
ORACLES = {
    **{f"S-20_coverage_{kind}": STATEMENTS["Q-08_coverage_report"] for kind in FORMATS},
    "S-18_bundles": _BUNDLES,
    "S-15_export_csv": _ORACLE,
    "S-15_export_json": _ORACLE,
    "S-16_srt_files": "SELECT transcript_id, count(*) AS cues, min(concat(PADDED[IDIV[start_ms; 3600000]; 2], ':', PADDED[IDIV[start_ms; 60000] % 60; 2], ':', PADDED[IDIV[start_ms; 1000] % 60; 2], ',', PADDED[start_ms % 1000; 3], ' --> ', PADDED[IDIV[end_ms; 3600000]; 2], ':', PADDED[IDIV[end_ms; 60000] % 60; 2], ':', PADDED[IDIV[end_ms; 1000] % 60; 2], ',', PADDED[end_ms % 1000; 3])) AS first_at FROM segments WHERE start_ms >= 0 AND end_ms > start_ms GROUP BY transcript_id",
}
