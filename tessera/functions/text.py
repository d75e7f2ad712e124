"""Text operators as column expressions: redaction, bigrams, repetition, prechecks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.dialect import relation
from tessera.sources.scratch import Scratch

#: Repetition: characters of a window, occurrences that count, characters that are looked at.
WINDOW_CHARS, REPEATS, LOOKED_AT = 8, 3, 200_000


def cjk_bigrams(text: Column) -> Column:
    """Overlapping pairs of code points, white space dropped; none for fewer than two."""
    dense = F.regexp_replace(text, r"\s+", "")
    places = F.sequence(F.lit(1), F.greatest(F.length(dense) - 1, F.lit(1)))
    return F.when(F.length(dense) < 2, F.array().cast("array<string>")).otherwise(F.transform(places, lambda i: F.substring(dense, i, F.lit(2))))


def bigram_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-15: the pairs of each turn, in order."""
    return relation(spark, sf_dir, "turns").select("conv_id", "turn", F.array_join(cjk_bigrams(F.col("text")), "|").alias("bigrams"))


def most_repeated(items: Column) -> Column:
    """How often the most frequent element of an array occurs: the longest run once it is sorted."""
    start = F.struct(F.lit(None).cast("string").alias("of"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["of"] == x, acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("of"), run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    return F.aggregate(F.array_sort(items), start, step, lambda acc: acc["most"])


def repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-04: the most frequent 8-character window of each turn, within its row; the last full window isn't counted."""
    turns = relation(spark, sf_dir, "turns").select("conv_id", "turn", F.substring("text", 1, LOOKED_AT).alias("text")).where(F.length("text") > WINDOW_CHARS)
    each = F.transform(F.sequence(F.lit(1), F.length("text") - WINDOW_CHARS), lambda i: F.substring(F.col("text"), i, F.lit(WINDOW_CHARS)))
    most = turns.select("conv_id", "turn", most_repeated(each).cast("long").alias("most"))
    return most.select("conv_id", "turn", "most", (F.col("most") >= REPEATS).alias("repeats"))


def prechecks(text: Column) -> list[Column]:
    """Local flags: doubled white space, repeated marks, filler words, a repeated phrase."""
    return [
        text.rlike(r"[ \t]{2,}").alias("whitespace"),
        text.rlike(r"([,.!?;:#$%&*])\1").alias("repeated_mark"),
        text.rlike(r"(?i)\b(?:uh|um|er)\b").alias("filler"),
        text.rlike(r"(\p{L}{2,12})[ ,]+\1[ ,]+\1").alias("repeated_phrase"),
        F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r"([,.!?;:#$%&*])\1+", "$1").alias("safe_text"),
    ]


def precheck_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-12."""
    return relation(spark, sf_dir, "turns").select("conv_id", "turn", *prechecks(F.col("text")))


def description_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-03: ordinary links stay; those with user info, sensitive parameters or a CDN host are redacted."""
    url = F.col("url")
    secret = F.coalesce(F.try_parse_url(url, F.lit("USERINFO")).isNotNull(), F.lit(False)) | url.rlike(r"(?i)[?&](token|sig|key|auth|utm_source)=") | url.rlike(r"(?i)^[a-z]+://[^/]*\bcdn\b")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.when(secret, "[redacted]").otherwise(url).alias("link"))


def read_srt(rendered: DataFrame) -> DataFrame:
    """(transcript_id, ordinal, start_ms) of the cues of SRT texts (transcript_id, srt): a cue's head stands at the start or after a blank line, whatever text follows."""
    head = r"(\d+)\n(\d{2,}):(\d\d):(\d\d),(\d{3})\n"
    heads = F.explode(F.regexp_extract_all("srt", F.lit(r"(?:^|\n\n)" + head), F.lit(0))).alias("head")
    part = lambda k: F.regexp_extract("head", head, k).cast("long")
    ms = part(2) * 3_600_000 + part(3) * 60_000 + part(4) * 1000 + part(5)
    return rendered.select("transcript_id", heads).select("transcript_id", (part(1) - 1).alias("ordinal"), ms.alias("start_ms"))


def parse_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-08: cues of rendered SRT texts, read back by regular expressions; a cue may be empty, and a time may have 100 hours and more."""
    from tessera.sources.exports import srt_time

    cues = relation(spark, sf_dir, "segments").where("start_ms >= 0 AND end_ms > start_ms")
    block = F.concat((F.col("ordinal") + 1).cast("string"), F.lit("\n"), srt_time(F.col("start_ms")), F.lit("\n"), "text", F.lit("\n"))
    blocks = F.array_sort(F.collect_list(F.struct("ordinal", block.alias("block"))))
    rendered = cues.groupBy("transcript_id").agg(F.array_join(F.transform(blocks, lambda x: x["block"]), "\n").alias("srt"))
    return read_srt(rendered)


def json_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-09: cues of JSON sidecars with either name for each field; bad items are flagged."""
    segments = relation(spark, sf_dir, "segments")
    either = F.when(F.col("ordinal") % 2 == 0, F.to_json(F.struct(F.col("start_ms").alias("from"), F.col("end_ms").alias("to"), F.col("text").alias("content"))))
    sidecar = segments.select("transcript_id", "ordinal", either.otherwise(F.to_json(F.struct(F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), "text"))).alias("item"))
    read = F.from_json("item", "from long, start long, to long, end long, text string, content string")
    out = sidecar.withColumn("c", read)
    start, end = F.coalesce("c.from", "c.start"), F.coalesce("c.to", "c.end")
    return out.select("transcript_id", "ordinal", start.alias("start_ms"), end.alias("end_ms"), F.coalesce(F.col("c.text"), F.col("c.content")).alias("text"), (end <= start).alias("bad"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: an order-free fingerprint over all columns with their types, and the count of rows."""
    typed = [F.concat_ws("=", F.lit(f"{c}:{t}"), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c, t in sorted(df.dtypes)]
    return df.select(F.xxhash64(*typed).cast("decimal(38,0)").alias("h")).agg(F.coalesce(F.sum("h"), F.lit(0)).alias("h"), F.count("*").alias("n"))


def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-25: the fingerprint of each relation, and of a copy of it that was written and read again, in other partitions."""
    out = None
    with Scratch(spark) as s:
        for name in ("transcripts", "segments", "jobs", "edges"):
            df = relation(spark, sf_dir, name)
            copy = s.table(df.repartition(7), name, keep=True)
            row = fingerprint(df).select(F.lit(name).alias("relation"), F.col("n").alias("rows_n"), "h").crossJoin(fingerprint(copy).select(F.col("h").alias("after"), F.col("n").alias("copied_n")))
            row = row.select("relation", "rows_n", "copied_n", (F.col("h") == F.col("after")).alias("same"))
            out = row if out is None else out.unionByName(row)
    return out


def migration_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-12: jobs moved to keys of their own, written with a ledger of the old and new keys and each row's hash, and compared through it."""
    jobs = relation(spark, sf_dir, "jobs")
    content = F.xxhash64(*sorted(c for c in jobs.columns if c not in ("job_id", "repair_of")))
    with Scratch(spark) as s:
        ledger = s.table(jobs.select(F.col("job_id").alias("old_id"), (F.col("job_id") + 1_000_000).alias("new_id"), content.alias("before")), "ledger", keep=True)
        to = ledger.select(F.col("old_id").alias("repair_of"), F.col("new_id").alias("moved_repair"))
        moved = s.table(jobs.withColumn("job_id", F.col("job_id") + 1_000_000).join(to, "repair_of", "left").drop("repair_of").withColumnRenamed("moved_repair", "repair_of"), "moved", keep=True)
    out = ledger.join(moved, ledger["new_id"] == moved["job_id"], "left")
    return out.select("old_id", "new_id", (content == F.col("before")).alias("same"), "repair_of")


def kept_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-04: the keys of events' properties, with two that name credentials added, that stay once such keys are dropped."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.array_union(F.json_object_keys("props"), F.array(F.lit("api_token"), F.lit("cookie_jar"))).alias("keys"))
    kept = F.filter("keys", lambda k: ~F.lower(k).rlike("token|cookie|secret|password|authorization"))
    return events.select(F.explode(kept).alias("column_name")).groupBy("column_name").agg(F.count("*").alias("n"))


QUERIES = {
    "T-15_bigram_stream": bigram_stream,
    "T-04_repeated_windows": repeated_windows,
    "T-12_prechecks": precheck_flags,
    "X-03_description_links": description_links,
    "S-08_srt_cues": parse_srt,
    "S-09_json_cues": json_cues,
    "M-12_migration_ledger": migration_ledger,
    "X-04_drop_keys": kept_keys,
    "A-25_table_fingerprint": table_fingerprint,
}
ORACLES = {
    "T-15_bigram_stream": "SELECT conv_id, turn, CASE WHEN length(d) < 2 THEN '' ELSE array_to_string(list_transform(range(1, length(d)), lambda i: substr(d, i, 2)), '|') END AS bigrams FROM (SELECT conv_id, turn, regexp_replace(text, '\\s+', '', 'g') AS d FROM turns)",
    "T-04_repeated_windows": "SELECT conv_id, turn, max(n) AS most, max(n) >= 3 AS repeats FROM (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(list_transform(range(1, length(t) - 7), lambda i: substr(t, i, 8))) AS w FROM (SELECT conv_id, turn, substr(text, 1, 200000) AS t FROM turns) WHERE length(t) > 8) GROUP BY conv_id, turn, w) GROUP BY conv_id, turn",
    "S-08_srt_cues": "SELECT transcript_id, ordinal, start_ms FROM segments WHERE start_ms >= 0 AND end_ms > start_ms",
    "S-09_json_cues": "SELECT transcript_id, ordinal, start_ms, end_ms, text, end_ms <= start_ms AS bad FROM segments",
    "A-25_table_fingerprint": "SELECT 'transcripts' AS relation, count(*) AS rows_n, count(*) AS copied_n, TRUE AS same FROM transcripts UNION ALL SELECT 'segments', count(*), count(*), TRUE FROM segments UNION ALL SELECT 'jobs', count(*), count(*), TRUE FROM jobs UNION ALL SELECT 'edges', count(*), count(*), TRUE FROM edges",
    "M-12_migration_ledger": "SELECT j.job_id AS old_id, j.job_id + 1000000 AS new_id, TRUE AS same, r.job_id + 1000000 AS repair_of FROM jobs AS j LEFT JOIN jobs AS r ON j.repair_of = r.job_id",
    "X-04_drop_keys": "SELECT column_name, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS column_name FROM events) WHERE NOT regexp_matches(lower(column_name), 'token|cookie|secret|password|authorization') GROUP BY column_name",
}
