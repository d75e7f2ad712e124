"""Transcript search over a stored positional index that grows by appended segments.

``SearchIndex`` lives in a folder.  ``append`` adds blocks past the committed high-water mark as one segment, and ``search`` answers
many query strings at once from what is committed; no query rebuilds anything.

A segment holds its blocks, and its postings: for each token and range of blocks one row with the number of blocks, bounds on the
scores in it (largest term count, least length), and the entries with their positions.  Rows are range-partitioned and sorted by token, so that
a query's tokens reach the scan as a filter on the files' statistics.  Ranges are by hash and hold about ``RANGE_BLOCKS`` blocks, so no token or
transcript makes a row long, and they are the same for all tokens, so whatever needs several tokens is decided range by range.

A search reads the headers of its tokens' ranges first.  A range is passed over if it lacks one of the tokens, or if its bound is below the score that the
best ranges have already reached for the query's last rank; the entries of the others are read, and phrases are found by merging positions.

A query string is words and quoted phrases, all of which a block must have.  A string with an odd number of quotes is one literal phrase.
A part that is written without spaces in Han, Kana or Hangul is searched by pairs of characters, which also finds it inside longer runs.
Marks and operators of other search languages are no more than marks here.

Scores are BM25 for words; a phrase counts as often as it stands there, and weighs as its rarest token does.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.dialect import relation, spark_query
from tessera.sources.scratch import Scratch, shared_dir

#: Blocks of a range, about, and ranges whose hits set a query's first bound.
RANGE_BLOCKS, FIRST_RANGES = 4096, 4
K1, B = 1.2, 0.75
#: Snippets: characters before and after the first match, and in all.
BEFORE, AFTER, MOST = 30, 90, 150
#: What is not to be shown, in texts and snippets.
REDACTED = "[redacted]"
URLS = r"""(?i)https?://[^\s"']+"""
CREDENTIALS = r"(?i)(?:sessdata|access[_-]?token|authorization|cookie|token|signature|sign|deadline)\s*(?:=|:)\s*[^\s,;]+"
#: A character of a script that is written without spaces.
_DENSE = r"[\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]"

HEAD = "token string, segment int, range int, n int, most_tf int, least_length int"
POSTINGS = f"{HEAD}, entries array<struct<transcript_id: bigint, ordinal: bigint, length: int, places: array<int>>>"
BLOCKS = "transcript_id long, ordinal long, start_ms long, end_ms long, length int, text string"


def redacted(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, URLS, REDACTED), CREDENTIALS, REDACTED)


def words_of(text: Column) -> Column:
    """Words in lower case: runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), "")


def pairs_of(text: Column) -> Column:
    """Overlapping pairs of characters of dense scripts, white space dropped, with a mark that no word has; null where a pair is broken."""
    dense = F.regexp_replace(F.lower(text), r"\s+", "")
    at = F.sequence(F.lit(1), F.greatest(F.length(dense) - 1, F.lit(1)))
    pairs = F.transform(at, lambda k: F.substring(dense, k, F.lit(2)))
    pairs = F.transform(pairs, lambda p: F.when(p.rlike(f"^{_DENSE}{{2}}$"), F.concat(F.lit("#"), p)))
    return F.when(dense.rlike(_DENSE) & (F.length(dense) > 1), pairs).otherwise(F.array().cast("array<string>"))


class SearchIndex:
    """An index in a folder that driver and executors share; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def commits(self) -> list[dict]:
        """The committed segments in order: name, folder, number, blocks, tokens, and the mark that they end at."""
        at, fs = self._fs(f"{self.path}/commits")
        if not fs.exists(at):
            return []
        rows = self.spark.read.text(f"{self.path}/commits").collect()
        return sorted((json.loads(r["value"]) for r in rows), key=lambda c: c["segment"])

    def mark(self) -> tuple[int, int]:
        """(transcript_id, ordinal) up to which blocks are held."""
        return max(((*c["mark"],) for c in self.commits()), default=(-1, -1))

    def append(self, blocks: DataFrame, name: str | None = None) -> int:
        """Adds the blocks (transcript_id, ordinal, start_ms, end_ms, text) past the mark, and commits them; returns their number.

        Under a ``name`` that is committed already nothing is done, so a repeated micro-batch changes nothing.  A named append takes all its blocks, whatever
        the mark; what was written but not committed is never read.
        """
        done = self.commits()
        if name is not None and any(c["name"] == name for c in done):
            return 0
        if name is None:
            transcript, ordinal = self.mark()
            past = (F.col("transcript_id") > transcript) | ((F.col("transcript_id") == transcript) & (F.col("ordinal") > ordinal))
            blocks = blocks.where(past)
            if blocks.isEmpty():
                return 0
        number, folder = len(done), f"{self.path}/segments/{len(done)}-{uuid.uuid4().hex}"
        text = redacted(F.coalesce("text", F.lit("")))
        clean = blocks.select(F.col("transcript_id").cast("long"), F.col("ordinal").cast("long"), F.col("start_ms").cast("long"), F.col("end_ms").cast("long"), F.size(words_of(text)).alias("length"), text.alias("text"))
        clean.write.parquet(f"{folder}/blocks")
        held = self.spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
        mark = F.max(F.struct("transcript_id", "ordinal"))
        n, tokens, mark = held.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), mark).first()
        ranges = -(-max(1, n) // RANGE_BLOCKS)
        self._postings(held, number, ranges).write.parquet(f"{folder}/postings")
        self._commit({"segment": number, "name": name or f"segment-{number}", "folder": folder, "blocks": n, "tokens": tokens, "mark": list(mark or (-1, -1))})
        return n

    def _postings(self, blocks: DataFrame, segment: int, ranges: int) -> DataFrame:
        spot = F.pmod(F.xxhash64("transcript_id", "ordinal"), F.lit(ranges)).cast("int")
        kinds = F.explode(F.array(words_of(F.col("text")), pairs_of(F.col("text")))).alias("tokens")
        places = blocks.select("transcript_id", "ordinal", "length", spot.alias("range"), kinds).select("transcript_id", "ordinal", "length", "range", F.posexplode("tokens").alias("place", "token")).where("token IS NOT NULL")
        # One shuffle: both groupings keep the partitions by (token, range).
        ordered = places.repartitionByRange("token", "range")
        entries = ordered.groupBy("token", "range", "transcript_id", "ordinal", "length").agg(F.array_sort(F.collect_list("place")).alias("places"))
        entry = F.struct("transcript_id", "ordinal", "length", "places")
        rows = entries.groupBy("token", "range").agg(F.count("*").cast("int").alias("n"), F.max(F.size("places")).alias("most_tf"), F.min("length").alias("least_length"), F.collect_list(entry).alias("entries"))
        return rows.select("token", F.lit(segment).alias("segment"), "range", "n", "most_tf", "least_length", "entries").sortWithinPartitions("token", "range")

    def _commit(self, row: dict) -> None:
        final, fs = self._fs(f"{self.path}/commits/{row['segment']:08d}")
        written, _ = self._fs(f"{self.path}/commits/.{row['segment']:08d}-{uuid.uuid4().hex}")
        out = fs.create(written, False)
        out.write(bytearray(json.dumps(row).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(written, final):
            raise RuntimeError(f"segment {row['segment']} was committed by another writer")

    def _tables(self, commits: list[dict]) -> tuple[DataFrame, DataFrame]:
        if not commits:
            return self.spark.createDataFrame([], POSTINGS), self.spark.createDataFrame([], BLOCKS)
        return tuple(self.spark.read.schema(s).parquet(*[f"{c['folder']}/{part}" for c in commits]) for part, s in (("postings", POSTINGS), ("blocks", BLOCKS)))

    def matches(self, queries: list[str], limit: int | None = 20, allowed: DataFrame | None = None) -> DataFrame:
        """(query, transcript_id, ordinal, tf, score) of the first ``limit`` blocks of each query, or of all.

        ``allowed`` has the (transcript_id, ordinal) or transcript_id that may be hits; ranks are among those.
        """
        commits = self.commits()
        postings, _ = self._tables(commits)
        terms = query_terms(self.spark, queries)
        tokens = sorted({r["token"] for r in terms.select("token").distinct().collect()})
        n, mean = sum(c["blocks"] for c in commits), sum(c["tokens"] for c in commits) / max(1, sum(c["blocks"] for c in commits))
        found = postings.where(F.col("token").isin(tokens)) if tokens else postings.limit(0)
        heads = found.drop("entries")
        df = heads.groupBy("token").agg(F.sum("n").alias("df"))
        idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        weights = terms.join(df, "token").groupBy("query", "phrase").agg(F.max(idf).alias("idf"))

        def strength(tf: Column, length: Column) -> Column:
            return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean, 1e-9)))

        # A range is of use to a query if it has all its tokens; its bound takes each phrase's rarest token and the shortest block.
        needed = terms.groupBy("query").agg(F.count_distinct("token").alias("needed"))
        of_phrase = terms.select("query", "phrase", "token").distinct().join(heads, "token").groupBy("query", "phrase", "segment", "range").agg(
            F.min("most_tf").alias("tf"), F.max("least_length").alias("least_length"), F.collect_set("token").alias("tokens")
        )
        bound = F.col("idf") * strength(F.col("tf"), F.col("least_length"))
        spots = of_phrase.join(weights, ["query", "phrase"]).groupBy("query", "segment", "range").agg(F.sum(bound).alias("bound"), F.size(F.array_distinct(F.flatten(F.collect_list("tokens")))).alias("has"))
        spots = spots.join(needed, "query").where("has = needed").select("query", "segment", "range", "bound")

        def evaluated(spots: DataFrame) -> DataFrame:
            entries = found.join(terms, "token").join(spots, ["query", "segment", "range"])
            rows = entries.select("query", "phrase", "size", "offset", F.explode("entries").alias("e"))
            starts = F.transform("e.places", lambda p: p - F.col("offset"))
            places = rows.groupBy("query", "phrase", "size", "e.transcript_id", "e.ordinal", "e.length").agg(F.collect_list(starts).alias("starts"))
            places = places.where(F.size("starts") == F.col("size"))
            common = F.aggregate(F.slice("starts", 2, F.greatest(F.col("size") - 1, F.lit(1))), F.get("starts", F.lit(0)), lambda acc, x: F.array_intersect(acc, x))
            phrases = places.withColumn("tf", F.size(common)).where("tf > 0").join(weights, ["query", "phrase"])
            whole = terms.groupBy("query").agg(F.count_distinct("phrase").alias("phrases"))
            score = F.sum(F.col("idf") * strength(F.col("tf"), F.col("length")))
            hits = phrases.groupBy("query", "transcript_id", "ordinal").agg(F.count("*").alias("matched"), F.sum("tf").cast("long").alias("tf"), F.round(score, 9).alias("score"))
            hits = hits.join(whole, "query").where("matched = phrases").select("query", "transcript_id", "ordinal", "tf", "score")
            return hits if allowed is None else hits.join(allowed, [c for c in ("transcript_id", "ordinal") if c in allowed.columns], "left_semi")

        if limit is None:
            return evaluated(spots)
        first = Window.partitionBy("query").orderBy(F.desc("bound"), "segment", "range")
        ranked = spots.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= FIRST_RANGES).drop("nth")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "transcript_id", "ordinal")
        best = evaluated(ranked).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit)
        reached = best.groupBy("query").agg(F.max(F.when(F.col("nth") == limit, F.col("score"))).alias("reached"))
        # Bounds are sums of rounded numbers, as scores are; what is within the last digit is read.
        rest = spots.join(ranked, ["query", "segment", "range"], "left_anti").join(reached, "query", "left").where(F.col("reached").isNull() | (F.col("bound") + 1e-6 >= F.col("reached")))
        both = best.drop("nth").unionByName(evaluated(rest.select("query", "segment", "range", "bound")))
        return both.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit).withColumnRenamed("nth", "rank_no")

    def search(self, queries: list[str], limit: int | None = 20, transcripts: DataFrame | None = None, since: int | None = None, until: int | None = None) -> DataFrame:
        """The hits of ``matches`` with times, text, snippet and title.

        ``transcripts`` has (transcript_id, title, pubdate): current facts, by which ``since`` <= pubdate < ``until`` is decided; without it titles are null.
        """
        allowed = None
        if since is not None or until is not None:
            if transcripts is None:
                raise ValueError("a window of dates needs the transcripts' dates")
            allowed = transcripts.where(F.lit(True) if since is None else F.col("pubdate") >= since).where(F.lit(True) if until is None else F.col("pubdate") < until).select("transcript_id")
        hits = self.matches(queries, limit, allowed)
        _, blocks = self._tables(self.commits())
        out = hits.join(blocks.drop("length"), ["transcript_id", "ordinal"])
        if transcripts is None:
            out = out.withColumn("title", F.lit(None).cast("string")).withColumn("pubdate", F.lit(None).cast("long"))
        else:
            out = out.join(transcripts.select("transcript_id", "title", "pubdate"), "transcript_id", "left")
        return out.withColumn("snippet", snippet(F.col("text"), F.col("query")))


def phrases_of(query: str) -> list[str]:
    """The words and quoted phrases of a query string; a string with a quote left open is one phrase."""
    if query.count('"') % 2:
        return [query]
    parts = query.split('"')
    return [p for k, part in enumerate(parts) for p in ([part] if k % 2 else part.split()) if p.strip()]


def query_terms(spark: SparkSession, queries: list[str]) -> DataFrame:
    """(query, phrase, size, offset, token) of distinct query strings; the tokens are cut as those of blocks are."""
    rows = [(q, k, p) for q in dict.fromkeys(queries) for k, p in enumerate(phrases_of(q))]
    parts = spark.createDataFrame(rows, "query string, phrase int, part string")
    dense = F.regexp_replace("part", r"[\s\p{P}]+", "").rlike(f"^{_DENSE}{{2,}}$")
    tokens = F.when(dense, pairs_of(F.regexp_replace("part", r"\p{P}+", ""))).otherwise(words_of(F.col("part")))
    cut = parts.withColumn("tokens", tokens).where(F.size("tokens") > 0)
    return cut.select("query", "phrase", F.size("tokens").alias("size"), F.posexplode("tokens").alias("offset", "token"))


def snippet(text: Column, query: Column) -> Column:
    """A part of the text around the first of the query's terms that is in it, or its start; white space is one space."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    terms = F.filter(F.split(F.trim(query), r"\s+", -1), lambda t: (F.length(t) > 1) & ~F.substring(t, 1, 1).isin("-", "+", "*"))
    terms = F.when(F.size(terms) > 0, terms).otherwise(F.array(F.trim(query)))
    places = F.filter(F.transform(terms, lambda t: F.instr(F.lower(clean), F.lower(t))), lambda p: p > 0)
    at = F.get(places, F.lit(0))
    start, end = F.greatest(at - 1 - BEFORE, F.lit(0)), F.least(F.length(clean), at - 1 + AFTER)
    around = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(clean, start + 1, end - start), F.when(end < F.length(clean), "...").otherwise(""))
    return redacted(F.substring(F.when(at.isNull(), F.substring(clean, 1, MOST)).otherwise(around), 1, MOST))


# ----------------------------------------------------------------------------------------------- registered queries


def session_index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The index over the archive's segments that this session has built for a folder, brought up to date."""
    named = hashlib.sha256(f"{spark.sparkContext.applicationId} {sf_dir}".encode()).hexdigest()[:24]
    index = SearchIndex(spark, f"{shared_dir(spark)}/tessera/search-{named}")
    index.append(relation(spark, sf_dir, "segments"))
    return index


def _block() -> Column:
    return F.concat_ws(":", "transcript_id", "ordinal").alias("block")


def transcript_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-13: blocks with a phrase, and how often."""
    return session_index(spark, sf_dir).matches(['"of the"'], None).select(_block(), "tf")


def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-16: the first hundred of the same by BM25."""
    found = session_index(spark, sf_dir).matches(['"of the"'], 100)
    return found.select(_block(), "tf", F.round("score", 6).alias("score"), F.col("rank_no").cast("long").alias("rank_no"))


#: Query strings of the kinds that users give: words, phrases, a quote left open, marks, a URL, nothing at all.
STRINGS = ["the", "of the", '"of the"', '"the of" and', 'und "in der"', '"de la', "La, el?", "the the", '"and the of"', "https://example.com/x", "nowhereinthetexts the", '""', "- *"]
SINCE, UNTIL, HITS = 704_000_000, 788_000_000, 20


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_query("SELECT transcript_id, title, pubdate FROM transcripts JOIN parts ON transcripts.part_id = parts.part_id JOIN videos ON videos.video_id = parts.video_id")(spark, sf_dir)


def search_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-13: many query strings at once, with a window of dates, titles, snippets and ranks."""
    found = session_index(spark, sf_dir).search(STRINGS, HITS, _facts(spark, sf_dir), SINCE, UNTIL)
    return found.select("query", F.col("rank_no").cast("long").alias("rank_no"), _block(), "start_ms", "tf", F.round("score", 6).alias("score"), "title", "pubdate", "snippet")


def index_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-09: an index built in two goes, the second past the first's mark, after one that was written and not committed; its blocks and their segments."""
    segments = relation(spark, sf_dir, "segments")
    (half,) = relation(spark, sf_dir, "transcripts").agg(F.expr("cast(floor(max(transcript_id) / 2) AS bigint)")).first()
    index = SearchIndex(spark, Scratch(spark).path("index", keep=True))
    index.append(segments.where(F.col("transcript_id") <= half))
    index.append(segments)
    index.append(segments)
    out = None
    for c in index.commits():
        rows = spark.read.schema(BLOCKS).parquet(f"{c['folder']}/blocks").select("transcript_id", "ordinal", F.lit(c["segment"]).alias("segment"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _hits_sql(queries: list[str], limit: int | None, allowed: str = "TRUE") -> str:
    """The same in the oracle's SQL: one select for each query string, with the tokens written out."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    selects = []
    for q in dict.fromkeys(queries):
        phrases = [t for p in phrases_of(q) if (t := [w for w in re.split(r"[^\w]+|_", p.lower()) if w])]
        if not phrases:
            continue
        tfs = [f"len(list_filter(range(1, len(w) - {len(t) - 2}), lambda i: w[i:i + {len(t) - 1}] = [{', '.join(map(quoted, t))}]))" for t in phrases]
        tfs = [f"CASE WHEN len(w) < {len(t)} THEN 0 ELSE {x} END" for t, x in zip(phrases, tfs, strict=True)]
        idfs = [f"(SELECT ln((n - min(df) + 0.5) / (min(df) + 0.5) + 1) FROM dfs, total WHERE token IN ({', '.join(map(quoted, t))}) GROUP BY n)" for t in phrases]
        score = " + ".join(f"{idf} * tf{k} * {K1 + 1} / (tf{k} + {K1} * ({1 - B} + {B} * length / mean))" for k, idf in enumerate(idfs))
        inner = f"SELECT *, {', '.join(f'{x} AS tf{k}' for k, x in enumerate(tfs))} FROM worded"
        selects.append(f"SELECT {quoted(q)} AS query, transcript_id, ordinal, start_ms, text, {' + '.join(f'tf{k}' for k in range(len(phrases)))} AS tf, round({score}, 9) AS score FROM ({inner}), total WHERE {' AND '.join(f'tf{k} > 0' for k in range(len(phrases)))}")
    cleaned = f"regexp_replace(regexp_replace(text, {quoted(URLS)}, '{REDACTED}', 'g'), {quoted(CREDENTIALS)}, '{REDACTED}', 'g')"
    kept = f"SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, transcript_id, ordinal) AS rank_no FROM hits WHERE {allowed}"
    return f"""WITH cleaned AS (SELECT transcript_id, ordinal, start_ms, {cleaned} AS text FROM segments),
        worded AS (SELECT *, {_WORDS} AS w, len({_WORDS}) AS length FROM cleaned),
        total AS (SELECT count(*) AS n, sum(length) / count(*) AS mean FROM worded),
        dfs AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS token FROM worded) GROUP BY token),
        hits AS ({' UNION ALL '.join(selects)}),
        ranked AS (SELECT * FROM ({kept}) WHERE rank_no <= {limit or 1 << 60})"""


def _snippet_sql() -> str:
    clean = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
    terms = "list_filter(string_split_regex(trim(query), '\\s+'), lambda t: length(t) > 1 AND substr(t, 1, 1) NOT IN ('-', '+', '*'))"
    place = f"list_filter(list_transform(CASE WHEN len({terms}) > 0 THEN {terms} ELSE [trim(query)] END, lambda t: instr(lower({clean}), lower(t))), lambda p: p > 0)[1]"
    inner = f"SELECT *, {clean} AS clean, {place} AS spot FROM ranked"
    around = f"concat(CASE WHEN spot > {BEFORE + 1} THEN '...' ELSE '' END, substr(clean, greatest(spot - {BEFORE}, 1), least(length(clean), spot - 1 + {AFTER}) - greatest(spot - {BEFORE + 1}, 0)), CASE WHEN spot - 1 + {AFTER} < length(clean) THEN '...' ELSE '' END)"
    return f"SELECT *, substr(CASE WHEN spot IS NULL THEN clean ELSE {around} END, 1, {MOST}) AS snippet FROM ({inner})"


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
_FACTS = "SELECT transcript_id, title, pubdate FROM transcripts JOIN parts ON transcripts.part_id = parts.part_id JOIN videos ON videos.video_id = parts.video_id"
_IN_WINDOW = f"transcript_id IN (SELECT transcript_id FROM ({_FACTS}) WHERE pubdate >= {SINCE} AND pubdate < {UNTIL})"
_REDACTED_SNIPPET = f"regexp_replace(regexp_replace(snippet, '{URLS.replace(chr(39), chr(39) * 2)}', '{REDACTED}', 'g'), '{CREDENTIALS}', '{REDACTED}', 'g')"

QUERIES = {"Q-13_transcript_search": transcript_search, "T-16_ranked_search": ranked_search, "Q-13_search_strings": search_strings, "M-09_index_builds": index_builds}
ORACLES = {
    "Q-13_transcript_search": f"SELECT block, count(*) AS tf FROM (SELECT block, unnest(range(1, len(w))) AS i, w FROM (SELECT concat(transcript_id, ':', ordinal) AS block, {_WORDS} AS w FROM segments)) WHERE w[i] = 'of' AND w[i + 1] = 'the' GROUP BY block",
    "T-16_ranked_search": f"""{_hits_sql(['"of the"'], 100)} SELECT concat(transcript_id, ':', ordinal) AS block, tf, round(score, 6) AS score, rank_no FROM ranked""",
    "Q-13_search_strings": f"""{_hits_sql(STRINGS, HITS, _IN_WINDOW)} SELECT query, rank_no, concat(s.transcript_id, ':', ordinal) AS block, start_ms, tf, round(score, 6) AS score, title, pubdate, {_REDACTED_SNIPPET} AS snippet
        FROM ({_snippet_sql()}) AS s JOIN ({_FACTS}) AS f ON f.transcript_id = s.transcript_id""",
    "M-09_index_builds": "SELECT transcript_id, ordinal, CASE WHEN transcript_id <= (SELECT cast(floor(max(transcript_id) / 2) AS bigint) FROM transcripts) THEN 0 ELSE 1 END AS segment FROM segments",
}
