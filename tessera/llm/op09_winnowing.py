"""Benchmark decontamination by winnowing.

Texts are lower-cased in A-Z and cut into words.  Of every window of consecutive k-gram hashes the
smallest is kept as a fingerprint; with grams of 5 words and windows of 9 grams, any span of 13 shared
words gives both sides an equal fingerprint.  Documents and benchmark items are joined on fingerprints;
each document that has a hit is then extended: all its 13-word windows are joined with the items'
windows as text, so that only real occurrences count.  An item of fewer than 13 words is one window of
its own length; its fingerprints use grams and windows cut to that length.

Only DataFrame expressions are used.  The fingerprints of a document are an expression over its own
row; what is shuffled are distinct fingerprints (about a fifth of the words) and the texts of documents
that have a hit.  The benchmark side is broadcast only where its measured size is below Spark's limit.

Defined cases: null ids stay null; null and wordless texts have no words and no hits, null items no windows; an empty
benchmark leaves every document clean; repeated items (id and text) count once; repeated document rows give
repeated result rows, and rows that share an id but not the text are judged apart; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, given, held, let, table, unused

#: Fixed by the contract: what is not part of a word once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x7F]+"
WINDOW = 13
GRAM = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_exact(text: Column) -> Column:
    """The words with A-Z lower-cased and all else as it is."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), SEPARATORS, -1), "")


def words_folded(text: Column) -> Column:
    """As many words, in upper case: equal wherever ``words_exact`` are, and cheaper to make.

    Upper-casing looks at no neighbouring letters (lower-casing does, for the final sigma).
    """
    return F.array_remove(F.split(F.upper(text), UPPER_SEPARATORS, -1), "")


def gram_and_window(span: int) -> tuple[int, int]:
    """Words of a gram and grams of a window such that a shared span always shares a fingerprint."""
    gram = GRAM if span >= WINDOW else (span + 1) // 2
    return gram, min(span, WINDOW) - gram + 1


def fingerprints(words: Column, spans: list[int]) -> Column:
    """The winnowed fingerprints of a word array, for each guaranteed span."""

    def winnow(hashes: Column, span: int) -> Column:
        gram, window = gram_and_window(span)

        def grams() -> Column:
            return F.transform(
                F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (gram - 1), F.lit(0))),
                lambda h, i: F.xxhash64(F.lit(span), h, *[F.get(hashes, i + j) for j in range(1, gram)]),
            )

        def smallest(g: Column) -> Column:
            return g if window == 1 else F.transform(g, lambda x, i: F.least(x, *[F.get(g, i + j) for j in range(1, window)]))

        return let(grams(), smallest)

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.array_distinct(let(hashed, lambda h: F.concat(*[winnow(h, s) for s in spans])))


def windows(words: Column, span: int) -> Column:
    """All windows of ``span`` words as text; their place is their index."""
    return let(words, lambda w: F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (span - 1), F.lit(0))), lambda _, i: F.array_join(F.slice(w, i + 1, span), " ")))


def covered(places: Column) -> Column:
    """How many words the sorted (start, length) places cover."""
    none = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, p: Column) -> Column:
        end = p["at"] + p["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(end - F.greatest(acc["end"], p["at"]), F.lit(0))).alias("n"))

    return F.aggregate(places, none, step, lambda acc: acc["n"])


def decontaminate(scratch: Scratch, docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_hit, item_ids; ``items`` has (item_id, text)."""
    item_words = items.select("item_id", words_exact(F.coalesce("text", F.lit(""))).alias("words"))
    item_words = scratch.table(item_words.where(F.size("words") > 0).distinct().withColumn("span", F.least(F.size("words"), F.lit(WINDOW))), "items")
    # At most 13 values, whatever the benchmark's size.
    spans = sorted(r["span"] for r in item_words.select("span").distinct().collect()) or [WINDOW]

    def of_span(make, column: str) -> Column:
        empty = F.array().cast("array<bigint>" if column == "prints" else "array<string>")
        out = empty
        for s in spans:
            out = F.when(F.col("span") == s, make(s)).otherwise(out)
        return out

    folded = F.transform("words", lambda w: F.upper(w))
    prints = item_words.select(F.explode(of_span(lambda s: fingerprints(folded, [s]), "prints")).alias("print")).distinct()
    prints = scratch.table(prints, "prints")
    # Each window once, with the items that have it: a passage of many items gives a document's place one row.
    spots = item_words.select("item_id", "span", F.explode(of_span(lambda s: windows(F.col("words"), s), "windows")).alias("window"))
    spots = scratch.table(spots.groupBy("span", "window").agg(F.sort_array(F.collect_set("item_id")).alias("items")), "spots")

    text = F.coalesce("text", F.lit(""))
    # A row is known by its id and its text's hash.
    keyed = docs.select(held("doc_id").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    marked = keyed.select("doc_id", "tag", let(words_folded(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), fingerprints(w, spans).alias("prints"))).alias("m"))
    marked = scratch.table(marked.select("doc_id", "tag", "m.n_words", "m.prints"), "marked", keep=True)
    suspects = marked.select("doc_id", "tag", F.explode("prints").alias("print")).join(prints, "print", "left_semi")
    suspects = scratch.table(suspects.select("doc_id", "tag").distinct(), "suspects")

    # Extension: the texts of documents with a fingerprint in common, window by window.
    seen = keyed.join(suspects, ["doc_id", "tag"], "left_semi").dropDuplicates(["doc_id", "tag"]).select("doc_id", "tag", words_exact(F.col("text")).alias("words"))
    each = F.concat(*[F.transform(windows(F.col("words"), s), lambda w, i: F.struct(i.cast("long").alias("at"), w.alias("window"))) for s in spans])
    found = seen.select("doc_id", "tag", F.explode(each).alias("e")).select("doc_id", "tag", "e.at", "e.window").join(spots, "window")
    hits = found.groupBy("doc_id", "tag").agg(
        F.collect_set(F.struct("at", F.col("span").cast("long").alias("len"))).alias("places"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("item_ids")
    )
    hits = scratch.table(hits.select("doc_id", "tag", covered(F.sort_array("places")).alias("n_hit"), "item_ids"), "hits", keep=True)
    out = marked.select("doc_id", "tag", "n_words").join(hits, ["doc_id", "tag"], "left")
    return out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))).withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<bigint>")))


#: A document is contaminated if a word is hit and hits are at least one word in twenty.
CONTAMINATED = "n_hit > 0 AND 20 * n_hit >= n_words"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its words, hit words, items, and whether it is contaminated."""
    with Scratch(spark) as s:
        out = decontaminate(s, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    ids = F.array_join(F.sort_array(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return out.select(given("doc_id").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), F.expr(CONTAMINATED).alias("contaminated"))


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go; all others stay as they are."""
    key, tag = unused(docs, "gone_id", "gone_tag")
    with Scratch(spark) as s:
        judged = decontaminate(s, docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
        out = s.table(judged.where(CONTAMINATED).select(F.col("doc_id").alias(key), F.col("tag").alias(tag)).distinct(), "out", keep=True)
    same = (held("doc_id") == F.col(key)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(tag))
    return docs.join(out, same, "left_anti")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, rowid_, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents)
), i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS span, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM i WHERE len(w) > 0)
), spans AS (SELECT DISTINCT span FROM iw),
dw AS (
  SELECT rowid_, p, span, array_to_string(w[p:p + span - 1], ' ') AS win
  FROM (SELECT rowid_, w, span, unnest(range(1, len(w) - span + 2)) AS p FROM d, spans WHERE len(w) >= span)
), hit AS (SELECT rowid_, p, dw.span, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.span = iw.span),
n AS (
  SELECT rowid_, count(DISTINCT q) AS n_hit FROM (SELECT rowid_, unnest(range(p, p + span)) AS q FROM (SELECT DISTINCT rowid_, p, span FROM hit)) GROUP BY rowid_
), it AS (
  SELECT rowid_, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT rowid_, item_id FROM hit) GROUP BY rowid_
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (rowid_) LEFT JOIN it USING (rowid_)
"""
