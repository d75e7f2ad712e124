"""Hotword guard: which terms of a table occur in a part's evidence, by automata over bounded shares of the terms.

Terms are trimmed, and of equal ones the first counts.  They are dealt into shares of at most about ``SHARE`` terms; each share is
one Aho-Corasick automaton, built once by a worker, that reads each text once for all its terms.  So a text costs its length and its
hits for each share, no pair of a term and a text is made that isn't a hit, and a worker holds one share.

Containment is of case-folded strings, anywhere in the text, inside longer words too.  Defined cases: null and blank terms are no terms; a null text
is no evidence; a part without evidence or hits admits none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.dialect import relation, spark_query

#: Terms of an automaton, about.
SHARE = 100_000


def ordered_terms(terms: DataFrame) -> DataFrame:
    """(place, term) of (place, term): trimmed, without blanks, each term at its first place."""
    trimmed = terms.select("place", F.regexp_replace("term", r"(?U)^\s+|\s+$", "").alias("term")).where("term <> ''")
    return trimmed.groupBy("term").agg(F.min("place").alias("place"))


def _finder(terms: list[tuple[int, str]]):
    import ahocorasick

    automaton, of = ahocorasick.Automaton(), {}
    for place, term in terms:
        of.setdefault(term.casefold(), []).append((place, term))
    for folded, its in of.items():
        automaton.add_word(folded, its)
    automaton.make_automaton()
    return automaton


def hits(texts: DataFrame, terms: DataFrame, share: int = SHARE) -> DataFrame:
    """(key, place, term) of each row of (key, text) and each term of ``ordered_terms`` in it, once."""
    spark = texts.sparkSession
    shares = -(-max(1, terms.count()) // share)
    kind = dict(texts.dtypes)["key"]
    out = None
    for k in range(shares):
        # A share is a bounded part of the terms, by their hash.
        its = spark.sparkContext.broadcast([(r["place"], r["term"]) for r in terms.where(F.pmod(F.xxhash64("term"), F.lit(shares)) == k).collect()])
        if not its.value:
            continue

        def find(batches: Iterator[pa.RecordBatch], its=its) -> Iterator[pa.RecordBatch]:
            automaton = _finder(its.value)
            for batch in batches:
                rows, places, words = [], [], []
                for n, text in enumerate(batch.column("text").to_pylist()):
                    found = {term for _, same in automaton.iter(text.casefold()) for term in same} if text else ()
                    rows += [n] * len(found)
                    places += [p for p, _ in found]
                    words += [w for _, w in found]
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows)), pa.array(places, pa.int64()), pa.array(words, pa.string())], names=["key", "place", "term"])

        found = texts.select("key", "text").mapInArrow(find, f"key {kind}, place long, term string")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], f"key {kind}, place long, term string") if out is None else out


def guard(evidence: DataFrame, terms: DataFrame, share: int = SHARE) -> DataFrame:
    """(key, admitted, n_dropped) of each key of (key, text): the terms in any of its texts, in their order, and how many are in none."""
    terms = ordered_terms(terms)
    total = terms.count()
    found = hits(evidence, terms, share).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("place", "term"))).alias("found"))
    keys = evidence.select("key").distinct().join(found, "key", "left")
    admitted = F.coalesce(F.transform("found", lambda x: x["term"]), F.array().cast("array<string>"))
    return keys.select("key", admitted.alias("admitted"), (F.lit(total) - F.size(admitted)).cast("long").alias("n_dropped"))


# ----------------------------------------------------------------------------------------------- registered queries

#: The benchmark's longer words, capitalised, in their order; and one that is in no text.
_TERMS = "SELECT 1000 * item_id + place AS place, concat(upper(substr(word, 1, 1)), substr(word, 2)) AS term FROM words WHERE length(word) >= 5 UNION ALL SELECT -1 AS place, ' Absent-Term ' AS term"
_WORDS = "SELECT item_id, cast(place AS bigint) AS place, word FROM benchmark LATERAL VIEW posexplode(regexp_extract_all(text, '[A-Za-z]+', 0)) AS place, word"


def hotword_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-29: in how many documents each of a few terms occurs."""
    terms = ordered_terms(spark.createDataFrame(enumerate(["license", "apache", "idiot", "absent-term"]), "place long, term string"))
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("key"), "text")
    return hits(documents, terms).groupBy("term").agg(F.count("*").alias("evidence_n"))


def hotword_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-29: for each part the terms of a table that its transcripts bear out, in order."""
    terms = spark_query(f"WITH words AS ({_WORDS}) {_TERMS}")(spark, sf_dir)
    evidence = relation(spark, sf_dir, "transcripts").select(F.col("part_id").alias("key"), "text")
    return guard(evidence, terms).select(F.col("key").alias("part_id"), F.array_join("admitted", ",").alias("admitted"), F.size("admitted").cast("long").alias("n_admitted"), "n_dropped")


_FOLD = "replace(lower({0}), 'ß', 'ss')".format
QUERIES = {"T-29_hotwords": hotword_evidence, "T-29_hotword_guard": hotword_guard}
ORACLES = {
    "T-29_hotwords": "SELECT h.term, count(*) AS evidence_n FROM (SELECT 'license' AS term UNION ALL SELECT 'apache' UNION ALL SELECT 'idiot' UNION ALL SELECT 'absent-term') AS h JOIN documents AS d ON instr(lower(d.text), h.term) > 0 GROUP BY h.term",
    "T-29_hotword_guard": f"""WITH words AS (SELECT item_id, unnest(range(0, len(w))) AS place, unnest(w) AS word FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark)),
        terms AS (SELECT trim(term) AS term, min(place) AS place FROM ({_TERMS}) GROUP BY trim(term)), total AS (SELECT count(*) AS n FROM terms),
        found AS (SELECT DISTINCT part_id, place, term FROM transcripts JOIN terms ON contains({_FOLD("text")}, {_FOLD("term")}))
        SELECT p.part_id, coalesce(string_agg(term, ',' ORDER BY place, term), '') AS admitted, count(term) AS n_admitted, max(n) - count(term) AS n_dropped
        FROM (SELECT DISTINCT part_id FROM transcripts) AS p CROSS JOIN total LEFT JOIN found ON found.part_id = p.part_id GROUP BY p.part_id""",
}
