"""License scans: fuzzy search for short notices.

A text is reduced to its words, in ASCII lower case and with single spaces.  A notice of L characters with
at most k errors is split into k + 1 pieces; by the pigeonhole principle one of them stands unchanged in every
match, so the pieces are searched as exact seeds.  Each seed fixes a window of the text in which the regex
library's bounded-error matching looks for the notice; it reports the span and the number of edits.
Beside the notices, base phrases are found wherever their words stand consecutively.

Texts are handled one by one, with no shuffle, and in time that grows with their length and their seeds.

Defined cases: a null id stays null; null, empty and wordless texts have no words, places or labels and score
0; an empty table gives no rows; repeated rows give repeated rows; places that tie are in the order of the phrases; of overlapping matches of one notice the first is
reported; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import table

#: Fixed by the contract.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: The method's own: opening words of well-known notices, and their labels.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under the gnu general public license", "gpl"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("spdx license identifier", "spdx"),
)
#: One error is allowed for so many characters of a notice.
CHARS_PER_ERROR = 14
_TO_WORDS = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_WORDS).split()


class Notice:
    def __init__(self, text: str, label: str, errors: int | None = None):
        self.text, self.label = text.encode(), label
        self.errors = max(1, len(text) // CHARS_PER_ERROR) if errors is None else errors
        cuts = [len(text) * i // (self.errors + 1) for i in range(self.errors + 2)]
        self.seeds = [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        pattern = regex.compile(r"(?b)(?:%s){e<=%d}" % (regex.escape(text, literal_spaces=True), self.errors))

        @lru_cache(maxsize=4096)
        def match(window: bytes):
            m = pattern.search(window.decode("latin-1"))
            return m and (m.start(), m.end(), sum(m.fuzzy_counts))

        self.match = match

    def find(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, end, errors) of the matches, without overlap."""
        starts = []
        for offset, seed in self.seeds:
            at = text.find(seed)
            while at >= 0:
                starts.append(at - offset)
                at = text.find(seed, at + 1)
        found: list[tuple[int, int, int]] = []
        # Seeds of one occurrence lie within the errors of each other, but each has a window of its own:
        # equal windows are matched once, by the cache.
        for start in sorted(set(starts)):
            low = max(0, start - self.errors)
            if found and low + 2 * self.errors < found[-1][1] - self.errors:
                continue
            if m := self.match(text[low : max(0, start) + len(self.text) + 2 * self.errors]):
                hit = (low + m[0], low + m[1], m[2])
                if not found or hit[0] >= found[-1][1]:
                    found.append(hit)
        return found


FOUND = "doc_id long, n_words long, places array<struct<label:string,word:long>>, spans array<struct<label:string,first:long,last:long,errors:int,score:double>>"


def scan_text(text: str | None, phrases, notices) -> tuple[int, list[dict], list[dict]]:
    words = words_of(text)
    flat = b" " + b" ".join(words) + b" "
    places, spans = [], []
    for phrase, label in phrases:
        at = flat.find(phrase)
        while at >= 0:
            places.append((at, label))
            at = flat.find(phrase, at + 1)
    for notice in notices:
        spans += [(start, end, errors, notice) for start, end, errors in notice.find(flat)]
    if places or spans:  # words are counted once, by the spaces before each
        gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
        word = np.searchsorted(gaps, [p[0] for p in places], "left").tolist()
        places = [{"label": label, "word": w} for w, (_, label) in sorted(zip(word, places, strict=True), key=lambda x: x[0])]
        first, last = np.searchsorted(gaps, [s[0] + 1 for s in spans], "left"), np.searchsorted(gaps, [s[1] for s in spans], "left")
        spans = [{"label": n.label, "first": max(0, a - 1), "last": max(0, b - 1), "errors": errors, "score": 1 - errors / len(n.text)} for a, b, (_, _, errors, n) in zip(first.tolist(), last.tolist(), spans, strict=True)]
    return len(words), places, spans


def scan_licenses(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """Per (doc_id, text): its words, the places of the phrases, and the spans of the notices."""

    def scan(batches):
        own = [(b" " + p.encode() + b" ", label) for p, label in phrases]
        known = [Notice(*n) for n in notices]
        for batch in batches:
            rows = [scan_text(x.as_py(), own, known) for x in batch.column("text")]
            n, places, spans = zip(*rows, strict=True) if rows else ((), (), ())
            schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("errors", pa.int32()), ("score", pa.float64())])))])
            columns = [batch.column("doc_id"), list(n), list(places), list(spans)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) if isinstance(c, list) else c for c, t in zip(columns, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, FOUND)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its words, the base places and labels, all labels, and a score."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct("places.label"))
    every = F.array_sort(F.array_union("places.label", "spans.label"))
    score = F.greatest(F.when(F.size("places") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max("spans.score"), F.lit(0.0)))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        score.alias("score"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["first"], s["last"], s["errors"])), ",").alias("spans"),
    )
