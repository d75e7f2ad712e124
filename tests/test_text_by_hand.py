"""Text queries that have no SQL, row by row against Python's own expressions; closures from chosen roots."""

import os

import pandas as pd
import pytest
import regex

from tessera.operators.graph import dependency_closures, dependents
from tessera.plans.catalog import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_prechecks(spark):
    turns = pd.read_parquet(f"{DATA}/conversations.parquet").sort_values(["conv_id", "turn"])
    texts = {(r.conv_id, r.turn): r.text for r in turns.itertuples()}
    got = QUERIES["T-12_prechecks"](spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["conv_id"], r["turn"]]
        assert r["whitespace"] == bool(regex.search(r"[ \t]{2,}", text))
        assert r["repeated_mark"] == bool(regex.search(r"([,.!?;:#$%&*])\1", text))
        assert r["filler"] == bool(regex.search(r"(?i)\b(?:uh|um|er)\b", text))
        assert r["repeated_phrase"] == bool(regex.search(r"(\p{L}{2,12})[ ,]+\1[ ,]+\1", text))
        assert r["safe_text"] == regex.sub(r"([,.!?;:#$%&*])\1+", r"\1", regex.sub(r"[ \t]{2,}", " ", text))


def test_prechecks_of_marked_texts(spark):
    from pyspark.sql import functions as F

    from tessera.functions.text import prechecks

    rows = [("a  b", "whitespace"), ("what??", "repeated_mark"), ("Um, yes", "filler"), ("summer", None), ("the the, the end", "repeated_phrase"), ("plain", None)]
    got = spark.createDataFrame(rows, "text string, want string").select("want", "text", *prechecks(F.col("text"))).collect()
    for r in got:
        assert {c for c in ("whitespace", "repeated_mark", "filler", "repeated_phrase") if r[c]} == ({r["want"]} if r["want"] else set())
    assert {r["text"]: r["safe_text"] for r in got}["what??"] == "what?"


def test_description_links(spark):
    pages = pd.read_parquet(f"{DATA}/pages.parquet")
    got = {r["page_id"]: r["link"] for r in QUERIES["X-03_description_links"](spark, DATA).collect()}
    assert len(got) == len(pages)
    for page, url in zip(pages.page_id, pages.url, strict=True):
        host = regex.match(r"(?i)^[a-z]+://([^/?#]*)", url)
        secret = bool(host and "@" in host[1]) or bool(regex.search(r"(?i)[?&](token|sig|key|auth|utm_source)=", url)) or bool(regex.match(r"(?i)^[a-z]+://[^/]*\bcdn\b", url))
        assert got[page] == ("[redacted]" if secret else url)


def test_closures_of_chosen_roots(spark):
    roots = spark.createDataFrame([(5,), (40,), (-1,)], "job_id long")
    for query in (dependency_closures, dependents):
        every = {tuple(r) for r in query(spark, DATA).collect()}
        assert {tuple(r) for r in query(spark, DATA, roots).collect()} == {p for p in every if p[0] in (5, 40)}
