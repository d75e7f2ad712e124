"""The hotword guard against containment by hand."""

import random

from tessera.operators.hotwords import guard, hits, ordered_terms


def by_hand(evidence, terms):
    ordered = list(dict.fromkeys(t.strip() for _, t in sorted((p, t) for p, t in terms if t and t.strip())))
    out = {}
    for key, text in evidence:
        out.setdefault(key, set()).update(t for t in ordered if text and t.casefold() in text.casefold())
    return {k: ([t for t in ordered if t in found], len(ordered) - len(found)) for k, found in out.items()}


def test_guard_is_containment_in_order(spark):
    rng = random.Random(4)
    letters = ["a", "b", "ab", "ß", "SS", "É", "é", " ", "词", "İ", "\U0001f600"]
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    terms = [(k, word(rng.randrange(1, 4))) for k in range(60)] + [(100, "  Ab "), (101, "Ab"), (102, "aB"), (103, ""), (104, "　"), (105, None), (3, "ss")]
    evidence = [(k % 12, word(rng.randrange(0, 30))) for k in range(40)] + [(50, None), (50, ""), (51, "strasse"), (52, "ab" * 50_000)]
    for share in (7, 100_000):
        got = guard(spark.createDataFrame(evidence, "key int, text string"), spark.createDataFrame(terms, "place long, term string"), share).collect()
        assert {r["key"]: (r["admitted"], r["n_dropped"]) for r in got} == by_hand(evidence, terms)


def test_no_terms_and_no_evidence(spark):
    none = spark.createDataFrame([], "place long, term string")
    some = spark.createDataFrame([(1, "text")], "key long, text string")
    assert [tuple(r) for r in guard(some, none).collect()] == [(1, [], 0)]
    assert guard(some.limit(0), spark.createDataFrame([(1, "x")], "place long, term string")).count() == 0


def test_no_pairs_are_made(spark):
    texts = spark.createDataFrame([(k, "some text") for k in range(50)], "key long, text string")
    terms = ordered_terms(spark.createDataFrame([(1, "text"), (2, "other")], "place long, term string"))
    found = hits(texts, terms)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and found.count() == 50
