"""Stages on null and repeated ids."""

from corpora import prose, write

from tessera.llm import op02_set_relation_join as op2


def kept(spark, tmp_path, rows):
    folder = write(tmp_path, rows)
    out = op2.keep_one(spark, spark.read.parquet(folder + "/documents.parquet"), folder)
    return sorted(((r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()), key=repr)


def test_near_copies_go_by_id_and_text(spark, tmp_path):
    import random

    rng = random.Random(11)
    a, b, c, d, e, f = (prose(rng, 100) for _ in range(6))
    rows = [(1, a), (None, a + " tail"), (None, b), (None, c), (None, c), (7, d), (7, e), (7, e), (9, e + " tail"), (8, f), (8, f + " tail"), (3, None), (3, "")]
    want = [(1, a), (None, b), (None, c), (7, d), (7, e), (3, None), (3, "")]
    got = kept(spark, tmp_path, rows)
    eight = [x for x in got if x[0] == 8]
    assert len(eight) == 1 and eight[0][1] in (f, f + " tail")
    assert [x for x in got if x[0] != 8] == sorted(want, key=repr)


def test_copies_between_the_thresholds_go(spark, tmp_path):
    """Four scattered edits in 200 words: 0.89 of three-word shingles, 0.81 of five-word ones; a pair and a large group."""
    rows = []
    for group, size in ((0, 2), (1000, 90)):
        base = [f"w{group + k}" for k in range(200)]
        for k in range(size):
            w = list(base)
            for at in (20, 70, 120, 170) if k else ():
                w[at] = f"e{k}at{at}"
            rows.append((group + k, " ".join(w)))
    assert [x[0] for x in kept(spark, tmp_path, rows)] == [0, 1000]
