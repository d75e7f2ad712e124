"""Cues of odd texts that are rendered and read back."""

from tessera.plans.catalog import QUERIES
from tessera.plans.dialect import relation


def test_cues_of_odd_texts_are_read_back(spark, tmp_path):
    """Empty cues, cues of digits and blanks, and a start after 100 hours."""
    texts = ["", "\n\na\n\n", "7\n42\n\n00:00:01,000\n \n1", "x" * 6_100_000 + "\nlast\n"]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = relation(spark, str(tmp_path), "segments").where("start_ms >= 0 AND end_ms > start_ms").select("transcript_id", "ordinal", "start_ms")
    got = QUERIES["S-08_srt_cues"](spark, str(tmp_path)).select("transcript_id", "ordinal", "start_ms")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.where("start_ms > 360000000").count() == 2
