"""Repeated windows of long texts, in time that grows with their length."""

import random
import time

from tessera.functions.quality import content_signals


def cues(spark, texts):
    rows = [(k, 0, 0, 100, t, 0.9) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "transcript_id long, ordinal long, start_ms long, end_ms long, text string, confidence double")


def test_repeated_windows_of_long_texts(spark):
    rng = random.Random(7)
    far = "".join(chr(0x4E00 + rng.randrange(20_000)) for _ in range(190_000))
    texts = [far, far[:60_000] + "abcdefghi" + far[60_000:120_000] + "abcdefghi" + far[120_000:] + "abcdefghi", "12345678" * 2 + "1234567", "12345678" * 3 + "9", "", "short"]
    content_signals(cues(spark, texts[2:])).collect()
    began = time.time()
    got = {r["transcript_id"]: r["repeated_ngram"] for r in content_signals(cues(spark, texts)).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 1, 4: 0, 5: 0}
    assert time.time() - began < 20
