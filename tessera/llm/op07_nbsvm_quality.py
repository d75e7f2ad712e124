"""Quality classifier: Naive Bayes support vectors.

Features are indicators of hashed n-grams: runs of one and two words, and of one to three word shapes (which kinds of
characters a word has, and whether it repeats the word before).  Each indicator is scaled by the log ratio
of its smoothed counts in the two classes; a linear hinge-loss model is then fitted by dual coordinate
descent, and its margin is mapped to 0..1 by a logistic curve fitted on the training rows.

Labels are learned from at most ``TRAIN_ROWS`` documents of at most ``TRAIN_BYTES`` bytes of text together, taken in the order of a hash of their id, whatever the
corpus's size; ids, languages and sources are never inputs of a score.  Every document is scored over its
whole text, with no shuffle; what tasks get is one vector of fixed length.

Defined cases: a null text is the empty text, which has no indicators and scores by the bias alone; rows
without a label, or with a null one, are only scored; with no labels, or those of one class, every score is that
class's smoothed rate; an empty table gives no rows; repeated rows give repeated rows, and are learned from once; of several texts of one labelled id, that
with the smallest hash is learned from; of unlike labels of one id the smaller counts; a labelled text that alone passes the bytes is passed over; null ids stay null (and
are not held out); a score of just one half predicts 1; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import table
from .wordhash import Words, chunks, mix

#: Labelled documents that are learned from, at most, and bytes of their texts.
TRAIN_ROWS, TRAIN_BYTES = 8192, 16 << 20
#: Buckets of the n-gram hash: words below, shapes above the half.
BUCKETS = 1 << 18
#: Count smoothing, cost of a hinge violation, passes over the rows, share of the fitted weights against their mean.
ALPHA, COST, PASSES, SHARE = 1.0, 1.0, 20, 0.5


def _classes() -> np.ndarray:
    """Per byte one bit: lower case, upper case, digit, sentence mark, bar, symbol, exclamation, other."""
    kind = np.full(256, 128, np.uint16)
    kind[128:] = 1
    for marks, bit in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 4), (".,;:", 8), ("|", 16), ("#$%&*@^~<>", 32), ("!?", 64)):
        kind[[ord(c) for c in marks]] = bit
    kind[[9, 10, 11, 12, 13, 32]] = 0
    return kind


_CLASS = _classes()
_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[[9, 10, 11, 12, 13]] = 32


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of each text, end to end, and how many each text has."""
    w = Words(texts, _SPACED)
    half, n = BUCKETS // 2, len(texts)
    if not len(w.start):
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    kinds = _CLASS[w.data]
    shape = np.bitwise_or.reduceat(kinds, w.start).astype(np.int64)
    same_text = np.zeros(len(shape), bool)
    same_text[1:] = w.doc[1:] == w.doc[:-1]
    again = np.zeros(len(shape), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & same_text[1:]
    one = shape | (again.astype(np.int64) << 8)
    doc = w.doc.astype(np.int64)
    two_ok = same_text
    three_ok = same_text.copy()
    three_ok[1:] &= same_text[:-1]
    before, two_before = np.roll(one, 1), np.roll(one, 2)
    grams = [(doc, one), (doc[two_ok], (1 << 27) | (before << 9 | one)[two_ok]), (doc[three_ok], (1 << 28) | (two_before << 18 | before << 9 | one)[three_ok])]
    two = mix(w.hash + np.roll(w.hash, 1) * np.uint64(0x9E3779B97F4A7C15))[same_text]
    of_words = [(doc, w.hash), (doc[same_text], two)]
    keys = [d * BUCKETS + (h % np.uint64(half)).astype(np.int64) for d, h in of_words]
    for d, code in grams:
        found = np.unique(d << 30 | code)
        code = mix((found & ((1 << 30) - 1)).astype(np.uint64)) % np.uint64(half)
        keys.append((found >> 30) * BUCKETS + half + code.astype(np.int64))
    key = np.unique(np.concatenate(keys))
    return key % BUCKETS, np.bincount(key // BUCKETS, minlength=n)


@dataclass
class Model:
    """``value`` of each bucket in the margin, its square for the norm, the bias, and the logistic curve."""

    value: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(counts)), counts)
        norm = np.sqrt(np.bincount(row, self.square[buckets], len(counts)))
        return np.bincount(row, self.value[buckets], len(counts)) / np.maximum(norm, 1e-12) + self.bias

    def scores(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(buckets, counts) + self.offset, -30, 30)))


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, passes: int, size: int, seed: int = 0) -> np.ndarray:
    """Weights of the L1-loss linear support vector machine, with a bias as the last weight."""
    w, alpha, rng = np.zeros(size + 1), np.zeros(len(y)), np.random.default_rng(seed)
    diagonal = np.array([float(v @ v) for v in values]) + 1
    for _ in range(passes):
        worst = 0.0
        for i in rng.permutation(len(y)):
            r, v = rows[i], values[i]
            gradient = y[i] * (w[r] @ v + w[size]) - 1
            if (alpha[i] <= 0 and gradient >= 0) or (alpha[i] >= cost[i] and gradient <= 0):
                continue
            worst = max(worst, abs(gradient))
            new = min(max(alpha[i] - gradient / diagonal[i], 0), cost[i])
            step, alpha[i] = (new - alpha[i]) * y[i], new
            w[r] += step * v
            w[size] += step
        if worst < 0.01:
            break
    return w


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """From each row's distinct buckets and its label (0 or 1)."""
    flat = np.zeros(BUCKETS)
    n1 = int(labels.sum())
    n0 = len(labels) - n1
    if not n0 or not n1:
        rate = (n1 + 1) / (len(labels) + 2)
        return Model(flat, flat, 0.0, 0.0, float(np.log(rate / (1 - rate))))
    counts = np.full((2, BUCKETS), ALPHA)
    for r, y in zip(rows, labels, strict=True):  # a row's buckets are distinct
        counts[int(y), r] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    values = [(ratio[r] / max(np.linalg.norm(ratio[r]), 1e-12)).astype(np.float32) for r in rows]
    y = np.where(labels == 1, 1.0, -1.0)
    cost = COST * len(y) / 2 / np.where(labels == 1, n1, n0)  # both classes weigh alike
    w = dual_coordinate_descent(rows, values, y, cost, PASSES, BUCKETS)
    mean = np.abs(w[:-1]).mean()
    value = ratio * (SHARE * w[:-1] + (1 - SHARE) * mean)
    model = Model(value, ratio**2, SHARE * w[-1], 1.0, 0.0)
    m = np.array([model.margins(r, np.array([len(r)]))[0] for r in rows])
    # Logistic curve by Newton's method, on smoothed targets.
    target, a, b = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2)), 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        grad, hess = np.array([g @ m, g.sum()]), np.array([[h @ (m * m) + 1e-6, h @ m], [h @ m, h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return Model(value.astype(np.float32), (ratio**2).astype(np.float32), model.bias, float(a), float(b))


def fold(key: str | Column) -> Column:
    """CRC-32 of the id as text, modulo 3; rows of fold 1 are held out."""
    return F.crc32(F.encode(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), "UTF-8")) % 3


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Model:
    """``docs`` (doc_id, text), ``labels`` (doc_id and the label)."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & (fold("doc_id") != 1))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most ``rows`` rows on this side of the joins: its size is bounded, so it is broadcast.
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    sizes = keyed.select("doc_id", "tag", F.octet_length("text").alias("bytes")).join(F.broadcast(known), "doc_id")
    sizes = sizes.groupBy("doc_id", "y").agg(F.min(F.struct("tag", "bytes")).alias("t")).select("doc_id", "y", "t.*").where(F.col("bytes") <= most_bytes)
    so_far = F.sum("bytes").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over at most ``rows`` rows
    chosen = sizes.withColumn("so_far", so_far).where(F.col("so_far") <= most_bytes).select("doc_id", "tag", "y")

    def extract(batches):
        for batch in batches:
            texts, y = [x or "" for x in batch.column("text").to_pylist()], batch.column("y").to_pylist()
            for start, run in chunks(texts):
                buckets, counts = features(run)
                parts = np.split(buckets.astype(np.uint32), np.cumsum(counts)[:-1])
                yield pa.RecordBatch.from_pydict({"y": pa.array(y[start : start + len(run)], pa.int32()), "buckets": pa.array([p.tobytes() for p in parts], pa.binary())})

    texts = keyed.join(F.broadcast(chosen), ["doc_id", "tag"]).dropDuplicates(["doc_id", "tag"])
    found = texts.select("y", "text").mapInArrow(extract, "y int, buckets binary").toArrow()
    order = sorted(zip(found.column("buckets").to_pylist(), found.column("y").to_pylist(), strict=True))
    del found
    return fit([np.frombuffer(b, np.uint32) for b, _ in order], np.array([y for _, y in order], np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each (doc_id, text)."""

    def scored(batches):
        for batch in batches:
            texts, out = [x or "" for x in batch.column("text").to_pylist()], []
            for _, run in chunks(texts):
                out.append(model.scores(*features(run)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(out) if out else np.zeros(0))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: whether it is held out, its score, and the class predicted from it."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(fold("doc_id") == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score below a half go; all others stay as they are, with all columns, repeated rows and null ids."""
    model = train(docs, table(spark, sf_dir, "labels"))

    def keep(batches):
        for batch in batches:
            texts, out = [x or "" for x in batch.column("text").to_pylist()], []
            for _, run in chunks(texts):
                out.append(model.scores(*features(run)) >= 0.5)
            yield batch.filter(pa.array(np.concatenate(out))) if out else batch

    return docs.mapInArrow(keep, docs.schema)
