"""Best-fit packing under several capacities.

Each sequence has a residual vector: tokens, documents, and attention cost (the sum of squared piece
lengths).  Pieces go by descending length into the open sequence that fits under every constraint and
is best by a weighted norm of what would remain, or by the weighted dot product of demand and residual;
where none fits, a sequence is opened.

Tokenizing needs no shuffle.  Only lengths are packed: pieces are dealt by a hash of their number in the written table into groups of about
``GROUP``, however alike they are, and each group is packed by itself, which costs at most one part-filled sequence a group.  The
groups' number follows from the count of pieces, so a group fits in a task at any size of input.

The query's sequences may hold as many documents and as much attention cost as tokens can make, since they are to be as few as can be: there
only the weights of these two parts bear on the choice of a sequence.  ``pack`` takes any capacities.

Defined cases: a null text is the empty text, a piece of its end id; a null id stays null; an empty table gives no rows; repeated rows
are packed once each and told apart by nothing but their place; very long texts are cut into pieces; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, table
from .tokens import encoder, ids_crc32

CAPACITY = 4096
END_ID = 1
#: Pieces that are packed together.
GROUP = 16384
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: With the number of the task and of the piece in it, by which pieces are dealt.
DEALT = PIECES + ", row long"


def tokenize_pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each (doc_id, text)."""

    def cut(batches):
        encode, row = encoder(tokenizer).encode, TaskContext.get().partitionId() << 40
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for key, ids in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                for k, at in enumerate(range(0, len(ids), capacity)):
                    piece = ids[at : at + capacity]
                    for column, value in zip(rows, (key, k, at, len(piece), ids_crc32(piece), row), strict=True):
                        column.append(value)
                    row += 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return docs.select("doc_id", "text").mapInArrow(cut, DEALT)


def vector_best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float] = (1.0, 0.01, 0.01), by: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """The bin of each piece and its token offset there.

    ``capacity``: tokens, documents and attention cost of a bin.  Raises if a piece fits in no empty bin.
    """
    cap, w = np.array(capacity, float), np.array(weights, float)
    demand = np.stack([lengths, np.ones(len(lengths)), np.square(lengths.astype(float))], 1) / cap
    if len(demand) and demand.max() > 1:
        raise ValueError("a piece is larger than an empty sequence")
    least = demand.min(0) if len(demand) else cap
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    residual, name, made, open_ = np.zeros((1024, 3)), np.zeros(1024, np.int64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    for i in order:
        d = demand[i]
        left = residual[:open_] - d
        fits = np.flatnonzero((left >= -1e-12).all(1))
        if len(fits):
            score = (np.square(left[fits]) @ w) if by == "norm" else -(residual[fits] @ (w * d))
            b = fits[int(np.argmin(score))]
        else:
            if open_ == len(residual):
                residual, name = np.concatenate([residual, np.zeros_like(residual)]), np.concatenate([name, np.zeros_like(name)])
            b = open_
            residual[b], name[b] = 1.0, made
            made, open_ = made + 1, open_ + 1
        bins[i], offsets[i] = name[b], round((1 - residual[b, 0]) * cap[0])
        residual[b] -= d
        if (residual[b] < least - 1e-12).any():  # nothing that remains fits: the last open bin takes its place
            open_ -= 1
            residual[b], name[b] = residual[open_], name[open_]
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, documents: int = CAPACITY, attention: float = float(CAPACITY) ** 2, group: int = GROUP, by: str = "norm") -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (a written table: it is counted first)."""
    groups = -(-pieces.count() // group) or 1
    schema = PIECES + ", sequence_id long, offset long"

    def fit(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        # A fixed order, so that a repeated attempt packs alike.
        rows = rows.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending"), ("row", "ascending")])
        bins, offsets = vector_best_fit(rows.column("length").to_numpy(), (capacity, documents, attention), by=by)
        number = (key[0].as_py() << 32) + bins
        return rows.drop_columns(["grp", "row"]).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offsets))

    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(fit, schema)


def query(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: the document, its place in it, its length and digest, its sequence and offset."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    with Scratch(spark) as s:
        pieces = s.table(tokenize_pieces(docs, tokenizer), "pieces", keep=True)
        return pack(pieces)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packing plan of all documents that are left, with the columns of ``query``; cases as there."""
    return query(spark, sf_dir, docs)
