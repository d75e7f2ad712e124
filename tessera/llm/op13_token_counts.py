"""Token counts of documents of any length, with huge texts encoded as overlapping chunks in parallel.

Texts of up to ``HUGE`` characters are counted where they are read.  A longer text is cut every ``chunk`` characters, each
chunk reaches ``overlap`` characters into the next one, and the chunks of all texts are dealt out evenly and encoded with
offsets.  Two neighbours are spliced in the overlap at a stable common boundary, and a text's count is that of its chunks less what is
left out on both sides of each splice.

What makes a boundary stable: it is a space between two characters that are not white space.  The library's pre-tokenizers
cut before such a space, so do its normalizers (nothing composes with or depends on letters beyond a space), pieces of a
sentence-piece model hold a space only at their start, and no special token holds one; so no token crosses it,
and the tokens on each side follow from that side alone.  What makes it common: in both encodings no token crosses it, and from it to a later such
place all tokens agree in offset and id.  So what a chunk's torn first and last words do to its tokens stays outside.  Where an overlap has no
two such places, as in a text without spaces, the text is cut anew with chunks twice and overlaps eight times as long, until every splice is found or one chunk holds the text.

Copies of a huge text are encoded once: chunks are named by the text's SHA-256 and the chunk's number, a task that reads copies hands on one, and
so does the task that encodes.

Special strings inside a text are handled as the library does by default, in ordinary and in huge texts alike.

Defined cases: a null text is the empty text, with no bytes and no tokens; a null id stays null; repeated rows are counted each; an empty table gives no rows;
a text without spaces is, in the end, one chunk, which takes the memory that the library takes for it; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, table
from .tokens import PieceEncoder

#: Tokens beyond which a document is over the limit.
LIMIT = 2048
#: Characters beyond which a text is cut, of a chunk, and of the first overlap.
HUGE, CHUNK, OVERLAP = 32_768, 16_384, 512
#: Characters of chunks that one task encodes, about.
PER_TASK = 4 << 20
#: A space between two characters that are not white space.
SAFE = re.compile(r"(?<=\S) (?=\S)")


class Library:
    """What a tokenizer file's library gives: counts of texts, and tokens with offsets in characters."""

    def __init__(self, path: str):
        self.pieces = None
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = PieceEncoder(path)

    def counts(self, texts: list[str]) -> list[int]:
        if self.pieces is None:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        # The encoder by pieces takes special strings for ordinary text, so texts that hold one go to the library.
        odd = [k for k, x in enumerate(texts) if any(s in x for s in self.special)]
        plain = texts if not odd else [*texts]
        for k in odd:
            plain[k] = ""
        out = [len(ids) for ids in self.pieces.encode(plain)]
        for k in odd:
            out[k] = len(self.tokenizer.encode(texts[k], add_special_tokens=False).ids)
        return out

    def tokens(self, text: str) -> np.ndarray:
        """A row (start, end, id) for each token."""
        if self.pieces is not None:
            e = self.tokenizer.encode(text, add_special_tokens=False)
            return np.array([(*at, k) for at, k in zip(e.offsets, e.ids, strict=True)], np.int64).reshape(-1, 3)
        rows = np.array([(p.begin, p.end, p.id) for p in self.model.encode(text, return_type="proto").pieces], np.int64).reshape(-1, 3)
        # Its offsets are in bytes: characters before a byte are those whose first byte comes before it.
        starts = np.frombuffer(text.encode(), np.uint8) & 0xC0 != 0x80
        rows[:, :2] = np.append(0, np.cumsum(starts))[rows[:, :2]]
        return rows


_LIBRARIES: dict[str, Library] = {}


def library(path: str) -> Library:
    """One per file and worker process."""
    if path not in _LIBRARIES:
        _LIBRARIES[path] = Library(path)
    return _LIBRARIES[path]


def cut(text: str, chunk: int, overlap: int) -> list[str]:
    return [text[at : at + chunk + overlap] for at in range(0, len(text), chunk)] or [""]


def zone(tokens: np.ndarray, first: int, last: int) -> tuple[np.ndarray, int]:
    """The tokens that touch [first, last), and how many come before them."""
    before = int(np.searchsorted(np.maximum.accumulate(tokens[:, 1]), first, "right")) if len(tokens) else 0
    return tokens[before : int(np.searchsorted(tokens[:, 0], last, "left"))], before


def splice(left: np.ndarray, right: np.ndarray, places: np.ndarray) -> tuple[int, int] | None:
    """How many tokens of each zone lie before the first stable common boundary, or None if there is none.

    ``places`` are the safe places of the overlap; a boundary is one of them with an equal run of tokens from it to the last of them.
    """

    def clean(tokens: np.ndarray, at: int) -> int:
        """The number of tokens that start before ``at``, or -1 if one of them goes on behind it."""
        n = int(np.searchsorted(tokens[:, 0], at, "left"))
        return n if not n or tokens[:n, 1].max() <= at else -1

    for q in places[::-1].tolist():
        a_end, b_end = clean(left, q), clean(right, q)
        if a_end < 0 or b_end < 0:
            continue
        for p in places[places < q].tolist():
            a, b = clean(left, p), clean(right, p)
            if a >= 0 and b >= 0 and a < a_end and np.array_equal(left[a:a_end], right[b:b_end]):
                return a, b
        return None
    return None


def _bytes(rows: np.ndarray) -> bytes:
    return np.ascontiguousarray(rows, np.int64).tobytes()


CHUNKS = "key string, k long, n_chunks long, chunk string"
JUNCTIONS = "key string, junction long, n long, left_rest long, left binary, places binary, right_before long, right binary"


def _cutter(chunk: int, overlap: int):
    """Yields the chunk rows of huge texts, once for each text of a task."""
    seen: set[str] = set()

    def rows(text: str, key: str):
        if key in seen:
            return []
        seen.add(key)
        parts = cut(text, chunk, overlap)
        return [(key, k, len(parts), part) for k, part in enumerate(parts)]

    return rows


def encode_chunks(chunks: DataFrame, path: str, chunk: int, overlap: int, per_task: int = PER_TASK) -> DataFrame:
    """Of each chunk one row with its number of tokens, and one for each junction that it is a side of."""

    def encode(batches):
        lib, at = library(path), None
        for batch in batches:
            out = []
            for key, k, n_chunks, text in zip(*(batch.column(c).to_pylist() for c in ("key", "k", "n_chunks", "chunk")), strict=True):
                if (key, k) == at:
                    continue  # a copy's chunk, read by another task
                at, start = (key, k), k * chunk
                tokens = lib.tokens(text)
                tokens[:, :2] += start
                row = dict.fromkeys(("left_rest", "left", "places", "right_before", "right"))
                out.append(row | {"key": key, "junction": None, "n": len(tokens)})
                if k:
                    own, before = zone(tokens, start, start + overlap)
                    out.append(row | {"key": key, "junction": k - 1, "n": 0, "right": _bytes(own), "right_before": before})
                if k < n_chunks - 1:
                    first, last = start + chunk, start + chunk + overlap
                    own, before = zone(tokens, first, last)
                    places = np.array([m.start() + start for m in SAFE.finditer(text, chunk, chunk + overlap)], np.int64)
                    out.append(row | {"key": key, "junction": k, "n": 0, "left": _bytes(own), "left_rest": len(tokens) - before, "places": places.tobytes()})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("key", pa.string()), ("junction", pa.int64()), ("n", pa.int64()), ("left_rest", pa.int64()), ("left", pa.binary()), ("places", pa.binary()), ("right_before", pa.int64()), ("right", pa.binary())])
    tasks = max(1, chunks.count() * chunk // per_task)
    return chunks.repartition(tasks, "key", "k").sortWithinPartitions("key", "k").mapInArrow(encode, JUNCTIONS)


def count_huge(scratch: Scratch, chunks: DataFrame, path: str, chunk: int, overlap: int, name: str) -> DataFrame:
    """(key, n_tokens) of each text, n_tokens null where a splice was not found."""

    def spliced(batches):
        for batch in batches:
            found = []
            for left, right, places, rest, before in zip(*(batch.column(c).to_pylist() for c in ("left", "right", "places", "left_rest", "right_before")), strict=True):
                at = splice(np.frombuffer(left, np.int64).reshape(-1, 3), np.frombuffer(right, np.int64).reshape(-1, 3), np.frombuffer(places, np.int64))
                found.append(None if at is None else rest - at[0] + before + at[1])
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "left_out": pa.array(found, pa.int64())})

    rows = scratch.table(encode_chunks(chunks, path, chunk, overlap), f"encoded-{name}")
    sides = [F.max(c).alias(c) for c in ("left_rest", "right_before")] + [F.first(c, ignorenulls=True).alias(c) for c in ("left", "places", "right")]
    pairs = rows.where("junction IS NOT NULL").groupBy("key", "junction").agg(*sides)
    left_out = pairs.mapInArrow(spliced, "key string, left_out long").groupBy("key").agg(F.sum("left_out").alias("left_out"), F.count(F.when(F.col("left_out").isNull(), 1)).alias("torn"))
    whole = rows.where("junction IS NULL").groupBy("key").agg(F.sum("n").alias("n"))
    n_tokens = F.when(F.coalesce("torn", F.lit(0)) == 0, F.col("n") - F.coalesce("left_out", F.lit(0)))
    return scratch.table(whole.join(left_out, "key", "left").select("key", n_tokens.alias("n_tokens")), f"huge-{name}")


def token_counts(scratch: Scratch, docs: DataFrame, path: str, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row of (doc_id, text)."""
    if not 0 < overlap <= chunk:
        raise ValueError("an overlap is no longer than a chunk")
    kind = dict(docs.dtypes)["doc_id"]

    def read(batches):
        lib, rows_of = library(path), _cutter(chunk, overlap)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            long = [k for k, x in enumerate(texts) if len(x) > huge]
            names = {k: hashlib.sha256(texts[k].encode()).hexdigest() for k in long}
            counts = lib.counts([x if len(x) <= huge else "" for x in texts])
            sizes = [len(x.encode()) for x in texts]
            none = pa.nulls(len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([None if k in names else n for k, n in enumerate(counts)], pa.int64()), pa.array([names.get(k) for k in range(len(texts))], pa.string()), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.string())],
                names=["doc_id", "n_bytes", "n_tokens", "key", "k", "n_chunks", "chunk"],
            )
            for k in long:
                if rows := rows_of(texts[k], names[k]):
                    none = pa.nulls(len(rows))
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays([none.cast(batch.schema.field("doc_id").type), none.cast(pa.int64()), none.cast(pa.int64()), *columns], names=["doc_id", "n_bytes", "n_tokens", "key", "k", "n_chunks", "chunk"])

    first = scratch.table(docs.select("doc_id", "text").mapInArrow(read, f"doc_id {kind}, n_bytes long, n_tokens long, {CHUNKS}"), "first", keep=True)
    rows = first.where("k IS NULL").select("doc_id", "n_bytes", "n_tokens", "key")
    chunks, counted, turn = first.where("k IS NOT NULL").select("key", "k", "n_chunks", "chunk"), None, 0
    while not chunks.isEmpty():
        found = count_huge(scratch, chunks, path, chunk, overlap, str(turn))
        done = found.where("n_tokens IS NOT NULL")
        counted = done if counted is None else counted.unionByName(done)
        torn = found.where("n_tokens IS NULL").select("key")
        if torn.isEmpty():
            break
        overlap, turn = overlap * 8, turn + 1
        chunk = max(2 * chunk, overlap)
        chunks = scratch.table(recut(docs.where(F.char_length("text") > huge), chunk, overlap).join(torn, "key", "left_semi"), f"chunks-{turn}")
    if counted is None:
        return rows.select("doc_id", "n_bytes", "n_tokens")
    counted = scratch.table(counted, "counted", keep=True)
    huge_rows = rows.where("key IS NOT NULL").drop("n_tokens").join(counted, "key").select("doc_id", "n_bytes", "n_tokens")
    return rows.where("key IS NULL").select("doc_id", "n_bytes", "n_tokens").unionByName(huge_rows)


def recut(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """The chunk rows of texts, cut anew."""

    def read(batches):
        rows_of = _cutter(chunk, overlap)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if rows := rows_of(text, hashlib.sha256(text.encode()).hexdigest()):
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "k", "n_chunks", "chunk"])

    return docs.select("text").mapInArrow(read, CHUNKS)


def query(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """One row per document: its bytes, its tokens, and whether it is over the limit."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    with Scratch(spark) as s:
        found = token_counts(s, table(spark, sf_dir, "documents"), tokenizer)
    return found.withColumn("over_limit", F.col("n_tokens") > LIMIT)
