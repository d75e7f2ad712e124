"""Token-ID output as one wavelet matrix per shard.

Documents are cut into ranges of their ids and sorted; a range's documents are encoded, each is ended with an end
id, and a shard is closed whenever enough ids have gathered, so memory is bounded by a shard plus one document.  Ranges follow from running sums of all
texts' sizes in order, and file names from ranges, so the same rows give the same files to the byte, on any number of cores.
A shard file holds the ids as bit-planes from the highest bit down, each stably partitioned by the planes
above it, with a directory of ones before every 512 bits, and the documents' ids and starts.  All parts are
zstd frames of one file.  ``WaveletMatrix`` gives access, rank (counting), select and occurrence lookup
without restoring the ids, and ``decode`` restores them all.

The query writes the shards, reads them back, and takes its columns from what it read.

Defined cases: a null text is the empty text, whose only id is the end id; an empty table gives no files and no
rows; a null id comes first and stays
null; rows of equal id are kept, in order of their text's hash, by which many of one id, such as null, are also cut; repeated rows follow one another; a very long
text is in one shard; other columns are not read.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files
from .scratch import Scratch, given, held, table
from .tokens import encoder, ids_crc32

MAGIC = b"TWM1"
#: Ids after which a shard is closed, and bytes of text in a range.
SHARD_IDS, RANGE_BYTES = 1 << 21, 8 << 20
#: Bits between two counts of the rank directory.
STEP = 512
END_ID = 2


class WaveletMatrix:
    """``planes[k]`` is bit ``bits-1-k`` of the ids, in the order that the planes above leave them in."""

    def __init__(self, n: int, planes: list[np.ndarray], ones: list[np.ndarray]):
        self.n, self.planes, self.ones = n, planes, ones
        self.zeros = [n - int(o[-1]) for o in ones]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        narrow = np.uint16 if bits <= 16 else np.uint32
        planes, ones, rest = [], [], ids.astype(narrow)
        for b in range(bits - 1, -1, -1):
            on = (rest & narrow(1 << b)) != 0
            packed = np.packbits(on, bitorder="little")
            planes.append(packed)
            ones.append(cls._directory(packed))
            rest = np.concatenate([np.compress(~on, rest), np.compress(on, rest)])
        return cls(len(ids), planes, ones)

    @staticmethod
    def _directory(packed: np.ndarray) -> np.ndarray:
        """Ones before every STEP bits, and in all."""
        counts = np.bitwise_count(packed)
        counts = np.add.reduceat(counts, np.arange(0, len(counts), STEP // 8), dtype=np.uint32) if len(counts) else counts.astype(np.uint32)
        return np.concatenate([np.zeros(1, np.uint32), np.cumsum(counts, dtype=np.uint32)])

    def _bit(self, k: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[k][at >> 3] >> (at & 7).astype(np.uint8)) & 1

    def _rank1(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits of plane k."""
        at = np.asarray(at, np.int64)
        block = at // STEP
        out = self.ones[k][block].astype(np.int64)
        plane, first = self.planes[k], block * (STEP // 8)
        for j in range(STEP // 8):  # whole bytes, then the last bits
            inside = first + j < at >> 3
            if not inside.any():
                break
            out += np.where(inside, np.bitwise_count(plane[np.minimum(first + j, len(plane) - 1)]), 0)
        last = plane[np.minimum(at >> 3, len(plane) - 1)] & ((1 << (at & 7)) - 1).astype(np.uint8)
        return out + np.where(at & 7, np.bitwise_count(last), 0)

    def access(self, at) -> np.ndarray:
        """The ids at the given places."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        out = np.zeros(len(at), np.uint32)
        for k in range(len(self.planes)):
            bit, r = self._bit(k, at).astype(bool), self._rank1(k, at)
            out = (out << np.uint32(1)) | bit
            at = np.where(bit, self.zeros[k] + r, at - r)
        return out

    def _range(self, value: int, end: int) -> tuple[int, int]:
        """Where the occurrences of ``value`` among the first ``end`` ids lie after the last plane."""
        a, b = 0, end
        if value >> len(self.planes):
            return 0, 0
        for k in range(len(self.planes)):
            ra, rb = self._rank1(k, np.array([a, b])).tolist()
            a, b = (self.zeros[k] + ra, self.zeros[k] + rb) if value >> (len(self.planes) - 1 - k) & 1 else (a - ra, b - rb)
        return a, b

    def rank(self, value: int, end: int | None = None) -> int:
        """How often ``value`` occurs among the first ``end`` ids, or among all."""
        a, b = self._range(value, self.n if end is None else end)
        return b - a

    def select(self, value: int, nth) -> np.ndarray:
        """The places of the nth (from 0) occurrences of ``value``."""
        a, b = self._range(value, self.n)
        at = a + np.atleast_1d(np.asarray(nth, np.int64))
        if len(at) and (at.min() < a or at.max() >= b):
            raise IndexError("no such occurrence")
        for k in range(len(self.planes) - 1, -1, -1):
            one = value >> (len(self.planes) - 1 - k) & 1
            at = self._select_bit(k, one, at - self.zeros[k] if one else at)
        return at

    def _select_bit(self, k: int, one: int, nth: np.ndarray) -> np.ndarray:
        """The place of the nth one (or zero) of a plane, by halving on ranks."""
        low, high = np.zeros(len(nth), np.int64), np.full(len(nth), self.n, np.int64)
        while (low < high).any():
            mid = (low + high) // 2
            r = self._rank1(k, mid + 1)
            enough = (r if one else mid + 1 - r) > nth
            open_ = low < high
            high, low = np.where(open_ & enough, mid, high), np.where(open_ & ~enough, mid + 1, low)
        return low

    def occurrences(self, value: int) -> np.ndarray:
        return self.select(value, np.arange(self.rank(value)))

    def decode(self) -> np.ndarray:
        """All ids, by undoing each plane's partition from the last up."""
        bits = len(self.planes)
        narrow = np.uint16 if bits <= 16 else np.uint32
        out = np.zeros(self.n, narrow)
        for k in range(bits - 1, -1, -1):
            on = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            up = np.empty_like(out)
            up[~on] = out[: self.zeros[k]]
            up[on] = out[self.zeros[k] :] | narrow(1 << (bits - 1 - k))
            out = up
        return out.astype(np.uint32)


def pack_shard(ids: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray) -> bytes:
    wm = WaveletMatrix.build(ids)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    parts = [doc_ids.astype("<i8"), starts.astype("<i8"), *wm.planes, *[o.astype("<u4") for o in wm.ones]]
    frames = [squeeze(np.ascontiguousarray(p).tobytes()) for p in parts]
    head = json.dumps({"n": wm.n, "docs": len(doc_ids), "bits": len(wm.planes), "frames": [len(f) for f in frames]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *frames])


def unpack_shard(data: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray]:
    """The matrix, the documents' ids, and where each document starts."""
    if data[:4] != MAGIC:
        raise ValueError("not a shard file")
    (size,) = struct.unpack_from("<I", data, 4)
    head, place, parts = json.loads(data[8 : 8 + size]), 8 + size, []
    for length in head["frames"]:
        parts.append(zstandard.ZstdDecompressor().decompress(data[place : place + length]))
        place += length
    bits = head["bits"]
    planes = [np.frombuffer(p, np.uint8) for p in parts[2 : 2 + bits]]
    ones = [np.frombuffer(p, "<u4") for p in parts[2 + bits :]]
    return WaveletMatrix(head["n"], planes, ones), np.frombuffer(parts[0], "<i8"), np.frombuffer(parts[1], "<i8")


SHARDS = files.MANIFEST + ", part int, seq int, n_ids long"


def write_shards(scratch: Scratch, docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Writes (doc_id, text) in ascending order of doc_id; returns the manifest."""

    def write(batches):
        encode = encoder(tokenizer).encode
        gathered, keys, n, at, seq = [], [], 0, None, 0

        def close():
            ids = np.concatenate(gathered)
            lengths = np.fromiter(map(len, gathered), np.int64, len(gathered))
            out = files.Output(folder, f"range-{at:06d}-{seq:06d}.twm")
            out.write(pack_shard(ids, np.array(keys, np.int64), np.cumsum(lengths) - lengths))
            name, temporary, size, digest = out.close()
            return pa.RecordBatch.from_pydict({"name": [name], "temporary": [temporary], "bytes": [size], "sha256": [digest], "part": pa.array([at], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_ids": [len(ids)]})

        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for part, key, ids in zip(batch.column("part").to_pylist(), batch.column("id").to_pylist(), encode(texts), strict=True):
                if at != part:
                    if gathered:
                        yield close()
                    gathered, keys, n, at, seq = [], [], 0, part, 0
                gathered.append(np.append(ids, np.uint32(end_id)))
                keys.append(key)
                n += len(gathered[-1])
                if n >= shard_ids:
                    yield close()
                    gathered, keys, n, seq = [], [], 0, seq + 1
        if gathered:
            yield close()

    rows = docs.select(held("doc_id").alias("id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"))
    sizes = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    keys = scratch.table(rows.select("id", "tag", sizes.cast("long").alias("bytes")), "keys")
    bucket, n_ranges = files.even_ranges(scratch, keys, range_bytes)
    ranged = rows.withColumn("part", bucket).repartitionById(n_ranges, F.col("part")).sortWithinPartitions("part", "id", "tag")
    manifest = scratch.table(ranged.mapInArrow(write, SHARDS), "manifest", keep=True)
    return files.commit(scratch, manifest, folder)


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """(part, seq, doc_id, start in the shard, n_tokens, ids_crc32) of each document, from the files."""
    schema = "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long"

    def read(batches):
        fs, root = files.at(folder)
        for batch in batches:
            for name, part, seq in zip(*(batch.column(c).to_pylist() for c in ("name", "part", "seq")), strict=True):
                with fs.open_input_stream(f"{root}/{name}") as f:
                    matrix, keys, starts = unpack_shard(f.read())
                ids = matrix.decode()
                ends = np.append(starts[1:], len(ids))
                crc = [ids_crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), part, np.int32)), pa.array(np.full(len(keys), seq, np.int32)), pa.array(keys), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())],
                    names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    spread = files.spread(manifest.select("name", "part", "seq"))
    return spread.mapInArrow(read, schema)


def query(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """One row per document, from the files: its place among all ids, its number of ids, and their CRC-32."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    with Scratch(spark) as s:
        folder = s.path("shards")
        manifest = write_shards(s, table(spark, sf_dir, "documents"), folder, tokenizer)
        found = s.table(read_shards(manifest, folder), "found", keep=True)
    # Ids before a shard: those of the ranges before its own, then of its own range's shards before it.
    in_part = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("all")).withColumn("before", F.sum("all").over(Window.orderBy("part")) - F.col("all"))
    shards = manifest.withColumn("in_part", in_part).join(parts, "part").select("part", "seq", (F.col("in_part") + F.col("before")).alias("first"))
    return found.join(shards, ["part", "seq"]).select(given("doc_id").alias("doc_id"), (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
