"""Deterministic sharded WARC writer, and its reader.

Records are cut into ranges of their ids and sorted.  A range's records are written as gzip members to a file, which
rolls to the next once the compressed size passes a limit.  Ranges follow from running sums of all payloads' sizes in order, and file names
from ranges; every header, digest and record id is made anew
from the payload and the id, so the same rows give the same files to the byte, on any number of cores and however the input is partitioned.  Files are written under temporary names,
listed in a manifest with their size and SHA-256, and renamed from it.

Of records with equal payloads of at least ``REVISIT_BYTES``, that with the smallest id is the response and the
others are revisits of it, each by its id and digest.  That is decided on (id, digest, length) alone; the payloads are shuffled once, by
the range sort, into which the references enter as rows of their own.

Rows of one id, such as null, are ordered and cut by a hash of payload and URL.

Defined cases: a null payload is empty; a very long one is one record; a null URL is written as an empty target; a null id is kept as none,
and its record is a response; an
empty table gives no files and no rows; rows of equal id are all written, and all are responses if that id is the
smallest of their payload (repeated rows likewise); other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .scratch import Scratch, held, table

REVISIT_BYTES = 100
#: Compressed bytes after which a file is closed, and bytes of payloads in a range.
ROLL_BYTES, RANGE_BYTES = 64 << 20, 8 << 20
#: What a record's headers take, by which small records are counted.
RECORD_BYTES = 512
#: The date that records bear: a fixed one, since the time of writing would change the bytes.
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:page")


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, str(page))}>"


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member with no time and no name in it."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def block_digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def make_record(page: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit whose block is the response's HTTP header without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    target = "".join(c for c in url if c not in "\r\n")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"X-Record-Key: {'' if page is None else page}", f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Key: {refers_to}", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Block-Digest: {block_digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """The header's fields, the HTTP header and the payload; raises where a length or digest doesn't fit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    size = int(fields["Content-Length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n" or block_digest(block) != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    if fields["WARC-Type"] == "response" and "sha256:" + hashlib.sha256(payload).hexdigest() != fields["WARC-Payload-Digest"]:
        raise ValueError(f"damaged payload {fields.get('WARC-Record-ID')}")
    return fields, http, payload


def members(stream, chunk: int = 1 << 20):
    """The records of one file, one at a time."""
    data, inflate, out = b"", zlib.decompressobj(31), []
    while True:
        if not data:
            data = stream.read(chunk)
            if not data:
                if out:
                    raise ValueError("the file ends within a record")
                return
        out.append(inflate.decompress(data))
        data = inflate.unused_data
        if inflate.eof:
            yield b"".join(out)
            inflate, out = zlib.decompressobj(31), []


def write_archives(scratch: Scratch, pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Writes (page_id, url, html) and returns the manifest."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    meta = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size"), F.xxhash64("url").alias("of_url"))
    meta = scratch.table(meta.withColumn("tag", F.xxhash64("digest", "of_url")), "meta")
    large = meta.where(F.col("size") >= REVISIT_BYTES)
    first = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = large.join(first, "digest").where("page_id <> refers_to").select("page_id", "tag", "digest", "refers_to").distinct()
    again = scratch.table(again, "again")

    keys = meta.select(held("page_id").alias("id"), "tag", (F.col("size") + RECORD_BYTES).cast("long").alias("bytes"))
    bucket, n_ranges = files.even_ranges(scratch, keys, range_bytes)

    def write(batches):
        at, out, seq, n, source = None, None, 0, 0, None

        def close():
            name, temporary, size, digest = out.close()
            return pa.RecordBatch.from_pydict({"name": [name], "temporary": [temporary], "bytes": [size], "sha256": [digest], "records": [n]})

        for batch in batches:
            for part, page, tag, url, html, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("part", "page_id", "tag", "url", "html", "digest", "refers_to")), strict=True):
                if refers is not None:  # a reference of those rows that follow with this id and tag
                    source = (page, tag, digest, refers)
                    continue
                if out is not None and at != part:
                    yield close()
                    out = None
                if at != part:
                    at, seq = part, 0
                if out is None:
                    out, n = files.Output(folder, f"range-{part:06d}-{seq:06d}.warc.gz"), 0
                payload = (html or "").encode()
                known = source is not None and source[:2] == (page, tag) and source[2] == hashlib.sha256(payload).hexdigest()
                out.write(member(make_record(page, url or "", payload, source[3] if known else None)))
                n += 1
                if out.size >= roll_bytes:
                    yield close()
                    out, seq = None, seq + 1
        if out is not None:
            yield close()

    tag = F.xxhash64(F.sha2(payload, 256), F.xxhash64("url"))
    rows = pages.select("page_id", tag.alias("tag"), "url", "html", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("refers_to"))
    both = rows.unionByName(again.select("page_id", "tag", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers_to"))
    both = both.withColumn("id", held("page_id")).withColumn("part", bucket)
    ranged = both.repartitionById(n_ranges, F.col("part")).sortWithinPartitions("part", "id", "tag", F.col("refers_to").asc_nulls_last(), "url")
    manifest = scratch.table(ranged.mapInArrow(write, files.MANIFEST + ", records long"), "manifest", keep=True)
    return files.commit(scratch, manifest, folder)


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to), from the files, with every digest tested."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def read(batches):
        fs, root = files.at(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows: list[tuple] = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for data in members(f):
                        fields, http, _ = parse_record(data)
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        refers = fields.get("X-Refers-To-Key")
                        key = fields["X-Record-Key"].strip()
                        rows.append((int(key) if key else None, fields["WARC-Target-URI"], size, fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"], None if refers is None else int(refers)))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return files.spread(manifest.select("name")).mapInArrow(read, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page, from the archives."""
    with Scratch(spark) as s:
        folder = s.path("warc")
        manifest = write_archives(s, table(spark, sf_dir, "pages"), folder)
        return s.table(read_archives(manifest, folder).drop("url"), "found", keep=True)


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY sha256(h)) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM m
"""
