"""Rules that are truly sequential, as plain functions, and their Spark forms.

Each function works on one transcript or one pair of texts, so the Spark forms are Arrow maps or groups by that
key; nothing here needs rows of two keys together.
"""

from __future__ import annotations

import difflib
import hashlib
import json
import math
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.dialect import relation

SENTENCE_ENDS = ".!?。！？…"
CLOSING = "\"')]}»”’」』）"


def normal_text(text: str) -> str:
    """Lower case without white space, punctuation and symbols."""
    return "".join(c for c in text.lower() if not c.isspace() and unicodedata.category(c)[0] not in "PS")


def sequence_ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def band(ratio: float) -> str:
    return "agree" if ratio >= 0.85 else "minor" if ratio >= 0.75 else "review"


def agreement(a: str, b: str, exact_up_to: int = 20_000, windows: int = 10, size: int = 2000) -> tuple[float, str]:
    """The ratio of two texts, exact or, where either is long, the mean over evenly spaced windows scaled by the lengths."""
    a, b = normal_text(a), normal_text(b)
    if not a or not b:
        return (1.0 if a == b else 0.0), "exact"
    if max(len(a), len(b)) <= exact_up_to:
        return sequence_ratio(a, b), "exact"
    short, long_ = sorted((a, b), key=len)
    n = max(1, min(windows, math.ceil(len(short) / size)))
    total = 0.0
    for k in range(n):
        share = k / (n - 1) if n > 1 else 0.0
        i, j = int(share * max(0, len(short) - size)), int(share * max(0, len(long_) - size))
        total += sequence_ratio(short[i : i + size], long_[j : j + size])
    return total / n * 2 * len(short) / (len(short) + len(long_)), "windowed"


#: Half the width of the band of the table of edits that is tried for texts over so many characters.
BAND, LONG = 64, 20_000


def error_counts(reference: str, heard: str, band: int = BAND) -> tuple[int, int, int]:
    """Substitutions, deletions and insertions of a least edit; ties prefer substitutions, then deletions.

    Of long texts a band of the table is tried first: where the edit fits it, whatever is tied with a least edit lies in the band as well, so long texts that are alike cost
    their length.  Otherwise the whole table is made as differences of neighbours, a column of it in the bits of a few integers.
    """
    if min(len(reference), len(heard)) > LONG and abs(len(reference) - len(heard)) <= band:
        a, b = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (reference, heard))
        total, deleted, inserted = _banded(a, b, band)
        if total <= band:
            return total - deleted - inserted, deleted, inserted
    return _by_bits(reference, heard)


def _by_bits(reference: str, heard: str) -> tuple[int, int, int]:
    """The counts by Myers' columns of bits and the way back through them.

    The longer text stands along the bits.  Columns are kept at the starts of blocks, and a block's columns are made again when the way back comes to it, so memory is that
    of some square root of their number.
    """
    turned = len(reference) < len(heard)
    down, along = (heard, reference) if turned else (reference, heard)
    places: dict[str, int] = {}
    for k, c in enumerate(down):
        places[c] = places.get(c, 0) | 1 << k
    mask = (1 << len(down)) - 1

    def columns(start: tuple[int, int], text: str):
        """(level, kept, up, less) for each character: where the step along the diagonal costs nothing, where a deletion may end, and where a column grows and falls."""
        up, less = start
        for c in text:
            equal = places.get(c, 0)
            level = ((((equal & up) + up) ^ up) | equal | less) & mask
            grown = less | mask & ~(level | up)
            fallen = up & level
            shifted = grown << 1 | 1
            up, less = (fallen << 1 | ~(level | shifted)) & mask, shifted & level & mask
            yield level, grown if turned else up, up, less

    size = max(1, math.isqrt(len(along)))
    starts = [(mask, 0)]
    for k, (_, _, up, less) in enumerate(columns(starts[0], along[: (len(along) - 1) // size * size]), 1):
        if k % size == 0:
            starts.append((up, less))
    i, counts = len(down), [0, 0, 0]
    for block in range(len(starts) - 1, -1, -1):
        if not along:
            break
        text = along[block * size : (block + 1) * size]
        made = [(level, kept) for level, kept, _, _ in columns(starts[block], text)]
        j = len(text)
        while j and i:
            if down[i - 1] == text[j - 1]:
                i, j = i - 1, j - 1
                continue
            level, kept = made[j - 1]
            if not level >> i - 1 & 1:
                counts[0] += 1
                i, j = i - 1, j - 1
            elif bool(kept >> i - 1 & 1) == turned:
                counts[1 if turned else 2] += 1
                j -= 1
            else:
                counts[2 if turned else 1] += 1
                i -= 1
        if not i:
            left = block * size + j
            counts[1 if turned else 2] += left
            return tuple(counts)
    counts[2 if turned else 1] += i
    return tuple(counts)


def _banded(a: np.ndarray, b: np.ndarray, band: int) -> tuple[int, int, int]:
    """(edits, deletions, insertions) by the cells of the table that are at most ``band`` off its diagonal."""
    far = len(a) + len(b) + 1
    at = np.arange(min(len(b), band) + 1)
    cost, deleted, inserted, low = at.copy(), np.zeros(len(at), np.int64), at.copy(), 0
    for i, r in enumerate(a, 1):
        first, last = max(0, i - band), min(len(b), i + band)
        # Steps from the row above, without insertions: along the diagonal unless a deletion costs less.
        best, x, y = np.full(last - first + 1, far), np.zeros(last - first + 1, np.int64), np.zeros(last - first + 1, np.int64)
        n, skip = min(last, low + len(cost) - 1) - first + 1, first - low
        best[:n], x[:n], y[:n] = cost[skip : skip + n] + 1, deleted[skip : skip + n] + 1, inserted[skip : skip + n]
        head = max(first, low + 1)  # the first column with a cell to its upper left
        come = slice(head - 1 - low, last - low)
        diagonal = cost[come] + (b[head - 1 : last] != r)
        into = slice(head - first, head - first + len(diagonal))
        ok = diagonal <= best[into]
        best[into][ok], x[into][ok], y[into][ok] = diagonal[ok], deleted[come][ok], inserted[come][ok]
        # Insertions run on from the last place where they do not cost less.
        at = np.arange(len(best))
        cost = np.minimum.accumulate(best - at) + at
        start = np.maximum.accumulate(np.where(best == cost, at, 0))
        deleted, inserted, low = x[start], y[start] + at - start, first
    return int(cost[-1]), int(deleted[-1]), int(inserted[-1])


def shape_cues(units: list[tuple[int, int, str]], most: int = 60, pause_ms: int = 1000, least: int = 6, least_ms: int = 1000) -> list[tuple[int, int, str]]:
    """Cues from timed units (start, end, text): a cue ends at a sentence end, at ``most`` characters, or, once formed, at a pause."""
    cues: list[list] = []
    for start, end, text in units:
        if not text:
            continue
        now = cues[-1] if cues else None
        if now is not None and not now[3] and all(c in CLOSING for c in text):
            now[3] = True
        if now is None or now[3]:
            if now is not None and all(c in CLOSING for c in text):  # closing marks belong to the cue before
                now[1], now[2] = max(now[1], end), now[2] + text
                continue
            cues.append([start, end, text, False])
            now = cues[-1]
        else:
            formed = len(now[2]) >= least and now[1] - now[0] >= least_ms
            if len(now[2]) + len(text) > most or (formed and start - now[1] >= pause_ms):
                cues.append([start, end, text, False])
                now = cues[-1]
            else:
                joint = " " if now[2][-1].isascii() and text[0].isascii() and now[2][-1].isalnum() and text[0].isalnum() else ""
                now[1], now[2] = max(now[1], end), now[2] + joint + text
        if now[2][-1] in SENTENCE_ENDS:
            now[3] = True
    return [(a, b, t) for a, b, t, _ in cues]


class Packer:
    """Puts sizes into batches in order: one that would pass a cap opens the next; an oversize one is alone."""

    def __init__(self, bytes_most: int, objects_most: int):
        self.bytes_most, self.objects_most = bytes_most, objects_most
        self.batch = self.held = self.n = 0

    def put(self, size: int) -> int:
        if self.n and (self.held + size > self.bytes_most or self.n >= self.objects_most):
            self.batch, self.held, self.n = self.batch + 1, 0, 0
        self.held, self.n = self.held + size, self.n + 1
        return self.batch


def pack_batches(sizes: list[int], bytes_most: int, objects_most: int) -> list[int]:
    """The batch of each object, in order."""
    packer = Packer(bytes_most, objects_most)
    return [packer.put(size) for size in sizes]


def merge_marked(rows: list[tuple[int, str, str, str, str]]) -> list[tuple[int, str]]:
    """Texts by a reviewer's marks: (number, mark, caption, heard, own); numbers must run from 1."""
    if [r[0] for r in rows] != list(range(1, len(rows) + 1)):
        raise ValueError("numbers do not run from 1")
    choose = {"keep": lambda c, h, o: c or h, "use-sub": lambda c, h, o: c, "use-asr": lambda c, h, o: h, "custom": lambda c, h, o: o}
    return [(n, choose[mark](c, h, o)) for n, mark, c, h, o in rows]


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


#: Keys that are not exported, by name, by ending, by beginning, and by what they hold.
SENSITIVE_KEYS = frozenset(
    """sessdata cookie cookies url signed_url stream_url audio_url video_url cover_url api_url raw_url play_url custom_url traceback exception error_trace stack_trace
    token access_token secret password authorization auth""".split()
)
SENSITIVE_ENDS, SENSITIVE_STARTS, SENSITIVE_PARTS = ("_url", "_cookie", "_token", "_secret", "_trace", "_exception", "url"), ("cookie", "token", "sessdata", "secret", "auth"), ("sessdata", "traceback")
#: What is not shown inside texts.
CREDENTIALS = re.compile(r"(?i)(?:sessdata|access[_-]?token|authorization|cookie|token|signature|sign|deadline)\s*(?:=|:)\s*[^\s,;]+")
SIGNED_URLS = re.compile(r"(?i)https?://[^\s\"\']+(?:sign|deadline|token|auth)[^\s\"\']*")
TRACEBACKS = re.compile(r"(?is)Traceback \(most recent call last\):.*")


def sensitive(key: str) -> bool:
    key = key.lower().strip()
    return key in SENSITIVE_KEYS or key.endswith(SENSITIVE_ENDS) or key.startswith(SENSITIVE_STARTS) or any(p in key for p in SENSITIVE_PARTS)


def sanitized(value):
    """A nested value without sensitive keys at any depth; texts that are links go, and credentials, signed links and tracebacks inside texts."""
    if isinstance(value, dict):
        return {k: sanitized(v) for k, v in value.items() if not sensitive(str(k))}
    if isinstance(value, list):
        return [sanitized(v) for v in value]
    if not isinstance(value, str):
        return value
    if value.startswith(("http://", "https://")):
        return "[redacted]"
    for pattern in (CREDENTIALS, SIGNED_URLS, TRACEBACKS):
        value = pattern.sub("[redacted]", value)
    return value


def published_blocks(markdown: str) -> list[tuple[int, str]]:
    """(seconds, text) of blocks headed by HH:MM:SS; front matter is skipped and fenced text taken as it is."""
    lines, out, fenced = markdown.split("\n"), [], False
    if lines and lines[0].strip() == "---":
        end = next((k for k, x in enumerate(lines[1:], 1) if x.strip() == "---"), len(lines) - 1)
        lines = lines[end + 1 :]
    for line in lines:
        stamp = line.strip().split(":")
        if line.startswith("```"):
            fenced = not fenced
        elif not fenced and len(stamp) == 3 and all(len(x) == 2 and x.isdigit() for x in stamp):
            out.append([int(stamp[0]) * 3600 + int(stamp[1]) * 60 + int(stamp[2]), []])
        elif out and line.strip():
            out[-1][1].append(line.strip())
    return [(s, " ".join(t)) for s, t in out]


# ---- Spark forms


def per_key(df: DataFrame, key: str, function, schema: str) -> DataFrame:
    """``function`` on the rows of each key, as tuples of the other columns by ordinal; it gives tuples of the other columns of ``schema``.

    Partitions are sorted by key and gone through as a stream, many keys a batch; one key's rows, a transcript's, are in hand at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    columns = [c for c in df.columns if c != key]

    def read(batches):
        at, held, out = None, [], []

        def done():
            out.extend((at, *row) for row in function(held))

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        for b in batches:
            for k, *row in zip(*(b.column(c).to_pylist() for c in (key, *columns)), strict=True):
                if held and k != at:
                    done()
                    held.clear()
                at = k
                held.append(tuple(row))
            if out:
                yield batch()
                out.clear()
        if held:
            done()
        if out:
            yield batch()

    return df.repartition(key).sortWithinPartitions(key, "ordinal").mapInArrow(read, schema)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "segments").select("transcript_id", "ordinal", "start_ms", "end_ms", "text")


def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-10."""

    def shape(rows: list[tuple]) -> list[tuple]:
        return [(k, *cue) for k, cue in enumerate(shape_cues([(a, b, w) for _, a, b, t in rows for w in t.split()]))]

    return per_key(_segments(spark, sf_dir), "transcript_id", shape, "transcript_id long, cue long, start_ms long, end_ms long, text string")


#: Bytes and objects of a batch.
BATCH_BYTES, BATCH_OBJECTS = 20_000, 16


def batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-08: replicas of each target in batches, as a stream that holds the open batch's sums of one target."""

    def pack(frames):
        target, packer = None, Packer(BATCH_BYTES, BATCH_OBJECTS)
        for df in frames:
            batches = []
            for key, size in zip(df.target_id, df.byte_size, strict=True):
                if key != target:
                    target, packer = key, Packer(BATCH_BYTES, BATCH_OBJECTS)
                batches.append(packer.put(size))
            yield pd.DataFrame({"target_id": df.target_id, "object_id": df.object_id, "batch": batches})

    replicas = relation(spark, sf_dir, "replicas").select("target_id", "object_id", "byte_size")
    return replicas.repartition("target_id").sortWithinPartitions("target_id", "object_id").mapInPandas(pack, "target_id long, object_id long, batch long")


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = relation(spark, sf_dir, "turns").select("conv_id", "turn", "text")
    nexts = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other"))
    return turns.join(nexts, ["conv_id", "turn"])


def agreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-07 and T-08: the ratio of each turn to the next one, and its band."""

    def compare(batches):
        for df in batches:
            got = [agreement(a, b) for a, b in zip(df.text, df.other, strict=True)]
            yield pd.DataFrame({"conv_id": df.conv_id, "turn": df.turn, "ratio": [g[0] for g in got], "method": [g[1] for g in got], "band": [band(g[0]) for g in got]})

    return _compared(spark, sf_dir).mapInPandas(compare, "conv_id long, turn long, ratio double, method string, band string")


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-22: the three counts by a table of edits; pairs are dealt out, since they are few MB and much work."""

    def count(batches):
        for df in batches:
            got = [error_counts(a, b) for a, b in zip(df.text, df.other, strict=True)]
            yield pd.DataFrame({"conv_id": df.conv_id, "turn": df.turn, "substitutions": [g[0] for g in got], "deletions": [g[1] for g in got], "insertions": [g[2] for g in got]})

    return _compared(spark, sf_dir).repartition("conv_id", "turn").mapInPandas(count, "conv_id long, turn long, substitutions long, deletions long, insertions long")


def error_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-22, the total alone, in the JVM, over whole texts."""
    return _compared(spark, sf_dir).select("conv_id", "turn", F.levenshtein("text", "other").cast("long").alias("edits"))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-28: each turn as the caption, and the next one as what was heard."""
    marks = ["keep", "use-sub", "use-asr", "custom"]

    def merge(rows: list[tuple]) -> list[tuple]:
        texts = [t for _, t in rows]
        return merge_marked([(k + 1, marks[k % 4], t, h, f"own {k}") for k, (t, h) in enumerate(zip(texts, [*texts[1:], ""], strict=True))])

    turns = relation(spark, sf_dir, "turns").select("conv_id", F.col("turn").alias("ordinal"), "text")
    return per_key(turns, "conv_id", merge, "conv_id long, number long, text string")


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-23 and X-04: properties without sensitive keys, in canonical form, and their identity."""

    def form(batches):
        for df in batches:
            made = [canonical_json(sanitized(json.loads(p or "{}") | {"api_token": "x"})) for p in df.props]
            yield pd.DataFrame({"event_id": df.event_id, "canonical": made, "identity": [hashlib.sha256(m.encode()).hexdigest() for m in made]})

    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props").mapInPandas(form, "event_id long, canonical string, identity string")


def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-12: transcripts published as markdown, and read back."""

    def read(rows: list[tuple]) -> list[tuple]:
        heads = [f"{max(0, a) // 3600000:02d}:{max(0, a) // 60000 % 60:02d}:{max(0, a) // 1000 % 60:02d}\n{t}\n" for _, a, _, t in rows]
        blocks = published_blocks("---\ntitle: x\n---\n" + "\n".join(heads))
        return [(k, second, len(text)) for k, (second, text) in enumerate(blocks)]

    return per_key(_segments(spark, sf_dir), "transcript_id", read, "transcript_id long, block long, second long, chars long")


def sanitised_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-04: events as nested documents, without sensitive keys and texts at any depth."""

    def form(batches):
        for df in batches:
            yield pd.DataFrame({"event_id": df.event_id, "exported": [canonical_json(sanitized(json.loads(d))) for d in df.document]})

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    inner = F.struct(k.alias("k"), F.lit("x").alias("Api_Token"), F.array(F.struct(F.lit("https://example.org/a").alias("link"), F.lit("y").alias("cover_url"), F.concat(F.lit("kept; cookie: abc, "), k.cast("string")).alias("said"))).alias("items"))
    document = F.to_json(F.struct("event_id", F.col("event_type").alias("kind"), inner.alias("payload"), F.lit("z").alias("session_trace"), F.lit("w").alias("Authorization2")))
    return events.select("event_id", document.alias("document")).mapInPandas(form, "event_id long, exported string")


QUERIES = {
    "T-07_agreement": agreements,
    "T-08_bands": lambda spark, d: agreements(spark, d).groupBy("band").count(),
    "T-10_shaped_cues": shaped,
    "L-08_batches": batched,
    "T-22_error_counts": errors,
    "T-22_error_totals": error_totals,
    "T-23_canonical_identity": canonical,
    "T-28_marked_merge": merged,
    "S-12_markdown_blocks": markdown_blocks,
    "X-04_sanitised_events": sanitised_events,
}
ORACLES = {
    "X-04_sanitised_events": """SELECT event_id, concat('{"event_id":', event_id, ',"kind":"', event_type, '","payload":{"items":[{"link":"[redacted]","said":"kept; [redacted], ', JSON_TEXT[props; k], '"}],"k":', JSON_TEXT[props; k], '}}') AS exported FROM events""",
    "L-08_batches": f"""WITH RECURSIVE numbered AS (SELECT target_id, object_id, byte_size, row_number() OVER (PARTITION BY target_id ORDER BY object_id) AS k FROM replicas),
        walk AS (SELECT target_id, object_id, k, 0::bigint AS batch, byte_size AS held, 1::bigint AS n FROM numbered WHERE k = 1
        UNION ALL SELECT x.target_id, x.object_id, x.k, CASE WHEN w.held + x.byte_size > {BATCH_BYTES} OR w.n >= {BATCH_OBJECTS} THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.held + x.byte_size > {BATCH_BYTES} OR w.n >= {BATCH_OBJECTS} THEN x.byte_size ELSE w.held + x.byte_size END,
        CASE WHEN w.held + x.byte_size > {BATCH_BYTES} OR w.n >= {BATCH_OBJECTS} THEN 1 ELSE w.n + 1 END FROM walk AS w JOIN numbered AS x ON x.target_id = w.target_id AND x.k = w.k + 1) SELECT target_id, object_id, batch FROM walk""",
    "T-23_canonical_identity": "SELECT event_id, concat('{\"k\":', JSON_TEXT[props; k], '}') AS canonical, SHA[concat('{\"k\":', JSON_TEXT[props; k], '}')] AS identity FROM events",
}
