"""Transcripts cut into requests that fit a budget, each as long as it can be.

A request is a JSON text that holds the segments to be edited, a few neighbours to be read, the instructions, and an estimate of its own size.  So the estimate counts itself: it
is the fixed point of the size with the estimate's digits in it.  A request is the longest run of segments, found by halving, that keeps four limits: tokens going in, tokens reserved for what
comes out, segments, and characters.  It then gives back up to a fifth of its segments to end at a sentence's end or before a pause.  A segment that alone is over a limit refuses its transcript from there on.

``plan`` goes through all transcripts as a stream, with no more of one in hand than a request can hold and its neighbours.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.plans.dialect import relation

#: A sentence's end, with closing marks after it.
SENTENCE_END = re.compile(r"[.!?。！？…][\"'”’)\]」』）]*$")
#: Bytes of framing beside the request's text, and bytes of a token, at least.
FRAME, TOKEN_BYTES = 256, 3
#: Bytes reserved for the answer to a segment, beside its text.
ANSWER = 48

Segment = tuple[int, int, int, str]


@dataclass(frozen=True)
class Budget:
    max_input_tokens: int = 1500
    context_tokens: int = 4096
    max_output_tokens: int = 1600
    safety_tokens: int = 200
    max_segments: int = 40
    max_characters: int = 4000
    context_segments: int = 2
    gap_ms: int = 1200
    instructions: str = "Correct the segments."

    @property
    def input_limit(self) -> int:
        return min(self.max_input_tokens, self.context_tokens - self.max_output_tokens - self.safety_tokens)


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def segment_json(s: Segment) -> str:
    return canonical({"end_ms": s[2], "id": s[0], "start_ms": s[1], "text": s[3]})


def request(before: list[Segment], edited: list[Segment], after: list[Segment], budget: Budget, estimate: tuple[int, int]) -> str:
    """The request's text, with an estimate of (bytes, tokens) in it."""
    parts = [",".join(map(segment_json, x)) for x in (edited, [*before, *after])]
    return f'{{"budget":{canonical({"request_bytes": estimate[0], "request_tokens": estimate[1]})},"context":[{parts[1]}],"edit":[{parts[0]}],"instructions":{canonical(budget.instructions)}}}'


def settled(rest: int) -> tuple[int, int]:
    """(bytes, tokens) of a request whose other bytes are ``rest``: the digits of both are counted."""
    size = rest
    for _ in range(12):
        tokens = -(-size // TOKEN_BYTES)
        now = rest + len(str(size)) + len(str(tokens))
        if now == size:
            return size, tokens
        size = now
    raise ValueError("an estimate without a fixed point")


class Planner:
    """The requests of one transcript, whose segments are fed in order."""

    def __init__(self, budget: Budget):
        self.budget, self.n, self.refused = budget, 0, False
        self.held: deque[Segment] = deque()  # neighbours before the next request, and what follows
        self.before = 0
        self.bare = len(request([], [], [], budget, (0, 0)).encode()) - 2 + FRAME

    def feed(self, segment: Segment) -> Iterator[tuple]:
        if not self.refused:
            self.held.append(segment)
            if len(self.held) - self.before > self.budget.max_segments + self.budget.context_segments:
                yield self._next()

    def close(self) -> Iterator[tuple]:
        while not self.refused and len(self.held) > self.before:
            yield self._next()

    def _next(self) -> tuple:
        """(chunk, first, past, bytes, tokens, logical end, limits that the next segment would pass); a refusal has no bytes."""
        b, rows = self.budget, [*self.held]
        start, n = self.before, len(rows)
        sizes = [0, *accumulate(len(segment_json(s).encode()) + 1 for s in rows)]
        chars = [0, *accumulate(len(s[3]) for s in rows)]
        answers = [0, *accumulate(len(s[3].encode()) + ANSWER for s in rows)]

        def measure(end: int) -> tuple[int, int]:
            low, high = max(0, start - b.context_segments), min(n, end + b.context_segments)
            around = sizes[start] - sizes[low] + sizes[high] - sizes[end]
            return settled(self.bare + max(0, sizes[end] - sizes[start] - 1) + max(0, around - 1))

        def passed(end: int) -> list[str]:
            found = (("input_tokens", measure(end)[1], b.input_limit), ("output_tokens", -(-(answers[end] - answers[start]) // TOKEN_BYTES), b.max_output_tokens), ("segments", end - start, b.max_segments), ("characters", chars[end] - chars[start], b.max_characters))
            return [name for name, value, most in found if value > most]

        low, high, chosen = start + 1, min(n, start + b.max_segments), None
        while low <= high:
            mid = (low + high) // 2
            if passed(mid):
                high = mid - 1
            else:
                chosen, low = mid, mid + 1
        if chosen is None:
            self.refused = True
            return self.n, rows[start][0], None, None, None, False, passed(start + 1)
        limits, logical = passed(chosen + 1) if chosen < n else [], False
        if chosen < n:
            for end in range(chosen, start + max(1, -(-(chosen - start) * 4 // 5)) - 1, -1):
                if SENTENCE_END.search(rows[end - 1][3].rstrip()) or rows[end][1] - rows[end - 1][2] >= b.gap_ms:
                    chosen, logical = end, True
                    break
        out = self.n, rows[start][0], rows[chosen - 1][0], *measure(chosen), logical, limits
        self.n += 1
        keep = max(0, chosen - b.context_segments)
        for _ in range(keep):
            self.held.popleft()
        self.before = chosen - keep
        return out


CHUNKS = "transcript_id long, chunk long, first long, last long, request_bytes long, request_tokens long, logical boolean, limits string"


def plan(segments: DataFrame, budget: Budget) -> DataFrame:
    """The requests of each transcript of (transcript_id, ordinal, start_ms, end_ms, text); a refused segment has a row without a last segment."""
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    types = [pa.int64()] * 6 + [pa.bool_(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, planner = None, None
        for batch in batches:
            out = []
            for transcript, *segment in zip(*(batch.column(c).to_pylist() for c in ("transcript_id", "ordinal", "start_ms", "end_ms", "text")), strict=True):
                if planner is None or transcript != key:
                    if planner is not None:
                        out += [(key, *c) for c in planner.close()]
                    key, planner = transcript, Planner(budget)
                out += [(key, *c) for c in planner.feed((*segment[:3], segment[3] or ""))]
            if out:
                yield batch_of(out)
        if planner is not None and (out := [(key, *c) for c in planner.close()]):
            yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        rows = [(*r[:-1], ",".join(r[-1])) for r in rows]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    ordered = segments.select("transcript_id", "ordinal", "start_ms", "end_ms", "text").repartition("transcript_id").sortWithinPartitions("transcript_id", "ordinal")
    return ordered.mapInArrow(read, CHUNKS)


def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-18."""
    return plan(relation(spark, sf_dir, "segments"), Budget())


QUERIES = {"T-18_chunk_plan": chunk_plan}
ORACLES: dict[str, str] = {}
