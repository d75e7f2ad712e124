"""N-gram Jaccard self-join that skips by set relations: classes of linked documents, and each document's number of links.

Sets are ordered with rare shingles first, by classes of a count sketch of all shingles, and each shingle of a
set's prefix puts the set into that shingle's index list.  Work is skipped in two places:

* In a list: entries are ordered by set size and position, and cut into blocks of ``BLOCK`` entries with their
  sizes' bounds and least position.  Two blocks are passed over at once where no sizes and positions in them allow the
  overlap that is asked for; in the others single pairs are tested likewise, and then by counts by hash (``BINS``), which
  bound the symmetric difference from below; larger sets have more of them, as a fixed number would let all pass.
* Between answers: sets that pass these tests form families.  Of a family only one set, the base, is compared with the
  others as a whole, which gives each of them its differences from the base.  The answers of every other set are derived from the base's
  by the differences alone: the symmetric difference of two sets is that of their differences, so a pair is settled by
  the differences' sizes where these suffice, and by what the differences have in common where they don't.

A pair of two families that passes a list's tests makes the set of the smaller family a guest of the larger one, where it is
compared with all members in the same way.  So every pair that can be linked is compared exactly once, but no pairs are
written or shuffled: a task returns how many links each set has, and a spanning forest of them.

A list of more than ``LIMIT`` entries is split: first into shards, whose sets find families within them; what is still in several families
is compared shard by shard, in one task for each pair of shards.  A family of more than ``TOGETHER`` sets is split into its near sets,
whose differences from the base are so few that any two of them are linked whatever these are, and its far sets: the links among near
sets follow from one sum, and only far sets are compared with other sets, part by part.  The sketch
has a fixed size, and tells from the mean count of its cells; it orders shingles and sets the number of shards, and the result is
the same with any counts in it.

Exact copies are one set throughout, which counts as often as it occurs.  Sets are named by 128 bits of hashes of all their shingles;
lists name them by 64 of these, and sets that share those are all taken.  Shingles are compared by 64-bit hashes.

Defined cases: null, empty and wordless texts have no set and are linked with nothing; an empty table gives no rows;
repeated rows are copies, linked with each other; a null id stays null, and its class is the smallest id that is not null, if any; rows of one id
with several texts are documents of their own; a text of any length is one set; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .scratch import NO_ID, Scratch, given, held, table, unused
from .shingles import mix, shingle_sets

#: Words of a shingle, and the least Jaccard similarity of a link as a fraction.
WIDTH, NUM, DEN = 3, 9, 10
#: The same for the pipeline's stage, on whose shingles the contract of the query does not bear.
STAGE_WIDTH, STAGE_NUM, STAGE_DEN = 5, 4, 5
#: Counters of the sketch, the blocks they are summed in, and how many tasks' blocks are summed at once.
COUNTERS, BLOCKS, FAN_IN = 1 << 22, 64, 64
#: Counts by hash that each set carries, of four bits each: so many up to that size of a set, and the last for larger ones.
BINS = ((64, 512), (256, 4096), (1024, None))
#: Lists up to this length are handled many at a time.
SHORT = 64
#: Entries of a block of a list, and of a shard of a long list.
BLOCK, LIMIT = 64, 256
#: Sets of a family that are compared in one task.
TOGETHER = 512
#: Columns of the tables of differences that are multiplied at once.
COLUMNS = 8192


def key_of(s: np.ndarray) -> tuple[int, int]:
    """A set's name: hashes of the sums of its scrambled shingles, in any order."""
    a, b = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), mix(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    both = mix(np.array([b]) + np.uint64(len(s)))
    return int(mix(both + a)[0].astype(np.int64)), int(mix(both ^ mix(np.array([a])))[0].astype(np.int64))


def bins_of(s: np.ndarray) -> np.ndarray:
    """Counts modulo 16 by the first bits of the hashes, two a byte."""
    width = next(w for w, most in BINS if most is None or len(s) <= most)
    place = s >> np.uint64(65 - width.bit_length())
    counts = (np.bincount(place.astype(np.int64), minlength=width) & 15).astype(np.uint8)
    return counts[::2] | counts[1::2] << 4


class Counts:
    """Counts by hash of many sets, at each width that a set has."""

    def __init__(self, packed: list[bytes]):
        width = 2 * np.array([len(p) for p in packed], np.int64)
        self.tables, finer = [], None
        for w, _ in BINS[::-1]:
            rows, own = np.flatnonzero(width >= w), np.flatnonzero(width == w)
            place = np.full(len(width), -1)
            place[rows] = np.arange(len(rows))
            table = np.zeros((len(rows), w), np.uint8)
            both = np.frombuffer(b"".join(packed[k] for k in own), np.uint8).reshape(-1, w // 2)
            table[place[own]] = np.stack([both & 15, both >> 4], -1).reshape(-1, w)
            if finer is not None:  # sums modulo 16 of what the finer table tells apart
                table[place[finer[0]]] = finer[1].reshape(len(finer[0]), w, finer[1].shape[1] // w).sum(-1, dtype=np.uint8) & 15
            finer = (rows, table)
            self.tables.insert(0, (place, table))

    def near(self, x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, num: int, den: int) -> np.ndarray:
        """Whether the counts of the sets x and y allow the least overlap, at the widths that both have."""
        ok = np.ones(len(x), bool)
        for place, table in self.tables:
            step = max((1 << 23) // table.shape[1], 1)
            open_ = np.flatnonzero(ok & (place[x] >= 0) & (place[y] >= 0))
            for k in range(0, len(open_), step):
                at = open_[k : k + step]
                ok[at] = _near(table[place[x[at]]], table[place[y[at]]], nx[at], ny[at], num, den)
        return ok


# ---- Sets and the sketch


_FACTS = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("tag2", pa.int64()), ("n", pa.int32()), ("ka", pa.int64()), ("kb", pa.int64()), ("bins", pa.binary()), ("block", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])


def _facts(width: int):
    def facts(batches):
        counts, seen = np.zeros(COUNTERS, np.uint32), set()
        for batch in batches:
            n, ka, kb, bins = [], [], [], []
            for s in shingle_sets(batch.column("text").to_pylist(), width):
                a, b = key_of(s) if len(s) else (None, None)
                if a is not None and a not in seen:  # copies in one task count once
                    seen.add(a)
                    np.add.at(counts, (s & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
                n.append(len(s))
                ka.append(a)
                kb.append(b)
                bins.append(bins_of(s).tobytes() if len(s) else None)
            own = [pa.array(x, t) for x, t in ((n, pa.int32()), (ka, pa.int64()), (kb, pa.int64()), (bins, pa.binary()))]
            none = [pa.nulls(len(n), t) for t in (pa.int32(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "tag", "tag2")] + own + none, schema=_FACTS)
        part, each = TaskContext.get().partitionId(), COUNTERS // BLOCKS
        if counts.any():
            for k in range(BLOCKS):
                last = [pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([counts[k * each : (k + 1) * each].tobytes()])]
                yield pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in list(_FACTS)[:7]] + last, schema=_FACTS)

    return facts, "doc_id long, tag long, tag2 long, n int, ka long, kb long, bins binary, block int, part int, counts binary"


def _counts(x: pa.Scalar) -> np.ndarray:
    """A block's counts, of four bytes as a task makes them, or of eight once they are summed."""
    data = x.as_py()
    return np.frombuffer(data, np.uint32 if len(data) == 4 * COUNTERS // BLOCKS else np.uint64)


def _sum_counts(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    total = sum((_counts(x).astype(np.uint64) for x in rows.column("counts")), np.zeros(COUNTERS // BLOCKS, np.uint64))
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def _sketch(s: Scratch, facts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of each counter the class by which shingles are ordered, and the power of two of its list's shards.

    The tasks' counts are summed ``FAN_IN`` at a time, so no task holds more than that many blocks; the driver gets two bytes a counter.
    """
    rows, level = facts.where("block IS NOT NULL").select("block", "part", "counts"), 0
    while (rows.agg(F.max("part")).first()[0] or 0) > 0:
        level += 1
        up = rows.select("block", F.floor(F.col("part") / FAN_IN).cast("int").alias("up"), "counts")
        rows = s.table(up.groupBy("block", "up").applyInArrow(_sum_counts, "block int, part int, counts binary"), f"sketch_{level}")

    def total(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([int(_counts(x).sum(dtype=np.uint64)) for x in batch.column("counts")], pa.int64())})

    mean = (rows.select("counts").mapInArrow(total, "n long").agg(F.sum("n")).first()[0] or 0) / COUNTERS

    def narrow(batches):
        for batch in batches:
            out = []
            for x in batch.column("counts"):
                c = _counts(x).astype(float)
                shards = np.maximum(c - mean - 4 * np.sqrt(mean), 1) / LIMIT
                out.append(np.stack([np.ceil(np.log2(np.maximum(c - mean, 0) + 1)), np.ceil(np.log2(np.maximum(shards, 1)))]).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(out, pa.binary())], names=["block", "both"])

    both, each = np.zeros((2, COUNTERS), np.uint8), COUNTERS // BLOCKS
    for r in rows.select("block", "counts").mapInArrow(narrow, "block int, both binary").collect():
        both[:, r["block"] * each : (r["block"] + 1) * each] = np.frombuffer(r["both"], np.uint8).reshape(2, -1)
    return both[0], both[1]


# ---- Index lists


def prefix_size(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


_ENTRIES = "token long, shard int, ka long, n int, pos int"


def _entries(classes: np.ndarray, shards: np.ndarray, width: int, num: int, den: int):
    """(token, shard, ka, n, pos) of each set's prefix, once per set and task; the shard is -1 for a list that isn't split."""

    def entries(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            tokens, keys, sizes, counts = [], [], [], []
            for s in shingle_sets(batch.column("text").to_pylist(), width):
                if not len(s) or (key := key_of(s)) in seen:
                    continue
                seen.add(key)
                rank = classes[(s & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(58) | s >> np.uint64(6)
                p = prefix_size(len(s), num, den)
                tokens.append(s[np.argsort(rank, kind="stable")[:p]])
                keys.append(key[0])
                sizes.append(len(s))
                counts.append(p)
            if keys:
                counts, token = np.array(counts), np.concatenate(tokens)
                key = np.repeat(np.array(keys, np.int64), counts)
                split = shards[(token & np.uint64(COUNTERS - 1)).astype(np.int64)]
                place = mix(key.view(np.uint64) ^ token) & ((np.uint64(1) << split.astype(np.uint64)) - np.uint64(1))
                shard = np.where(split > 0, place.astype(np.int64), -1).astype(np.int32)
                pos = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(shard), pa.array(key), pa.array(np.repeat(np.array(sizes, np.int32), counts)), pa.array(pos)], names=["token", "shard", "ka", "n", "pos"])

    return entries


def _whole_lists(batches):
    """Tables of whole lists from batches that are sorted by token and shard."""
    held_back: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        token, shard = batch.column("token").to_numpy(), batch.column("shard").to_numpy()
        cut = batch.num_rows - int(((token == token[-1]) & (shard == shard[-1])).sum())
        if cut == 0 and held_back and (held_back[-1].column("token")[-1].as_py(), held_back[-1].column("shard")[-1].as_py()) == (token[0], shard[0]):
            held_back.append(batch)
            continue
        held_back.append(batch.slice(0, cut))
        yield pa.Table.from_batches(held_back)
        held_back = [batch.slice(cut)]
    if held_back:
        yield pa.Table.from_batches(held_back)


def _bounds(token: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where lists start, and their lengths."""
    starts = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (shard[1:] != shard[:-1])))
    return starts, np.diff(np.append(starts, len(token)))


def _allowed(nx, px, ny, py, num: int, den: int):
    """Whether sizes and positions of a common shingle allow the least overlap; nx >= ny."""
    least = -(-num * (nx + ny) // (num + den))
    return (den * ny >= num * nx) & (px <= nx - least) & (py <= ny - least)


def _near(a: np.ndarray, b: np.ndarray, nx, ny, num: int, den: int):
    """Whether the counts by hash allow the least overlap: each bin's difference is part of the symmetric difference."""
    d = (a - b) & 15
    apart = np.minimum(d, 16 - d).sum(-1, dtype=np.int64)
    return apart <= nx + ny - 2 * -(-num * (nx + ny) // (num + den))


def _survivors(num: int, den: int):
    """List entries that have a partner by size and position, or may have one in another shard."""

    def survivors(batches):
        for t in _whole_lists(batches):
            token, shard, key, n, pos = (t.column(c).to_numpy() for c in ("token", "shard", "ka", "n", "pos"))
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1]) | (n[1:] != n[:-1]) | (pos[1:] != pos[:-1])
            token, shard, key, n, pos = token[fresh], shard[fresh], key[fresh], n[fresh], pos[fresh]
            _, size = _bounds(token, shard)
            alive = np.repeat(size > SHORT, size) | (shard >= 0)  # long lists are thinned in the rounds
            at = np.flatnonzero(np.repeat((size > 1) & (size <= SHORT), size) & ~alive)
            for lag in range(1, SHORT):
                at = at[at + lag < len(token)]
                at = at[(token[at] == token[at + lag]) & (shard[at] == shard[at + lag])]
                if not len(at):
                    break
                ok = at[_allowed(n[at + lag], pos[at + lag], n[at], pos[at], num, den)]
                alive[ok] = alive[ok + lag] = True
            if alive.any():
                yield pa.RecordBatch.from_arrays([pa.array(token[alive]), pa.array(key[alive]), pa.array(n[alive].astype(np.int32)), pa.array(pos[alive].astype(np.int32))], names=["token", "ka", "n", "pos"])

    return survivors, "token long, ka long, n int, pos int"


class LongList:
    """One long list, its entries ordered by (n, pos), in blocks that are skipped by size and position."""

    def __init__(self, n: np.ndarray, pos: np.ndarray, bins: Counts, num: int, den: int):
        self.n, self.pos, self.bins, self.num, self.den = n, pos, bins, num, den
        first = np.arange(0, len(n), BLOCK)
        self.low, self.high = np.minimum.reduceat(n, first), np.maximum.reduceat(n, first)
        self.least_pos = np.minimum.reduceat(pos, first)
        self.visited = self.skipped = 0

    def partners(self, block: int) -> np.ndarray:
        """Blocks up to this one in which a pair with it may pass the bounds."""
        k = np.arange(block + 1)
        least = -(-self.num * (self.low[block] + self.low[k]) // (self.num + self.den))
        ok = (self.den * self.high[k] >= self.num * self.low[block]) & (self.least_pos[block] <= self.high[block] - least) & (self.least_pos[k] <= self.high[k] - least)
        self.visited += int(ok.sum())
        self.skipped += int((~ok).sum())
        return k[ok]

    def passing(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the entries i and j, j before i, that pass the bounds and the counts by hash."""
        x, y = (a.ravel() for a in np.meshgrid(i, j, indexing="ij"))
        ok = (y < x) & _allowed(self.n[x], self.pos[x], self.n[y], self.pos[y], self.num, self.den)
        x, y = x[ok], y[ok]
        ok = self.bins.near(x, y, self.n[x], self.n[y], self.num, self.den)
        return x[ok], y[ok]

    def pairs(self, label: np.ndarray | None = None):
        """Without labels, one earlier partner for each entry that has any; else the pairs of two labels."""
        for block in range(len(self.low)):
            pending = np.arange(block * BLOCK, min((block + 1) * BLOCK, len(self.n)))
            for other in self.partners(block)[::-1].tolist():
                j = np.arange(other * BLOCK, min((other + 1) * BLOCK, len(self.n)))
                if label is not None:
                    if (label[j] == label[pending[0]]).all() and (label[pending] == label[pending[0]]).all():
                        continue
                    x, y = self.passing(pending, j)
                    apart = label[x] != label[y]
                    yield x[apart], y[apart]
                    continue
                x, y = self.passing(pending, j)
                x, at = np.unique(x, return_index=True)
                yield x, y[at]
                pending = np.setdiff1d(pending, x, assume_unique=True)
                if not len(pending):
                    break


def _candidates(families: bool, num: int, den: int):
    """From lists of (token, shard, n, pos, sid, bins, label, size): pairs (a, b) of one list, or, between families, guests (a) and the families (b) they visit."""

    def candidates(batches):
        for t in _whole_lists(batches):
            token, shard, sid, n, pos, label, members = (t.column(c).to_numpy() for c in ("token", "shard", "sid", "n", "pos", "label", "size"))
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            packed_bins = t.column("bins").to_pylist()
            bins = Counts(packed_bins)
            starts, size = _bounds(token, shard)
            left, right = [], []
            at = np.flatnonzero(np.repeat((size > 1) & (size <= SHORT), size))
            taken = np.zeros(len(token), bool)
            for lag in range(1, SHORT):
                at = at[at + lag < len(token)]
                at = at[(token[at] == token[at + lag]) & (shard[at] == shard[at + lag])]
                if not len(at):
                    break
                some = at[label[at] != label[at + lag]]
                if not families:  # one earlier partner is enough
                    some = some[~taken[some + lag]]
                some = some[_allowed(n[some + lag], pos[some + lag], n[some], pos[some], num, den)]
                for k in range(0, len(some), 200_000):
                    x = some[k : k + 200_000]
                    x = x[bins.near(x + lag, x, n[x + lag], n[x], num, den)]
                    taken[x + lag] = True
                    left.append(x + lag)
                    right.append(x)
            for a, length in zip(starts[size > SHORT].tolist(), size[size > SHORT].tolist(), strict=True):
                b = slice(a, a + length)
                for x, y in LongList(n[b], pos[b], Counts(packed_bins[b]), num, den).pairs(label[b] if families else None):
                    left.append(a + x)
                    right.append(a + y)
            if not left:
                continue
            x, y = np.concatenate(left), np.concatenate(right)
            if families:  # the set of the smaller family is the guest
                swap = (members[x] > members[y]) | ((members[x] == members[y]) & (label[x] > label[y]))
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                both = np.unique(np.stack([sid[x], label[y]]), axis=1)
            else:
                both = np.unique(np.stack([np.maximum(sid[x], sid[y]), np.minimum(sid[x], sid[y])]), axis=1)
                both = both[:, both[0] != both[1]]
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    return candidates


# ---- Answers within a family


def linked(n_a: np.ndarray, diff_a: list[np.ndarray], n_b: np.ndarray, diff_b: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, int]:
    """Which sets a and b are linked, from their sizes and their differences from one base; and how many pairs needed more than the sizes."""
    size_a, size_b = (np.array([len(d) for d in x], np.int64) for x in (diff_a, diff_b))
    room = (den - num) * (n_a[:, None] + n_b[None, :])
    out = (num + den) * (size_a[:, None] + size_b[None, :]) <= room
    open_ = ~out & ((num + den) * np.abs(size_a[:, None] - size_b[None, :]) <= room)
    if not open_.any():
        return out, 0
    x, y = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
    values, place = np.unique(np.concatenate([diff_a[i] for i in x] + [diff_b[j] for j in y]), return_inverse=True)
    in_a = np.repeat(np.arange(len(x)), size_a[x])
    in_b = np.repeat(np.arange(len(y)), size_b[y])
    at_a, at_b = place[: len(in_a)], place[len(in_a) :]
    both = (np.bincount(at_a, minlength=len(values)) > 0) & (np.bincount(at_b, minlength=len(values)) > 0)
    column = np.cumsum(both) - 1
    keep_a, keep_b = both[at_a], both[at_b]
    in_a, at_a, in_b, at_b = in_a[keep_a], column[at_a[keep_a]], in_b[keep_b], column[at_b[keep_b]]
    shared = np.zeros((len(x), len(y)))
    for low in range(0, int(both.sum()), COLUMNS):
        one, two = np.zeros((len(x), COLUMNS), np.float32), np.zeros((len(y), COLUMNS), np.float32)
        p, q = (at_a >= low) & (at_a < low + COLUMNS), (at_b >= low) & (at_b < low + COLUMNS)
        one[in_a[p], at_a[p] - low] = 1
        two[in_b[q], at_b[q] - low] = 1
        shared += one @ two.T
    apart = size_a[x][:, None] + size_b[y][None, :] - 2 * shared.astype(np.int64)
    grid = np.ix_(x, y)
    out[grid] |= open_[grid] & ((num + den) * apart <= room[grid])
    return out, int(open_.sum())


def _forest(link: np.ndarray) -> np.ndarray:
    """Of each node the smallest that links reach from it; ``link`` is symmetric."""
    label = np.arange(len(link))
    while True:
        low = np.minimum(label, np.where(link, label[None, :], len(link)).min(1, initial=len(link)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _answers(sid, guest, mult, n, diffs, other, num: int, den: int) -> pa.RecordBatch:
    """Links and a spanning forest among sets with differences from one base.

    ``other``: None, or which of two blocks a set is in; then only pairs of both blocks count.  Guests are not compared with guests.
    """
    if other is None:
        link, _ = linked(n, diffs, n, diffs, num, den)
        np.fill_diagonal(link, False)
    else:
        a, b = np.flatnonzero(~other), np.flatnonzero(other)
        link = np.zeros((len(sid), len(sid)), bool)
        if len(a) and len(b):
            link[np.ix_(a, b)], _ = linked(n[a], [diffs[k] for k in a], n[b], [diffs[k] for k in b], num, den)
        link |= link.T
    link &= ~(guest[:, None] & guest[None, :])
    to = sid[_forest(link)]
    return pa.RecordBatch.from_arrays([pa.array(sid), pa.array(link @ mult), pa.array(to, mask=to == sid)], names=["sid", "links", "to"])


_ANSWERS = "sid long, links long, to long"
_COMPARED = pa.schema([("sid", pa.int64()), ("links", pa.int64()), ("to", pa.int64()), ("label", pa.int64()), ("guest", pa.bool_()), ("mult", pa.int64()), ("n", pa.int32()), ("near", pa.bool_()), ("diff", pa.binary())])


def packed(s: np.ndarray, base: np.ndarray) -> bytes:
    """A set's differences from a sorted base: how many shingles it lacks, their places in the base in four bytes each, and those it has besides."""
    lacks = np.searchsorted(base, np.setdiff1d(base, s, assume_unique=True)).astype(np.uint32)
    return np.uint32(len(lacks)).tobytes() + lacks.tobytes() + np.setdiff1d(s, base, assume_unique=True).tobytes()


def unpacked_differences(data: bytes) -> np.ndarray:
    """One number for each difference; a place in the base counts down from the largest."""
    places = int(np.frombuffer(data, np.uint32, 1)[0])
    return np.concatenate([~np.frombuffer(data, np.uint32, places, 4).astype(np.uint64), np.frombuffer(data, np.uint64, -1, 4 + 4 * places)])


def near(n: np.ndarray, differences: np.ndarray, num: int, den: int) -> np.ndarray:
    """Sets of which any two are linked: each has at most half the differences that a pair of its size may have."""
    return (num + den) * differences <= (den - num) * n


def _compare(width: int, num: int, den: int):
    """From texts sorted by (label, part, base first, sid): the answers of families of one part; of others each set's differences from the base."""

    def compare(batches):
        at, base, rows = None, None, []

        def close():
            sid, guest, mult, n, sets = (list(c) for c in zip(*rows, strict=True))
            if at[2] == 1:
                found = _answers(np.array(sid, np.int64), np.array(guest, bool), np.array(mult, np.int64), np.array(n, np.int64), sets, None, num, den)
                return pa.RecordBatch.from_arrays(found.columns + [pa.nulls(len(sid), f.type) for f in list(_COMPARED)[3:]], schema=_COMPARED)
            m = len(sid)
            sizes = [len(unpacked_differences(d)) for d in sets]
            columns = [sid, [None] * m, [None] * m, [at[0]] * m, guest, mult, n, near(np.array(n, np.int64), np.array(sizes, np.int64), num, den), sets]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _COMPARED, strict=True)], schema=_COMPARED)

        for batch in batches:
            label, part, parts, sid, guest, own, mult = (batch.column(c).to_pylist() for c in ("label", "part", "parts", "sid", "guest", "own", "mult"))
            for k, s in enumerate(shingle_sets(batch.column("text").to_pylist(), width)):
                if at != (label[k], part[k], parts[k]):
                    if rows:
                        yield close()
                    at, base, rows = (label[k], part[k], parts[k]), s, []
                if own[k] and not (rows and rows[-1][0] == sid[k]):
                    rows.append((sid[k], guest[k], mult[k], len(s), np.setxor1d(s, base, assume_unique=True) if parts[k] == 1 else packed(s, base)))
        if rows:
            yield close()

    return compare, "sid long, links long, to long, label long, guest boolean, mult long, n int, near boolean, diff binary"


def _blocks(num: int, den: int):
    """Answers between two parts of a family, or within one, from differences sorted by (label, i, j)."""

    def blocks(batches):
        at, rows = None, []

        def close():
            part, sid, guest, mult, n, diffs = (list(c) for c in zip(*rows, strict=True))
            other = None if at[1] == at[2] else np.array(part) == at[2]
            return _answers(np.array(sid, np.int64), np.array(guest, bool), np.array(mult, np.int64), np.array(n, np.int64), [unpacked_differences(d) for d in diffs], other, num, den)

        for batch in batches:
            for label, i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("label", "i", "j", "part", "sid", "guest", "mult", "n", "diff")), strict=True):
                if at != (label, i, j):
                    if rows:
                        yield close()
                    at, rows = (label, i, j), []
                rows.append(row)
        if rows:
            yield close()

    return blocks


def _answers_of_parts(s: Scratch, diffs: DataFrame, num: int, den: int) -> DataFrame:
    """(sid, links, to) in families of several parts: near sets among themselves by sums, and far sets with all by their differences."""
    many, is_near = lambda n: F.ceil(n / TOGETHER).cast("int"), F.col("near")
    sums = diffs.groupBy("label").agg(
        F.sum(F.when(is_near, F.col("mult"))).alias("all"),
        F.sum(F.when(is_near & ~F.col("guest"), F.col("mult"))).alias("own"),
        many(F.count_if(~is_near)).alias("far"),
        many(F.count_if(is_near)).alias("parts"),
    )
    sums = s.table(sums, "sums")
    # Guests are not compared with guests; every near set is linked with the base, which is near itself and no guest.
    links = F.when(F.col("guest"), F.col("own")).otherwise(F.col("all") - F.col("mult"))
    to = F.when(F.col("sid") != F.col("label"), F.col("label"))
    near_sets = diffs.where("near").select("label", "sid", "guest", "mult").join(sums, "label").select("sid", links.alias("links"), to.alias("to"))
    # Far parts come first.  A far set meets all parts, a near one only the far ones.
    rows = diffs.join(sums.where("far > 0").select("label", "far", "parts"), "label")
    mine = F.when(is_near, F.col("far") + F.pmod(F.xxhash64("sid"), F.col("parts"))).otherwise(F.pmod(F.xxhash64("sid"), F.col("far"))).cast("int")
    last = F.when(is_near, F.col("far")).otherwise(F.col("far") + F.col("parts")) - 1
    pairs = rows.withColumn("part", mine).withColumn("with", F.explode(F.sequence(F.lit(0), last)))
    pairs = pairs.select("label", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "part", "sid", "guest", "mult", "n", "diff")
    more = pairs.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "sid").mapInArrow(_blocks(num, den), _ANSWERS)
    return near_sets.unionByName(s.table(more, "answers_of_parts"))


def _family_answers(s: Scratch, rows: DataFrame, visits: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(sid, links, to) of the sets in ``visits`` (label, sid, guest, with the row that holds the set's text)."""
    sizes = visits.groupBy("label").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts"))
    sizes = s.table(sizes, "sizes")
    visits = s.table(visits.join(sizes, "label"), "visits")
    # Visits grow with the corpus, so this join is never a broadcast, however few they are.
    texts = rows.join(visits.hint("merge"), ["doc_id", "tag", "tag2"]).select("label", "sid", "guest", "mult", "again", "parts", "text")
    if visits.where("again > 1").limit(1).count():  # rows that repeat to the letter
        texts = texts.where("again = 1").unionByName(texts.where("again > 1").dropDuplicates(["label", "sid"]))
    # Of a family of several parts the base goes to every part, and counts in its own; the texts are fetched once for families of any size.
    mine = F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")
    spread = F.when(F.col("sid") == F.col("label"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(mine))
    texts = texts.withColumn("mine", mine).withColumn("part", F.explode(spread)).withColumn("own", F.col("part") == F.col("mine"))
    texts = texts.select("label", "part", "parts", "sid", "guest", "own", "mult", "text")
    function, schema = _compare(width, num, den)
    texts = texts.repartition("label", "part").sortWithinPartitions("label", "part", F.col("sid") != F.col("label"), "sid")
    compared = s.table(texts.mapInArrow(function, schema), "compared")
    out = compared.where("diff IS NULL").select("sid", "links", "to")
    if sizes.where("parts > 1").limit(1).count():
        out = out.unionByName(_answers_of_parts(s, compared.where("diff IS NOT NULL").drop("links", "to"), num, den))
    return out


def similarity_classes(s: Scratch, docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, tag, tag2, n, label, component, links) of each (doc_id, text).

    ``tag``, ``tag2`` are hashes of the text; ``label`` names the class (null without a set), ``component`` is the class's smallest id.
    """
    rows = docs.select(held("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tag", F.xxhash64("text")).withColumn("tag2", F.xxhash64(F.lit(7), "text"))
    function, schema = _facts(width)
    facts = s.table(rows.mapInArrow(function, schema), "facts", keep=True)
    classes, shards = _sketch(s, facts)

    # One row stands for each set: that of the smallest id, null ids last.
    each = facts.where("ka IS NOT NULL").groupBy("ka", "kb", "doc_id", "tag", "tag2").agg(F.count("*").alias("again"), F.first("n").alias("n"), F.first("bins").alias("bins"))
    place = F.struct((F.col("doc_id") == F.lit(NO_ID)).alias("none"), "doc_id", "tag", "tag2")
    sets = each.groupBy("ka", "kb").agg(F.sum("again").alias("mult"), F.min(place).alias("p"), F.min_by("again", place).alias("again"), F.min_by("n", place).alias("n"), F.min_by("bins", place).alias("bins"))
    sets = s.table(sets.select(F.monotonically_increasing_id().alias("sid"), "ka", "kb", "n", "mult", "again", "p.doc_id", "p.tag", "p.tag2", "bins"), "sets")

    entries = rows.where("text <> ''").select("text").mapInArrow(_entries(classes, shards, width, num, den), _ENTRIES)
    entries = entries.repartition("token", "shard").sortWithinPartitions("token", "shard", "n", "pos", "ka")
    function, schema = _survivors(num, den)
    lists = s.table(entries.mapInArrow(function, schema), "lists")
    # Joins by sets are by sorting, however few the sets are; the counts by hash are fetched only for lists that are compared.
    lists = s.table(lists.join(sets.select("ka", "n", "sid").hint("merge"), ["ka", "n"]).select("token", "sid", "n", "pos"), "entries")
    s.drop("lists")
    bins = sets.select("sid", "bins").hint("merge")

    # Families: in each shard of each list, every set with one partner that passes.
    long_ = s.table(lists.groupBy("token").agg(F.ceil(F.count("*") / LIMIT).cast("int").alias("k")).where("k > 1"), "long")
    cut = lists.join(bins, "sid").join(long_, "token", "left").withColumn("shard", F.coalesce(F.pmod(F.xxhash64("sid", "token"), F.col("k")), F.lit(0)).cast("int")).drop("k")
    cut = cut.withColumn("label", F.col("sid")).withColumn("size", F.lit(1).cast("long"))
    columns, order = ["token", "shard", "n", "pos", "sid", "bins", "label", "size"], ["token", "shard", "n", "pos", "sid"]
    pairs = cut.select(columns).repartition("token", "shard").sortWithinPartitions(*order).mapInArrow(_candidates(False, num, den), "a long, b long").distinct()
    family = components(s, s.table(pairs, "pairs"), "family").withColumnRenamed("node", "sid")
    family = s.table(family.unionByName(family.select(F.col("label").alias("sid"), "label").distinct()).distinct(), "family")
    family = s.table(family.join(family.groupBy("label").agg(F.count("*").alias("size")), "label"), "families")

    # Guests: in lists with several families; a long one is compared by pairs of shards, or not at all where all its sets are of one family.
    named = lists.join(family.join(bins, "sid", "right").hint("merge"), "sid").withColumn("label", F.coalesce("label", "sid")).withColumn("size", F.coalesce("size", F.lit(1).cast("long")))
    named = s.table(named.select("token", "n", "pos", "sid", "bins", "label", "size"), "named_lists")
    several = named.join(long_, "token").groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).select("token", (F.col("low") != F.col("high")).alias("apart"))
    several = s.table(long_.join(several, "token"), "several")
    named = named.join(several, "token", "left").where("k IS NULL OR apart").withColumn("k", F.coalesce("k", F.lit(1)))
    named = named.withColumn("mine", F.pmod(F.xxhash64("sid", "token"), F.col("k")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    shard = F.least("mine", "with").cast("long") * F.col("k") + F.greatest("mine", "with")
    named = named.withColumn("shard", shard).select(columns)
    guests = named.repartition("token", "shard").sortWithinPartitions(*order).mapInArrow(_candidates(True, num, den), "sid long, label long").distinct()
    guests = s.table(guests, "guests")
    s.drop("named_lists")

    members = family.select("sid", "label", F.lit(False).alias("guest"))
    alone = guests.select(F.col("label").alias("sid")).distinct().join(family, "sid", "left_anti").select("sid", F.col("sid").alias("label"), F.lit(False).alias("guest"))
    visits = members.unionByName(alone).unionByName(guests.select("sid", "label", F.lit(True).alias("guest")))
    visits = visits.join(sets.select("sid", "doc_id", "tag", "tag2", "mult", "again").hint("merge"), "sid")
    answers = _family_answers(s, rows, visits, width, num, den)

    label = components(s, answers.where("to IS NOT NULL").select(F.col("sid").alias("a"), F.col("to").alias("b")), "class").withColumnRenamed("node", "sid")
    links = answers.groupBy("sid").agg(F.sum("links").alias("links"))
    named = sets.select("sid", "ka", "kb", "doc_id", "mult").join(label, "sid", "left").join(links, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    least = named.groupBy("label").agg(F.coalesce(F.min(F.when(F.col("doc_id") != F.lit(NO_ID), F.col("doc_id"))), F.min("doc_id")).alias("component"))
    named = named.join(least, "label").select("ka", "kb", "label", "component", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"))
    named = s.table(named, "named", keep=True)
    out = facts.where("block IS NULL").join(named.hint("merge"), ["ka", "kb"], "left")
    return out.select("doc_id", "tag", "tag2", "n", "label", F.coalesce("component", "doc_id").alias("component"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its set's size, the smallest id that links reach from it, and how many documents it is linked with."""
    with Scratch(spark) as s:
        out = similarity_classes(s, table(spark, sf_dir, "documents"))
        return s.table(out.select(given("doc_id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), given("component").alias("component_id"), F.col("links").alias("n_links")), "out", keep=True)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class only the row with the smallest id stays (a null id comes last, and of texts with one id the
    smallest hash goes first); of repeated rows of one id and text, one.  A row is known by its id and its text's hashes.

    Texts without a set are linked with nothing: those of unlike ids all stay, and of repeated rows one; a null id and an empty text
    repeated stay once too.  Columns of any other names are kept."""
    key, tag, tag2 = unused(docs, "gone_id", "gone_tag", "gone_tag2")
    text = F.coalesce("text", F.lit(""))
    same = (held("doc_id") == F.col(key)) & (F.xxhash64(text) == F.col(tag)) & (F.xxhash64(F.lit(7), text) == F.col(tag2))
    with Scratch(spark) as s:
        found = s.table(similarity_classes(s, docs, STAGE_WIDTH, STAGE_NUM, STAGE_DEN).groupBy("doc_id", "tag", "tag2", "label").agg(F.count("*").alias("rows")), "found")
        order = F.struct((F.col("doc_id") == F.lit(NO_ID)).alias("none"), "doc_id", "tag", "tag2")
        first = found.where("label IS NOT NULL").groupBy("label").agg(F.min(order).alias("first"))
        gone = found.join(first, "label").where(order != F.col("first"))
        gone = s.table(gone.select(F.col("doc_id").alias(key), F.col("tag").alias(tag), F.col("tag2").alias(tag2)), "gone", keep=True)
        own = (F.col("doc_id") == F.col(key)) & (F.col("tag") == F.col(tag)) & (F.col("tag2") == F.col(tag2))
        repeated = found.where("rows > 1").join(gone, own, "left_anti").limit(1).count()
    out = docs.join(gone, same, "left_anti")
    return out.dropDuplicates(["doc_id", "text"]) if repeated else out


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id, text) AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w
), k AS (SELECT r, len(s) AS n, unnest(s) AS z FROM s),
rare AS (SELECT z, count(*) AS df FROM k GROUP BY z),
o AS (SELECT r, n, k.z, row_number() OVER (PARTITION BY r ORDER BY df, k.z) AS p FROM k JOIN rare USING (z)),
f AS (SELECT r, n, z FROM o WHERE p <= n - ceil(0.9 * n - 1e-9) + 1),
c AS (SELECT DISTINCT a.r AS x, b.r AS y FROM f a JOIN f b ON a.z = b.z AND a.r < b.r AND a.n * 10 >= b.n * 9 AND b.n * 10 >= a.n * 9),
l AS (
  SELECT x, y FROM c JOIN s a ON a.r = x JOIN s b ON b.r = y
  WHERE 100 * len(list_intersect(a.s, b.s)) >= 90 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))
), e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
reach AS (SELECT r AS x, r AS y FROM s UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.c AS component_id, coalesce(t.n, 0)::BIGINT AS n_links
FROM s LEFT JOIN (SELECT x, count(*) AS n FROM e GROUP BY x) t ON t.x = s.r JOIN (SELECT x, min(t.doc_id) AS c FROM reach JOIN s t ON t.r = reach.y GROUP BY x) m ON m.x = s.r
"""
