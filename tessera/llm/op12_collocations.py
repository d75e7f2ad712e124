"""Phrase collocations: exact counts over all texts, by minimal perfect hashes of the phrases that can be frequent.

Words are known by a seeded 64-bit hash, and a seed is used only if no two words of the corpus share one under it; so a phrase is
exactly its triple of words.  The texts are scanned four times, each task giving one row of arrays for each shard of the hash space:

1. Words and their counts, summed by word.  The frequent ones become bits of a filter of bounded size.
2. Pairs and triples of words that the filter passes are counted by bucket of their hash; the buckets' counts are added up in a tree, and
   those that reach the least count become two more filters.
3. Candidates, safe by Apriori: a phrase is one if its words, its pairs and its own bucket pass.  A bucket counts at least what any phrase in it does, so a frequent phrase
   always is one.  For each shard the candidates' union gets a minimal perfect hash, stored with the triples themselves by slot.
4. The candidates' occurrences meet their shard's hash; tasks look up slots, verify the stored triples, and add up counts in
   one array for each shard, whatever the number of rows that pass.  Arrays of one shard are added up in a tree, too.

A cut's counts are read by slot in the same way, from the arrays of the shards that its parts are in.  What follows (the least score of a phrase's
cuts, phrases that longer ones explain, ranks) is on rows of frequent phrases alone.

Tasks hold a bounded run of words, a shard's candidates or arrays, and the filters; shards grow in number with the corpus, up to ``MOST_SHARDS``. Every task
gives a phrase once for each run of words, so no phrase or language makes a task long.  Filters have at most 2^``MOST_BITS`` bits: beyond some 10^8 words their
buckets fill up, more candidates are counted, and the result is the same.

Defined cases: a null text is empty; a null language is ``und``, as is the language of that name; an empty table gives no rows; repeated rows count each; ties of all three ranks
can't be, since phrases of a language differ; texts of any length are read in pieces; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files
from .minimal_hash import PerfectHash
from .scratch import Scratch, table

#: The least count of a candidate, the part of a phrase's count from which a longer one explains it (in hundredths), and ranks for each language.
LEAST, EXPLAINED, TOP = 10, 50, 2000
#: Words of a run, and bytes of text that are split at once.
RUN_WORDS, SPLIT_BYTES = 2 << 20, 4 << 20
#: Buckets of a block of counters, filters' largest size, words for each shard, shards at most, and rows of arrays that one task adds up.
BLOCK_BITS, MOST_BITS, SHARD_WORDS, MOST_SHARDS, FAN_IN = 20, 27, 2 << 20, 1 << 16, 64
#: Ids of no word (between two spaces) and of a break.
NOTHING, BREAK = 0, 1


def _table() -> bytes:
    out = bytearray(range(256))
    out[65:91] = range(97, 123)
    out[9] = 32
    for c in b".,;:!?\n\x0b\x0c\r":
        out[c] = 10
    return bytes(out)


#: A-Z in lower case, tabs as spaces, and all breaks as line feeds.
_TABLE = _table()


class _Ids(dict):
    """Numbers for words as they are first met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Run:
    """The words of some texts of one language, as numbers in order, with breaks between pieces."""

    def __init__(self):
        self.ids = _Ids({b"": NOTHING, b"\n": BREAK})
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str):
        """Adds a text; yields whenever the run is long enough to be handed on."""
        data = text.encode().translate(_TABLE).replace(b"\n", b" \n ") + b" \n"
        at = 0
        while at < len(data):
            stop = data.find(b" ", at + SPLIT_BYTES)
            stop = len(data) if stop < 0 else stop
            words = data[at:stop].split(b" ")
            self.parts.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
            self.size += len(words)
            at = stop + 1

    def close(self, seed: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """The numbers without gaps, the words by number, and their keys."""
        ids = np.concatenate(self.parts)
        words = [*self.ids]
        keys = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words)).view(np.int64)
        return ids[ids != NOTHING].astype(np.int64), words, keys


def runs(batches):
    """(language, run) of a task's texts; a text of over RUN_WORDS words is in one run."""
    held: dict[str, Run] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            run = held.setdefault(lang, Run())
            run.add(text)
            if run.size >= RUN_WORDS:
                yield lang, held.pop(lang)
            elif len(held) > 64:  # many languages: the longest run goes, so that what is held stays bounded
                longest = max(held, key=lambda x: held[x].size)
                yield longest, held.pop(longest)
    yield from held.items()


def lang_key(lang: str, seed: int) -> np.int64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode(), seed)).astype(np.int64)


def blend(keys: np.ndarray) -> np.ndarray:
    """A hash of triples, which ``blended`` gives of columns: words turned by 21 and 42 bits."""
    w = keys.view(np.uint64)
    turn = lambda x, by: x << np.uint64(by) | x >> np.uint64(64 - by)
    return w[:, 0] ^ turn(w[:, 1], 21) ^ turn(w[:, 2], 42)


def blended(a: Column, b: Column, c: Column) -> Column:
    turn = lambda x, by: F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))
    return a.bitwiseXOR(turn(b, 21)).bitwiseXOR(turn(c, 42))


def shard_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits) if bits else np.zeros(len(hashes))).astype(np.int64)


def passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the hashes' bits are set; the bitmap's size is a power of two."""
    at = (hashes & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0


def stretches(values: np.ndarray) -> list[tuple[int, int]]:
    """Where equal values of a sorted array start and stop."""
    edges = np.flatnonzero(np.diff(values, prepend=-1)).tolist()
    return list(zip(edges, [*edges[1:], len(values)], strict=True)) if edges else []


class Grams:
    """Distinct phrases of a run and their counts; of pairs and triples those of frequent words, and of what ``buckets`` pass."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, lk: np.int64, frequent: np.ndarray, buckets: list[np.ndarray] | None = None):
        salt, n = np.uint64(lk.view(np.uint64)), len(keys)

        def triples(*columns):
            return np.stack([keys[c] for c in columns] + [np.zeros(len(columns[0]), np.int64)] * (3 - len(columns)), 1)

        counts = np.bincount(ids, minlength=n)
        known = passes(frequent, keys.view(np.uint64) ^ salt)
        known[[NOTHING, BREAK]] = False
        words = np.flatnonzero(known & (counts > 0))
        here = known[ids]
        of_two = here[:-1] & here[1:]
        pairs, which, n_pairs = np.unique(ids[:-1][of_two] * n + ids[1:][of_two], return_inverse=True, return_counts=True)
        two = triples(pairs // n, pairs % n)
        pair_at = np.full(max(0, len(ids) - 1), -1, np.int64)
        pair_at[of_two] = which
        if buckets:
            fit = passes(buckets[0], blend(two) ^ salt)
            of_two &= fit[pair_at] if len(fit) else False
            two, n_pairs = two[fit], n_pairs[fit]
        of_three = of_two[:-1] & of_two[1:]
        threes, n_threes = np.unique(pair_at[:-1][of_three] * n + ids[2:][of_three], return_counts=True)
        first = pairs[threes // n]
        three = triples(first // n, first % n, threes % n)
        if buckets:
            fit = passes(buckets[1], blend(three) ^ salt)
            three, n_threes = three[fit], n_threes[fit]
        #: (size, triples, counts) of words, pairs and triples.
        self.of = [(1, triples(words), counts[words]), (2, two, n_pairs), (3, three, n_threes)]


def scan(docs: DataFrame, rows_of, schema: str) -> DataFrame:
    """``rows_of(lang, run)`` gives the rows of a run, as dictionaries, or as batches; texts and languages without nulls."""
    fields = docs.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def read(batches):
        for lang, run in runs(batches):
            gathered, size = [], 0
            for row in rows_of(lang, run):
                if isinstance(row, pa.RecordBatch):
                    yield row
                    continue
                gathered.append(row)
                size += sum(len(v) for v in row.values() if isinstance(v, bytes)) + 100
                if size >= 4 << 20:
                    yield pa.RecordBatch.from_pylist(gathered, arrow)
                    gathered, size = [], 0
            if gathered:
                yield pa.RecordBatch.from_pylist(gathered, arrow)

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(read, schema)


def grouped(df: DataFrame, parts: int, keys: list[str], fold, schema: str, then: tuple[str, ...] = ()) -> DataFrame:
    """Rows of each group in one task, as a stream: ``fold(key)`` gives ``add(row)`` and ``close()``, the group's rows.

    A group is never held: ``fold`` keeps what it makes of it, and ``then`` are columns that order the rows of a group.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def read(batches):
        at, add, close = None, None, None
        for batch in batches:
            out = []
            names = batch.schema.names
            columns = [batch.column(c) if pa.types.is_binary(batch.schema.field(c).type) else batch.column(c).to_pylist() for c in names]
            for values in zip(*columns, strict=True):
                row = dict(zip(names, values, strict=True))
                key = tuple(row[c] for c in keys)
                if key != at:
                    if at is not None:
                        out += close()
                    at, (add, close) = key, fold(key)
                add(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
        if at is not None and (out := close()):
            yield pa.RecordBatch.from_pylist(out, arrow)

    return df.repartition(parts, *keys).sortWithinPartitions(*keys, *then).mapInArrow(read, schema)


def _array(cell, kind=np.int64) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)


def summed(scratch: Scratch, df: DataFrame, parts: int, keys: list[str], fold, schema: str, tasks: int, name: str) -> DataFrame:
    """A tree of sums over ``df``, which has a column ``salt`` of 0 to ``tasks`` - 1: at most FAN_IN salts are added up at once."""
    turn = 0
    while True:
        tasks = -(-tasks // FAN_IN)
        df = df.withColumn("salt", F.floor(F.col("salt") / FAN_IN))
        df = scratch.table(grouped(df, max(1, parts * min(tasks, 8)), [*keys, "salt"], fold, schema), f"{name}-{turn}")
        if tasks <= 1:
            return df
        turn += 1


def word_counts(scratch: Scratch, docs: DataFrame, seed: int = 0) -> tuple[DataFrame, int]:
    """(lang, lk, key, word, f) of all words, and the first seed from ``seed`` on under which no two of them share a key."""
    while True:

        def rows_of(lang, run, seed=seed):
            ids, words, keys = run.close(seed)
            n, counts = len(words) - BREAK - 1, np.bincount(ids, minlength=len(words))
            same = [pa.array([x], t).take(pa.array(np.zeros(n, np.int64))) for x, t in ((lang, pa.string()), (int(lang_key(lang, seed)), pa.int64()))]
            words = pa.array(words[BREAK + 1 :], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*same, pa.array(keys[BREAK + 1 :]), words, pa.array(counts[BREAK + 1 :])], names=["lang", "lk", "key", "word", "f"])

        found = scan(docs, rows_of, "lang string, lk long, key long, word string, f long")
        found = scratch.table(found.groupBy("lang", "lk", "key", "word").agg(F.sum("f").alias("f")), f"words-{seed}")
        shared = found.groupBy("key").agg(F.min("word").alias("a"), F.max("word").alias("b")).where("a <> b")
        if shared.isEmpty():
            return found, seed
        seed += 1


def bits_for(n: int, least: int) -> int:
    return max(least, min(MOST_BITS, (max(1, n) - 1).bit_length()))


def word_filter(frequent: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the keys of (key, lk)."""
    at = F.col("key").bitwiseXOR(F.col("lk")).bitwiseAND(F.lit((1 << bits) - 1)) + 1
    rows = frequent.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(max(4096, 1 << bits >> 3), np.uint8)
    for r in rows:
        first = (r["bucket"] - 1) * 4096
        out[first : first + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out[: 1 << bits >> 3]


def bucket_filters(scratch: Scratch, docs: DataFrame, seed: int, frequent, bits: int, least: int, tasks: int) -> list[np.ndarray]:
    """Bitmaps of the buckets of pairs and of triples whose counts reach ``least``."""
    in_block = (1 << BLOCK_BITS) - 1

    def rows_of(lang, run):
        ids, _, keys = run.close(seed)
        lk, salt = lang_key(lang, seed), TaskContext.get().partitionId() % tasks
        for size, triples, counts in Grams(ids, keys, lk, frequent.value).of[1:]:
            at = ((blend(triples) ^ lk.view(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)
            at, which = np.unique(at, return_inverse=True)
            counts = np.minimum(np.bincount(which, counts, len(at)), least).astype(np.uint8)
            blocks = at >> BLOCK_BITS
            for a, b in stretches(blocks):
                yield {"size": size, "block": int(blocks[a]), "salt": salt, "places": (at[a:b] & in_block).astype(np.int32).tobytes(), "counts": counts[a:b].tobytes()}

    def fold(key):
        total = np.zeros(in_block + 1, np.int32)

        def add(row):
            total[_array(row["places"], np.int32)] += _array(row["counts"], np.uint8)

        def close():
            at = np.flatnonzero(total)
            return [{"size": key[0], "block": key[1], "salt": key[2], "places": at.astype(np.int32).tobytes(), "counts": np.minimum(total[at], least).astype(np.uint8).tobytes()}]

        return add, close

    schema = "size int, block int, salt long, places binary, counts binary"
    sums = summed(scratch, scan(docs, rows_of, schema), 2 << max(0, bits - BLOCK_BITS), ["size", "block"], fold, schema, tasks, "buckets")

    def bitmap(batches):
        for batch in batches:
            out = []
            for places, counts in zip(batch.column("places"), batch.column("counts"), strict=True):
                on = np.zeros(1 << min(bits, BLOCK_BITS), bool)
                on[_array(places, np.int32)[_array(counts, np.uint8) >= least]] = True
                out.append(np.packbits(on, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("size"), batch.column("block"), pa.array(out, pa.binary())], names=["size", "block", "bits"])

    out = [np.zeros(1 << bits >> 3, np.uint8) for _ in range(2)]
    for r in sums.mapInArrow(bitmap, "size int, block int, bits binary").toLocalIterator():
        first = r["block"] << BLOCK_BITS >> 3
        out[r["size"] - 2][first : first + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


SHARD = ["lang", "lk", "size", "shard"]
SHARD_SCHEMA = "lang string, lk long, size int, shard int"


def phrase_counts(scratch: Scratch, docs: DataFrame, seed: int, frequent, buckets, shard_bits: int, tasks: int) -> DataFrame:
    """For each shard its minimal perfect hash and the candidates' counts by slot: (lang, lk, size, shard, function, counts)."""
    parts = 1 << shard_bits

    def candidates(lang, run):
        ids, _, keys = run.close(seed)
        lk = lang_key(lang, seed)
        for size, triples, counts in Grams(ids, keys, lk, frequent.value, buckets.value).of:
            shards = shard_of(blend(triples), shard_bits)
            order = np.argsort(shards, kind="stable")
            shards, triples, counts = shards[order], triples[order], counts[order]
            for a, b in stretches(shards):
                row = {"lang": lang, "lk": int(lk), "size": size, "shard": int(shards[a])}
                yield row, np.ascontiguousarray(triples[a:b, :size]), counts[a:b].astype(np.int32)

    def wide(cell, size):
        keys = _array(cell).reshape(-1, size)
        return np.concatenate([keys, np.zeros((len(keys), 3 - size), np.int64)], 1)

    def only_keys(lang, run):
        for row, keys, _ in candidates(lang, run):
            yield row | {"keys": keys.tobytes()}

    def keys_and_counts(lang, run):
        salt = TaskContext.get().partitionId() % tasks
        for row, keys, counts in candidates(lang, run):
            yield row | {"salt": salt, "keys": keys.tobytes(), "counts": counts.tobytes()}

    def union(key):
        size, held, more = key[2], np.zeros((0, 3), np.int64), []

        def merge():
            nonlocal held
            held = np.unique(np.concatenate([held, *more]), axis=0)
            more.clear()

        def add(row):
            more.append(wide(row["keys"], size))
            if sum(map(len, more)) > max(1 << 16, 2 * len(held)):
                merge()

        def close():
            merge()
            return [dict(zip(SHARD, key, strict=True)) | {"function": PerfectHash.build(held).pack()}]

        return add, close

    functions = grouped(scan(docs, only_keys, f"{SHARD_SCHEMA}, keys binary"), parts, SHARD, union, f"{SHARD_SCHEMA}, function binary")
    functions = scratch.table(functions, "functions")

    def tally(key):
        function, counts = None, None

        def add(row):
            nonlocal function, counts
            if row["kind"] == 0:
                function = PerfectHash.unpack(row["keys"].as_buffer())
                counts = np.zeros(len(function.stored), np.int64)
            else:
                slots = function.slots(wide(row["keys"], key[2]))
                counts += np.bincount(slots[slots >= 0], _array(row["counts"], np.int32)[slots >= 0], len(counts)).astype(np.int64)

        def close():
            return [dict(zip([*SHARD, "salt"], key, strict=True)) | {"counts": counts.tobytes()}]

        return add, close

    def added(key):
        total = None

        def add(row):
            nonlocal total
            total = _array(row["counts"]).copy() if total is None else total + _array(row["counts"])

        return add, lambda: [dict(zip([*SHARD, "salt"], key, strict=True)) | {"counts": total.tobytes()}]

    salts = -(-tasks // FAN_IN)
    each = functions.select(*SHARD, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), F.lit(0).alias("kind"), F.col("function").alias("keys"), F.lit(None).cast("binary").alias("counts"))
    rows = scan(docs, keys_and_counts, f"{SHARD_SCHEMA}, salt long, keys binary, counts binary")
    rows = rows.select(*SHARD, F.floor(F.col("salt") / FAN_IN).alias("salt"), F.lit(1).alias("kind"), "keys", "counts")
    schema = f"{SHARD_SCHEMA}, salt long, counts binary"
    counts = scratch.table(grouped(each.unionByName(rows), parts * min(salts, 8), [*SHARD, "salt"], tally, schema, ("kind",)), "tallied")
    if salts > 1:
        counts = summed(scratch, counts, parts, SHARD, added, schema, salts, "summed")
    return scratch.table(functions.join(counts.drop("salt"), SHARD), "shards")


TRIPLE = ["w1", "w2", "w3"]


def frequent_phrases(shards: DataFrame, least: int) -> DataFrame:
    """(lang, lk, size, w1, w2, w3, f) of the phrases that reach ``least``."""

    def read(batches):
        for batch in batches:
            for lang, lk, size, function, counts in zip(*(batch.column(c) for c in ("lang", "lk", "size", "function", "counts")), strict=True):
                f = _array(counts)
                stored = PerfectHash.unpack(function.as_buffer()).stored
                on = np.flatnonzero(f >= least)
                n = len(on)
                columns = [pa.array([x.as_py()] * n, x.type) for x in (lang, lk, size)] + [pa.array(stored[on, k]) for k in range(3)] + [pa.array(f[on])]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "lk", "size", *TRIPLE, "f"])

    return shards.mapInArrow(read, f"lang string, lk long, size int, {', '.join(f'{w} long' for w in TRIPLE)}, f long")


def read_counts(shards: DataFrame, asked: DataFrame, shard_bits: int) -> DataFrame:
    """The counts, by slot, of phrases (lang, lk, size, w1, w2, w3) that are asked for."""
    shard = F.shiftrightunsigned(blended(*(F.col(w) for w in TRIPLE)), 64 - shard_bits).cast("int") if shard_bits else F.lit(0)
    nothing = [F.lit(None).cast("binary").alias(c) for c in ("function", "counts")]
    queries = asked.select("lang", "lk", "size", shard.alias("shard"), F.lit(1).alias("kind"), *TRIPLE, *nothing)
    rows = shards.select(*SHARD, F.lit(0).alias("kind"), *[F.lit(None).cast("long").alias(w) for w in TRIPLE], "function", "counts").unionByName(queries)

    def read(batches):
        function, counts = None, None
        for batch in batches:
            kinds = np.append(batch.column("kind").to_numpy(zero_copy_only=False), 0)
            heads, at = np.flatnonzero(kinds == 0), 0
            for head in heads.tolist():
                if head > at:
                    own = batch.slice(at, head - at)
                    keys = np.stack([own.column(w).to_numpy(zero_copy_only=False).astype(np.int64) for w in TRIPLE], 1)
                    slots = function.slots(keys)
                    f = pa.array(counts[slots], mask=slots < 0)
                    yield pa.RecordBatch.from_arrays([own.column(c) for c in ("lang", "size", *TRIPLE)] + [f], names=["lang", "size", *TRIPLE, "f"])
                if head < len(kinds) - 1:
                    function, counts = PerfectHash.unpack(batch.column("function")[head].as_buffer()), _array(batch.column("counts")[head])
                at = head + 1

    schema = f"lang string, size int, {', '.join(f'{w} long' for w in TRIPLE)}, f long"
    return rows.repartition(1 << shard_bits, *SHARD).sortWithinPartitions(*SHARD, "kind").mapInArrow(read, schema)


def collocations(scratch: Scratch, docs: DataFrame, least: int = LEAST, explained: int = EXPLAINED, top: int = TOP, bits: int | None = None, shard_bits: int | None = None, seed: int = 0) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the first ``top`` phrases of each language of (text, lang)."""
    context = docs.sparkSession.sparkContext
    tasks = files.partitions_of(docs)
    words, seed = word_counts(scratch, docs, seed)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = scratch.table(words.where(F.col("f") >= least), "frequent")
    n_words, n_frequent = words.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0], frequent.count()
    known = context.broadcast(word_filter(frequent, bits_for(16 * n_frequent, 15)))
    bits = bits or bits_for(2 * n_words, BLOCK_BITS)
    buckets = context.broadcast(bucket_filters(scratch, docs, seed, known, bits, least, tasks))
    if shard_bits is None:
        shard_bits = min(MOST_SHARDS.bit_length() - 1, (n_words // SHARD_WORDS).bit_length())
    shards = phrase_counts(scratch, docs, seed, known, buckets, shard_bits, tasks)
    found = scratch.table(frequent_phrases(shards.where("size > 1"), least).withColumnRenamed("f", "a"), "phrases")

    def part(*names: str) -> Column:
        return F.struct(F.lit(len(names)).alias("size"), *[F.col(n).alias(w) if n else F.lit(0).cast("long").alias(w) for n, w in zip([*names, "", ""], TRIPLE, strict=False)])

    cut = lambda k, first, rest: F.struct(F.lit(k).alias("k"), part(*first).alias("first"), part(*rest).alias("rest"))
    cuts = F.when(F.col("size") == 2, F.array(cut(1, ["w1"], ["w2"]))).otherwise(F.array(cut(1, ["w1"], ["w2", "w3"]), cut(2, ["w1", "w2"], ["w3"])))
    cuts = found.withColumn("cut", F.explode(cuts)).withColumn("side", F.explode(F.array(F.lit("l"), F.lit("r"))))
    side = F.when(F.col("side") == "l", F.col("cut.first")).otherwise(F.col("cut.rest"))
    sides = cuts.select("lang", "lk", *TRIPLE, "a", F.col("cut.k").alias("k"), "side", side.alias("part"))
    asked = sides.select("lang", "lk", "part.*").distinct()
    answers = scratch.table(read_counts(shards, asked, shard_bits), "answers").select("lang", F.struct("size", *TRIPLE).alias("part"), "f")
    sides = sides.join(answers, ["lang", "part"])
    scored = sides.groupBy("lang", *TRIPLE, "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    scored = scored.withColumn("up", F.lit(1_000_000).cast("decimal(38,0)") * whole("a") * whole("a")).withColumn("down", whole("l") * whole("r"))
    scored = scored.withColumn("score", F.expr("cast(up div down AS bigint)"))
    best = scored.groupBy("lang", *TRIPLE, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", *TRIPLE, "a", "best.*")
    longer = found.where("size = 3").select("lang", "a", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("two"))
    longer = longer.select("lang", "two.*", "a").groupBy("lang", "w1", "w2").agg(F.max("a").alias("longest")).withColumn("w3", F.lit(0).cast("long"))
    kept = best.join(longer, ["lang", *TRIPLE], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < explained * F.col("a")))
    # Ties at the last rank stay until their words are known, by which they are ordered.
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = scratch.table(kept.withColumn("near", F.rank().over(by_score)).where(F.col("near") <= top), "near")
    for w in TRIPLE:
        near = near.join(frequent.select("lang", F.col("key").alias(w), F.col("word").alias(f"{w}_text")), ["lang", w], "inner" if w != "w3" else "left")
    near = near.withColumn("phrase", F.concat_ws(" ", *[f"{w}_text" for w in TRIPLE]))
    last = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = near.withColumn("rank", F.row_number().over(last).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as s:
        return s.table(collocations(s, table(spark, sf_dir, "documents")), "found", keep=True)


ORACLE_SQL = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
places AS (SELECT lang, unnest(w) AS a, unnest(list_resize(w[2:], len(w))) AS b, unnest(list_resize(w[3:], len(w))) AS c FROM words),
f1 AS (SELECT lang, a, count(*) AS f FROM places GROUP BY ALL),
f2 AS (SELECT lang, a, b, count(*) AS f FROM places WHERE b IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
f3 AS (SELECT lang, a, b, c, count(*) AS f FROM places WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
totals AS (SELECT lang, cast(sum(f) AS bigint) AS n FROM f1 GROUP BY lang),
cuts AS (SELECT f2.lang, f2.a AS w1, f2.b AS w2, NULL AS w3, f2.f AS a, 1 AS k, x.f AS l, y.f AS r FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.a = f2.a JOIN f1 y ON y.lang = f2.lang AND y.a = f2.b
    UNION ALL SELECT f3.lang, f3.a, f3.b, f3.c, f3.f, 1, x.f, y.f FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.a = f3.a JOIN f2 y ON y.lang = f3.lang AND y.a = f3.b AND y.b = f3.c
    UNION ALL SELECT f3.lang, f3.a, f3.b, f3.c, f3.f, 2, x.f, y.f FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.a = f3.a AND x.b = f3.b JOIN f1 y ON y.lang = f3.lang AND y.a = f3.c),
scored AS (SELECT *, (1000000::hugeint * a * a) // (l::hugeint * r) AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, w1, w2, w3 ORDER BY score, k) = 1),
longer AS (SELECT lang, a AS w1, b AS w2, f FROM f3 UNION ALL SELECT lang, b, c, f FROM f3),
kept AS (SELECT lang, concat_ws(' ', w1, w2, w3) AS phrase, a, l, r, score FROM best WHERE w3 IS NOT NULL OR NOT EXISTS (SELECT 1 FROM longer WHERE longer.lang = best.lang AND longer.w1 = best.w1 AND longer.w2 = best.w2 AND 100 * longer.f >= {EXPLAINED} * best.a))
SELECT lang, rank, phrase, a, l, r, n, cast(score AS bigint) AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang) WHERE rank <= {TOP}
"""
