"""Document fingerprints by a homomorphic multiset hash.

A text is a multiset of paragraphs (its lines).  Each paragraph is hashed to a wide vector and the vectors are
summed lane by lane modulo a power of two, so a fingerprint depends on no order, and a paragraph is inserted
or deleted by adding or subtracting its vector.  There are two parts:

* ``lanes``: 16 lanes modulo 2^32, each from 32 of the 512 bits of the paragraph's SHA-512.  Equal multisets have equal lanes.
* ``marks``: 64 lanes modulo 2^32, to each of which every clause of the paragraph adds one bit of its hash.
  Twice a lane less the number of clauses is a random projection of the multiset of clauses, so the cosine of
  two such vectors estimates how alike two texts are.

Only DataFrame expressions are used, and a fingerprint is an expression over its own row.  To put each document
beside the next one, documents are dealt into ranges of nearly equal bytes, by running sums over all (id, text's hash) in order, so neither
far ids nor many null ones make a large range; the first document of each
range is also sent to the range above, so a window within ranges suffices and texts are shuffled once.  Rows that repeat to the letter so often that
they would fill an eighth of a range are one row there; the others of them follow one another, and are made from one by counts.

Defined cases: a null text is the empty text (one empty paragraph, no clauses); a single document is its own next;
an empty table gives no rows; a null id comes last, and many are in order of their texts' hashes, as rows of any equal id are; repeated rows follow
one another; a very long text is a range of its own; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files
from .scratch import Scratch, given, held, let, table

LANES, WORDS = 16, 32
MASK = (1 << 32) - 1
#: One bit in each half of a long: each long holds two lanes of marks.
PAIR = (1 << 32) | 1
CLAUSE_ENDS = r"[.,;!?|\n]+"
#: Bytes of text in a range, at most, as long as no single document is larger.
RANGE_BYTES = 32 << 20
#: Repeated rows that are written together.
TOGETHER = 4096


def _zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0).cast("long"), n)


def lanes(text: Column) -> Column:
    """16 sums modulo 2^32 over the text's paragraphs."""

    def add(acc: Column, digest: Column) -> Column:
        return F.transform(acc, lambda a, j: (a + F.xxhash64(F.substring(digest, 8 * j + 1, F.lit(8))).bitwiseAND(F.lit(MASK))).bitwiseAND(F.lit(MASK)))

    return F.aggregate(F.transform(F.split(text, "\n", -1), lambda p: F.sha2(F.encode(p, "UTF-8"), 512)), _zeros(LANES), add)


def marks(text: Column) -> Column:
    """32 longs, each with two counts of clause hash bits; the last element is the number of clauses."""
    hashes = F.transform(F.array_remove(F.split(text, CLAUSE_ENDS, -1), ""), lambda u: F.xxhash64(u))

    def add(acc: Column, h: Column) -> Column:
        return F.transform(acc, lambda a, j: a + F.call_function("shiftrightunsigned", h, j).bitwiseAND(F.lit(PAIR)))

    return let(hashes, lambda hs: F.concat(F.aggregate(hs, _zeros(WORDS), add), F.array(F.size(hs).cast("long"))))


def fingerprint(text: Column) -> Column:
    return let(text, lambda t: F.struct(lanes(t).alias("lanes"), marks(t).alias("marks")))


def _change(a: Column, b: Column, sign: int) -> Column:
    def lane(x: Column, y: Column) -> Column:
        return (x + sign * y).bitwiseAND(F.lit(MASK))

    def pair(x: Column, y: Column) -> Column:
        low = lane(x.bitwiseAND(F.lit(MASK)), y.bitwiseAND(F.lit(MASK)))
        high = lane(F.shiftrightunsigned(x, 32), F.shiftrightunsigned(y, 32))
        return F.shiftleft(high, 32).bitwiseOR(low)

    return F.struct(F.zip_with(a["lanes"], b["lanes"], lane).alias("lanes"), F.zip_with(a["marks"], b["marks"], pair).alias("marks"))


def insert(of: Column, paragraph: Column) -> Column:
    """The fingerprint of a text with one paragraph (without line feeds) more, wherever it stands."""
    return _change(of, fingerprint(paragraph), 1)


def delete(of: Column, paragraph: Column) -> Column:
    """The fingerprint of a text with one of its paragraphs less."""
    return _change(of, fingerprint(paragraph), -1)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: one for equal fingerprints, else the cosine of the marks, with negative ones as 0."""

    def products(x: Column, y: Column) -> Column:
        n, m = F.element_at(x, WORDS + 1), F.element_at(y, WORDS + 1)

        def halves(v: Column, k: Column) -> list[Column]:
            return [(2 * w - k).cast("double") for w in (v.bitwiseAND(F.lit(MASK)), F.shiftrightunsigned(v, 32))]

        def both(v: Column, w: Column) -> Column:
            p, q = halves(v, n), halves(w, m)
            return F.struct((p[0] * q[0] + p[1] * q[1]).alias("xy"), (p[0] * p[0] + p[1] * p[1]).alias("xx"), (q[0] * q[0] + q[1] * q[1]).alias("yy"))

        rows = F.zip_with(F.slice(x, 1, WORDS), F.slice(y, 1, WORDS), both)
        zero = F.struct(*[F.lit(0.0).alias(c) for c in ("xy", "xx", "yy")])
        add = F.aggregate(rows, zero, lambda s, r: F.struct(*[(s[c] + r[c]).alias(c) for c in ("xy", "xx", "yy")]))
        return let(add, lambda s: F.coalesce(F.try_divide(s["xy"], F.sqrt(s["xx"] * s["yy"])), F.lit(0.0)))

    equal = (a["lanes"] == b["lanes"]) & (a["marks"] == b["marks"])
    return F.when(equal, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), products(a["marks"], b["marks"]))))


def text_of(of: Column) -> Column:
    """A fingerprint as hexadecimal text: 8 digits a lane, then 4 digits (modulo 2^16) a mark."""
    wide = F.transform(of["lanes"], lambda x: F.lpad(F.lower(F.hex(x)), 8, "0"))
    short = F.transform(F.slice(of["marks"], 1, WORDS), lambda x: F.concat(*[F.lpad(F.lower(F.hex(h.bitwiseAND(F.lit(0xFFFF)))), 4, "0") for h in (F.shiftrightunsigned(x, 32), x)]))
    return F.concat(F.array_join(wide, ""), F.array_join(short, ""))


def _ranges(scratch: Scratch, keys: DataFrame, parts: int) -> tuple[Column, DataFrame, int, DataFrame]:
    """A range's number as a function of (id, tag), ascending; for the first row of each range the range that also gets it; how many
    ranges there are; and the rows (id, tag, again) that repeat so often that one stands for all.

    One row per partition and per range reaches the driver.
    """
    spark = scratch.spark

    def size_of_range(of: DataFrame) -> int:
        total = of.agg(F.sum("bytes")).first()[0] or 0
        return max(1, -(-total // max(parts, -(-total // RANGE_BYTES))))

    each = size_of_range(keys)
    often = keys.groupBy("id", "tag").agg(F.count("*").alias("again"), F.sum("bytes").alias("all")).where((F.col("again") > 1) & (8 * F.col("all") > each))
    often = scratch.table(often, "often", keep=True)  # at most eight for each range
    rest = keys.join(F.broadcast(often), ["id", "tag"], "left_anti").unionByName(often.select("id", "tag", F.floor(F.col("all") / F.col("again")).alias("bytes")))
    bucket, _ = files.even_ranges(scratch, rest, size_of_range(rest))
    firsts = rest.groupBy(bucket.alias("b")).agg(F.max(F.struct("id", "tag")).alias("k")).select("b", "k.id", "k.tag").orderBy("b").collect()
    to = [(r["id"], r["tag"], firsts[(k + 1) % len(firsts)]["b"]) for k, r in enumerate(firsts)]
    return bucket, spark.createDataFrame(to, "id long, tag long, above int"), max(1, len(firsts)), often


def with_next(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """(id, text, print, next_text, next_print): each document beside the next one by descending id."""
    rows = docs.select(held("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tag", F.xxhash64("text"))
    keys = scratch.table(rows.select("id", "tag", (F.octet_length("text") + 64).cast("long").alias("bytes")), "keys")
    bucket, firsts, n, often = _ranges(scratch, keys, files.partitions_of(docs))
    # Of rows that repeat very often, one goes with the others; the rest follow one another.
    many = often.limit(1).count() > 0
    once = rows
    if many:
        alike = scratch.table(rows.join(F.broadcast(often.select("id", "tag")), ["id", "tag"], "left_semi").dropDuplicates(["id", "tag"]), "alike", keep=True)
        once = rows.join(F.broadcast(often.select("id", "tag")), ["id", "tag"], "left_anti").unionByName(alike)
    own = F.struct(bucket.alias("b"), F.lit(False).alias("copy"))
    both = F.when(F.col("above").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("above").alias("b"), F.lit(True).alias("copy"))))
    dealt = once.join(F.broadcast(firsts), ["id", "tag"], "left").select("id", "tag", "text", F.explode(both).alias("at")).select("id", "tag", "text", "at.*")
    dealt = dealt.repartitionById(n, F.col("b")).withColumn("print", fingerprint(F.col("text")))
    down = Window.partitionBy("b").orderBy(F.col("copy"), F.col("id").desc(), F.col("tag").desc())
    out = dealt.withColumn("next_text", F.lead("text").over(down)).withColumn("next_print", F.lead("print").over(down)).where(~F.col("copy"))
    out = out.select("id", "text", "print", "next_text", "next_print")
    if many:
        left = alike.join(F.broadcast(often), ["id", "tag"]).select("id", "text", (F.col("again") - 1).alias("left"))
        chunks = F.transform(F.sequence(F.lit(0).cast("long"), F.col("left") - 1, F.lit(TOGETHER).cast("long")), lambda a: F.least(F.lit(TOGETHER).cast("long"), F.col("left") - a).cast("int"))
        spread = left.select("id", "text", F.explode(chunks).alias("size")).repartition(n)
        spread = spread.withColumn("print", fingerprint(F.col("text"))).select("id", "text", "print", F.explode(F.array_repeat(F.lit(0), F.col("size"))).alias("_"))
        out = out.unionByName(spread.select("id", "text", "print", F.col("text").alias("next_text"), F.col("print").alias("next_print")))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: fingerprints of its text and its edited text, and likenesses."""
    with Scratch(spark) as s:
        rows = with_next(s, table(spark, sf_dir, "documents"))
        n = F.length("text")
        half = F.floor(n / 2).cast("int")
        edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
        made = let(edited, lambda e: F.struct(F.sha2(F.encode(e, "UTF-8"), 256).alias("sha"), fingerprint(e).alias("print")))
        out = rows.select("id", n.cast("long").alias("n_chars"), "print", "next_print", made.alias("e"))
        out = out.select(
            given("id").alias("doc_id"),
            "n_chars",
            F.col("e.sha").alias("edited_sha256"),
            text_of(F.col("print")).alias("fingerprint"),
            text_of(F.col("e.print")).alias("edited_fingerprint"),
            likeness(F.col("print"), F.col("e.print")).alias("near_edited"),
            likeness(F.col("print"), F.col("next_print")).alias("near_next"),
        )
        return s.table(out, "out", keep=True)
