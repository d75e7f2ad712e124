"""Prefix trie of conversations, built level by level, and the savings of storing each shared turn once.

``turns_in_order`` numbers the turns of every conversation, ``shared_heads`` rebuilds conversations whose first turns
come from another one, and ``build`` makes the trie of any numbered turns:

* Down: all live conversations are in the root.  At each depth the live conversations are joined with their next turn
  and grouped by (parent node, next turn); a group is a node, named by its smallest conversation.  A node with one member
  is the head of a path that nothing shares, so its conversation leaves the live ones, and the rest of it is read off its turns.
  So there are as many levels as the deepest shared turn asks for, and a conversation of any length that shares nothing costs one join.
* Up: from the deepest level to the root, children are summed by parent and joined with the parents' own rows, which gives
  each node its leaves and what its subtree saves.

A turn is compared by the SHA-256 of its role and text, and texts are not shuffled.  Turns are numbered from a range sort with one count for each
range and conversation, so one conversation may hold any share of the rows; groups are counted before they are shuffled, and joins
back to their members are split by Spark where a key is hot.  The conversations that end in a node are hashed as a stream
over chunks of their sorted ids: SHA-256 goes through its input in order, so a node's chunks meet in one task, which keeps one chunk at a time.

Defined cases: a null role or text is the empty one; a null turn comes first; turns of one number follow one another in the order of
their digests, and repeated rows are turns of their own; rows without a conversation's id belong to none; an empty table gives no nodes, not
even a root; ``conv_id % every`` has the sign of the id, as in SQL; texts of any length are hashed whole; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files
from .scratch import Scratch, table

#: Words of a turn.
WORD = r"[^\x20\x09-\x0D]+"
#: The query's rule: conversations are rebuilt on that of the last id divisible by EVERY, by fewer than HEADS of its turns.
EVERY, HEADS = 20, 4
#: Ids of so many numbers in a row (two to this power) are joined into one chunk before they are hashed.
CHUNK_BITS = 9


def digest_of(role: Column, text: Column) -> Column:
    """32 bytes by which two turns are equal: the role's length keeps it apart from the text."""
    return F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))


def turns_in_order(scratch: Scratch, conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 0, digest, words) of each turn of (conv_id, turn, role, text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest_of(role, text).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("digest").asc()]
    ranged = rows.repartitionByRange(files.partitions_of(rows), *order).sortWithinPartitions(*order)
    # The number holds the range in its upper bits, and counts the range's rows in order.
    numbered = scratch.table(ranged.withColumn("seq", F.monotonically_increasing_id()), "numbered").withColumn("range", F.shiftright("seq", 33))
    spans = numbered.groupBy("conv_id", "range").agg(F.min("seq").alias("first"), F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("conv_id", "range", (before - F.col("first")).alias("shift"))
    return scratch.table(numbered.join(spans, ["conv_id", "range"]).select("conv_id", (F.col("seq") + F.col("shift")).alias("place"), "digest", "words"), "ordered")


def shared_heads(scratch: Scratch, ordered: DataFrame, every: int = EVERY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: (conv_id, depth from 1, digest, words) of their turns, and (conv_id, size) of all, turnless ones too.

    Each takes the first crc32(conv_id) % ``heads`` turns of the conversation whose id is ``conv_id - conv_id % every``, then its own turns after so many.
    """
    c = F.col("conv_id")
    sizes = scratch.table(ordered.groupBy("conv_id").agg(F.count("*").alias("own")), "sizes")
    convs = sizes.withColumn("base", c - c % every).withColumn("head", F.crc32(c.cast("string").cast("binary")) % heads)
    base_sizes = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    convs = convs.join(base_sizes, "base", "left").withColumn("taken", F.least("head", F.coalesce("of_base", F.lit(0))))
    convs = scratch.table(convs.select("conv_id", "base", "head", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("size")), "convs")
    firsts = ordered.where((F.col("place") < heads) & (c % every == 0)).select(c.alias("base"), "place", "digest", "words")
    given = convs.where("taken > 0").join(firsts, "base").where("place < taken").select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "words")
    own = ordered.join(convs, "conv_id").where("place >= head").select("conv_id", (F.col("place") - F.col("head") + F.col("taken") + 1).alias("depth"), "digest", "words")
    return scratch.table(given.unionByName(own), "turns"), convs.select("conv_id", "size")


def build(scratch: Scratch, turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie of numbered turns (conv_id, depth, digest, words) of conversations (conv_id, size).

    Returns its nodes (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens) and the ends (conv_id, depth, node):
    the node in which each conversation ends.  Both depend on tables that are kept.
    """
    least, n = convs.agg(F.min("conv_id"), F.count("*")).first()
    members = convs.select("conv_id", "size", *[F.lit(v).cast("long").alias(c) for c, v in (("depth", 0), ("parent", None), ("node", least), ("n", n), ("words", 0))])
    levels = [scratch.table(members, "members-0", keep=True)]
    while True:
        live = levels[-1] if len(levels) == 1 else levels[-1].where("n > 1")
        depth = len(levels)
        going = live.where(F.col("size") >= depth).select("conv_id", "size", F.col("node").alias("parent"))
        following = going.join(turns.where(F.col("depth") == depth).select("conv_id", "digest", "words"), "conv_id")
        nodes = following.groupBy("parent", "digest").agg(F.min("conv_id").alias("node"), F.count("*").alias("n"))
        found = following.join(nodes, ["parent", "digest"]).select("conv_id", "size", F.lit(depth).cast("long").alias("depth"), "parent", "node", "n", "words")
        found = scratch.table(found, f"members-{depth}", keep=True)
        if found.isEmpty():
            break
        levels.append(found)

    # Members that are alone in their node: all deeper turns of theirs are nodes of their own.
    alone = [m.where("n = 1") for m in levels[1:]]
    heads = None
    for m in alone:
        heads = m if heads is None else heads.unionByName(m)
    if heads is None:
        heads = levels[0].limit(0)
    heads = heads.select("conv_id", "size", F.col("depth").alias("from"), "parent")
    tails = turns.join(heads, "conv_id").where(F.col("depth") >= F.col("from"))
    last = F.col("depth") == F.col("size")
    tails = tails.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("from"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
    )
    nodes, below = tails, None
    for depth in range(len(levels) - 1, -1, -1):
        of = levels[depth].where((F.col("conv_id") == F.col("node")) & (F.lit(depth == 0) | (F.col("n") > 1)))
        own = of.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), ((F.col("n") - 1) * F.col("words")).alias("own_saved"))
        children = heads.where(F.col("from") == depth + 1).select(F.col("parent").alias("conv_id"), F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
        if below is not None:
            children = children.unionByName(below.select(F.col("parent_conv_id").alias("conv_id"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
        sums = children.groupBy("conv_id").agg(F.count("*").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        own = own.join(sums, "conv_id", "left")
        n_children = F.coalesce("n_children", F.lit(0))
        own = own.select("conv_id", "depth", "parent_conv_id", "n_convs", n_children.alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"), (F.col("own_saved") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"))
        below = scratch.table(own, f"nodes-{depth}", keep=True)
        nodes = nodes.unionByName(below)

    ends = heads.select("conv_id", F.col("size").alias("depth"), F.col("conv_id").alias("node"))
    for depth, m in enumerate(levels):
        stays = F.lit(True) if depth == 0 else F.col("n") > 1
        ends = ends.unionByName(m.where(stays & (F.col("size") == depth)).select("conv_id", "depth", "node"))
    return nodes, ends


def with_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes with the columns of their last turn, from any table of (conv_id, depth, ...); the root has nulls there."""
    return nodes.join(turns, ["conv_id", "depth"], "left")


def ids_sha256(ends: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256): SHA-256 of the comma-joined decimal ids of the conversations that end in a node, ascending."""
    chunks = ends.groupBy("node", "depth", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def hashed(batches):
        at, digest = None, None
        for batch in batches:
            done = []
            for node, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "ids")), strict=True):
                if at != (node, depth):
                    if at is not None:
                        done.append((*at, digest.hexdigest()))
                    at, digest = (node, depth), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(("node", "depth", "ends_sha256"), x, strict=True)) for x in done], schema)
        if at is not None:
            yield pa.RecordBatch.from_pylist([{"node": at[0], "depth": at[1], "ends_sha256": digest.hexdigest()}], schema)

    schema = pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    # A node that one conversation ends in, and each chunk that is all of its node's, needs no stream.
    counted = chunks.groupBy("node", "depth").agg(F.count("*").alias("chunks"), F.min("ids").alias("ids"))
    one = counted.where("chunks = 1").select("node", "depth", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    more = chunks.join(counted.where("chunks > 1").select("node", "depth"), ["node", "depth"]).repartition("node", "depth").sortWithinPartitions("node", "depth", "chunk")
    return one.unionByName(more.select("node", "depth", "ids").mapInArrow(hashed, "node long, depth long, ends_sha256 string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    with Scratch(spark) as s:
        ordered = turns_in_order(s, table(spark, sf_dir, "conversations"))
        nodes, ends = build(s, *shared_heads(s, ordered))
        digests = ids_sha256(ends).select(F.col("node").alias("conv_id"), "depth", "ends_sha256")
        found = nodes.join(digests, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
        return s.table(found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"), "found", keep=True)


#: The CRC-32 of a decimal id bit by bit: each byte enters with the first of its eight steps.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(1, length(cast({c} AS varchar)) + 1),
    lambda k: [ascii(substr(cast({c} AS varchar), k::int, 1))::bigint, 0, 0, 0, 0, 0, 0, 0]))),
    lambda acc, e: xor(xor(acc, e) >> 1, 3988292384 * (xor(acc, e) & 1))))"""

ORACLE_SQL = f"""
WITH rows_ AS (SELECT conv_id, turn, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS digest,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS place FROM rows_),
convs AS (SELECT conv_id, conv_id - conv_id % {EVERY} AS base, {_CRC32.format(c="conv_id")} % {HEADS} AS head FROM (SELECT DISTINCT conv_id FROM ordered)),
rebuilt AS (SELECT c.conv_id, o.place + 1 AS depth, digest, words FROM convs c JOIN ordered o ON o.conv_id = c.base AND place < head
    UNION ALL SELECT c.conv_id, place - head + least(head, (SELECT count(*) FROM ordered b WHERE b.conv_id = c.base)) + 1, digest, words FROM convs c JOIN ordered o ON o.conv_id = c.conv_id AND place >= head),
paths AS (SELECT conv_id, 0::bigint AS depth, '' AS path, 0 AS words, NULL AS up FROM convs
    UNION ALL SELECT conv_id, depth, string_agg(digest, '') OVER w, words, substr(string_agg(digest, '') OVER w, 1, (64 * (depth - 1))::int) FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
sizes AS (SELECT conv_id, max(depth) AS size FROM paths GROUP BY conv_id),
nodes AS (SELECT depth, path, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM paths GROUP BY depth, path),
kids AS (SELECT depth - 1 AS depth, up AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
ancestors AS (SELECT n.depth, n.path, n.n_convs, n.words, k.n IS NULL AS leaf, unnest(range(0, n.depth + 1)) AS above FROM nodes n LEFT JOIN kids k USING (depth, path)),
sums AS (SELECT above AS depth, substr(path, 1, (64 * above)::int) AS path, count(*) FILTER (leaf) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens FROM ancestors GROUP BY ALL),
ends AS (SELECT p.depth, p.path, string_agg(cast(p.conv_id AS varchar), ',' ORDER BY p.conv_id) AS ids FROM paths p JOIN sizes s ON p.conv_id = s.conv_id AND p.depth = s.size GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, sums.n_leaves, cast(sums.saved_tokens AS bigint) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n JOIN sums USING (depth, path) LEFT JOIN kids USING (depth, path) LEFT JOIN ends USING (depth, path) LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = n.up
"""
