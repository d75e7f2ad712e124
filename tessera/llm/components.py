"""Connected components by alternating stars, on tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _contract(batches):
    """The links of one partition as stars to the smallest node that is reachable within it."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(up, up)
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    for k in range(0, len(nodes), 100_000):
        some = nodes[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(some, np.int64)), pa.array(np.array([root(x) for x in some], np.int64))], names=["a", "b"])


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """(node, label) of every node of the links (a, b): the smallest node of its component.

    Links of a partition are contracted first; the stars are then made to converge by joins and sums with partial
    aggregation, so no node's links need to be together.
    """
    edges = scratch.table(links.select("a", "b").mapInArrow(_contract, "a long, b long").distinct(), f"{name}_0")
    before, k = None, 0
    while True:
        k += 1
        # Large star: larger neighbours go to the smallest neighbour.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: smaller neighbours and the node itself go to the smallest of them.
        large = scratch.table(large.where("a <> b").distinct(), f"{name}_{k}_large")
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b")
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        scratch.drop(f"{name}_{k - 1}")
        edges = scratch.table(small, f"{name}_{k}")
        scratch.drop(f"{name}_{k}_large")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.countDistinct("a")).first()
        # Stars: every node has one link, to a node that has none.
        if state[0] == 0 or (state == before and state[0] == state[2]):
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
