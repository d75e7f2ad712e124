"""The work of packing: shared relations are made once, and the graph has objects, not copies, as its nodes."""

import pytest

from tessera.operators import graph, packing
from tessera.plans.catalog import QUERIES
from tessera.sources.scratch import Scratch

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("priority", packing.PRIORITIES)
def test_lineitem_is_read_once(spark, monkeypatch, priority):
    read, write = [], Scratch.table

    def table(self, df, name, keep=False):
        if "lineitem" in df._jdf.queryExecution().optimizedPlan().toString() or "l_partkey" in df._jdf.queryExecution().optimizedPlan().toString():
            read.append(name)
        return write(self, df, name, keep)

    monkeypatch.setattr(Scratch, "table", table)
    assert QUERIES[f"G-08_batch_{priority}"](spark, DATA).count() > 0
    assert read == ["replicas"]


def test_an_objects_copies_are_one_node(spark, monkeypatch):
    nodes, label = [], graph.min_labels
    monkeypatch.setattr(packing, "min_labels", lambda s, links, *a: (nodes.append(links.select("a").distinct().count()), label(s, links, *a))[1])
    copies = [(100 * o + t, o, 10, 0) for o in range(9) for t in range(20)]
    with Scratch(spark) as s:
        out = packing.components(s, spark.createDataFrame(copies, "copy_id long, object_id long, byte_size long, modified long"), spark.createDataFrame([(o, o // 3) for o in range(8)], "object_id long, group_id long"))
        assert {(r["object_id"], r["component"]) for r in out.where("object_id < 8").collect()} == {(o, o // 3 * 300) for o in range(8)}
        assert out.where("object_id = 8 AND component = copy_id").count() == 20
    assert nodes == [8]


def test_a_copy_of_several_objects_connects_them(spark):
    """Copy 5 is of objects 1 and 3, copy 9 of one with a group and one without."""
    copies = [(4, 1, 10, 0), (5, 1, 10, 0), (5, 3, 20, 0), (6, 3, 20, 0), (8, 4, 5, 0), (9, 4, 5, 0), (9, 7, 5, 0), (11, 7, 5, 0)]
    groups = [(1, 1), (3, 2), (4, 5)]
    with Scratch(spark) as s:
        out = packing.components(s, spark.createDataFrame(copies, "copy_id long, object_id long, byte_size long, modified long"), spark.createDataFrame(groups, "object_id long, group_id long"))
        got = sorted((r["copy_id"], r["object_id"], r["component"]) for r in out.collect())
    assert got == [(4, 1, 4), (5, 1, 4), (5, 3, 4), (6, 3, 4), (8, 4, 8), (9, 4, 8), (9, 7, 8), (11, 7, 11)]
