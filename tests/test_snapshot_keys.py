"""Chains of tables whose key is several columns."""

import pytest

from tessera.plans.catalog import QUERIES
from tessera.sources.scratch import Scratch
from tessera.sources.snapshots import SnapshotChain


def test_a_key_of_two_columns(spark):
    states = [[(1, "a", 0), (1, "b", 0), (2, None, 0)], [(1, "a", 1), (2, None, 0), (2, "b", 5)]]
    make = lambda rows: {"t": (spark.createDataFrame(rows, "id long, code string, n int"), ["id", "code"])}
    with Scratch(spark) as s:
        chain = SnapshotChain(spark, s.path("chain"))
        manifests = [chain.save(make(rows)) for rows in states]
        for k, rows in enumerate(states):
            assert sorted(map(tuple, chain.materialise(k)["t"].collect()), key=repr) == sorted(rows, key=repr)
        assert (manifests[1]["tables"]["t"]["rows"][0], manifests[1]["tables"]["t"]["gone"]) == (2, 1)
        with pytest.raises(ValueError, match="several rows"):
            chain.save(make([(3, "a", 1), (3, "a", 2)]))


def test_moved_ids_that_others_have(spark, tmp_path):
    """Orders whose ids pass those that the second archive moves."""
    orders = [(k, 1, "O", "2-HIGH") for k in (3, 16, 1_000_003, 1_000_016, 1_000_017)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").selectExpr("*", "timestamp'2000-01-01' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["S-21_replayed_videos"](spark, str(tmp_path)).groupBy("package").count().collect()
    from tessera.plans.dialect import relation

    theirs = relation(spark, str(tmp_path), "their_videos")
    assert theirs.count() > theirs.select("video_id").distinct().count()
    assert {r["package"]: r["count"] for r in got} == {1: theirs.count(), 2: 5}
