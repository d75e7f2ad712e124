"""Snapshot chains: full and delta packages, and chains that are refused."""

import os
import shutil

import pytest

from tessera.sources.scratch import Scratch
from tessera.sources.snapshots import BrokenChain, SnapshotChain


def tables(spark, items, tags):
    return {"items": (spark.createDataFrame(items, "id long, text string, at double"), "id"), "tags": (spark.createDataFrame(tags, "tag string, n int"), "tag")}


STATES = [
    ([(1, "a", 1.5), (2, None, None), (3, "", 0.0)], [("x", 1), ("y", None)]),
    ([(1, "a", 1.5), (2, "", None), (4, "new", 2.0)], [("x", 1), ("y", None)]),
    ([(1, "b", 1.5), (3, "back", 0.0), (4, "new", 2.0)], []),
]


def held(found):
    return [sorted((tuple(r) for r in found[n].collect()), key=repr) for n in ("items", "tags")]


@pytest.fixture
def chain(spark):
    with Scratch(spark) as s:
        chain = SnapshotChain(spark, s.path("chain"))
        yield chain, [chain.save(tables(spark, *state)) for state in STATES]


def test_every_state_comes_back_and_deltas_hold_changes_only(chain):
    chain, manifests = chain
    for k, state in enumerate(STATES):
        assert held(chain.materialise(k)) == [sorted(rows, key=repr) for rows in state]
    assert held(chain.materialise()) == held(chain.materialise(2))
    assert [(m["tables"]["items"]["rows"][0], m["tables"]["items"]["gone"]) for m in manifests] == [(3, 0), (2, 1), (2, 1)]
    assert [(m["tables"]["tags"]["rows"][0], m["tables"]["tags"]["gone"]) for m in manifests] == [(2, 0), (0, 0), (0, 2)]
    assert [m["parent"] for m in manifests] == [None, manifests[0]["name"], manifests[1]["name"]]


def local(path):
    return path.removeprefix("file://")


def test_a_gap_or_a_changed_base_is_refused(chain, spark):
    chain, manifests = chain
    at = local(f"{chain.path}/manifests/000001")
    shutil.move(at, at + ".away")
    shutil.move(at + ".away", f"{local(chain.path)}/away")
    with pytest.raises(BrokenChain, match="does not follow"):
        chain.materialise()
    shutil.move(f"{local(chain.path)}/away", at)
    os.remove(os.path.join(os.path.dirname(at), ".000001.crc")) if os.path.exists(os.path.join(os.path.dirname(at), ".000001.crc")) else None
    rows = f"{manifests[0]['folder']}/rows/items"
    changed = [tuple(r) for r in spark.read.parquet(rows).replace("a", "A", "text").collect()]
    spark.createDataFrame(changed, spark.read.parquet(rows).schema).write.mode("overwrite").parquet(rows)
    with pytest.raises(BrokenChain, match="were changed"):
        chain.materialise(0)


def test_a_changed_manifest_is_refused(chain):
    chain, _ = chain
    at = local(f"{chain.path}/manifests/000000")
    text = open(at).read().replace('"gone": 0', '"gone": 7', 1)
    open(at, "w").write(text)
    crc = os.path.join(os.path.dirname(at), ".000000.crc")
    if os.path.exists(crc):
        os.remove(crc)
    with pytest.raises(BrokenChain, match="manifest"):
        chain.manifests()


def test_a_save_that_was_killed_is_not_read(chain, spark):
    chain, _ = chain
    spark.createDataFrame([(1, "x")], "a int, b string").write.parquet(f"{chain.path}/packages/3-killed/rows/items")
    assert len(chain.manifests()) == 3 and chain.materialise()["items"].count() == 3


def test_what_cannot_be_saved(spark):
    with Scratch(spark) as s:
        chain = SnapshotChain(spark, s.path("chain"))
        with pytest.raises(BrokenChain):
            chain.materialise()
        with pytest.raises(ValueError, match="several rows"):
            chain.save(tables(spark, [(1, "a", 0.0), (1, "b", 0.0)], []))
        chain.save(tables(spark, [], []))
        with pytest.raises(ValueError, match="keeps its tables"):
            chain.save({"items": tables(spark, [], [])["items"]})
        assert held(chain.materialise()) == [[], []]
