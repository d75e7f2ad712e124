"""Snapshots of tables as a chain of content-addressed packages: one full, then what changed.

A package holds, for each table, the rows that are new or changed since its parent and the keys that are gone, with a manifest: its number, its parent's name,
fingerprints of what it holds, and fingerprints of the tables that the chain gives up to it.  Its name is the digest of all that, so a package names all of its ancestors.
``materialise`` replays a chain and refuses one with a gap, with another parent, or with rows that are not those that were saved.

Rows are compared by key and a hash of all columns with their types; a delta is a join of the new tables' hashes with those of the chain, which are read from
the packages' hash columns alone.  A package counts once its manifest stands; what a killed save wrote is never read.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.dialect import relation
from tessera.sources.scratch import Scratch

HASH, KEY = "__row_hash", "__row_key"


class BrokenChain(ValueError):
    """A chain that can't be replayed as it was saved."""


def row_hash(df: DataFrame) -> Column:
    """The digest of a row: all columns by name, with their types and with nulls apart from texts."""
    parts = [F.concat_ws(":", F.lit(f"{c} {t}"), F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("="), F.to_json(F.struct(F.col(c).alias("v")))))) for c, t in sorted(df.dtypes)]
    return F.sha2(F.to_json(F.array(*parts)), 256)


def fingerprint(hashes: DataFrame) -> list[int]:
    """[rows, sum] of a column of row hashes, whatever their order: sums of their first 60 bits."""
    head = F.conv(F.substring(HASH, 1, 15), 16, 10).cast("decimal(38,0)")
    n, total = hashes.agg(F.count("*"), F.coalesce(F.sum(head), F.lit(0))).first()
    return [n, int(total)]


class SnapshotChain:
    """Packages in a shared folder; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifests(self) -> list[dict]:
        """The chain in order; a gap in its numbers or names is refused."""
        at, fs = self._fs(f"{self.path}/manifests")
        if not fs.exists(at):
            return []
        found = sorted((json.loads(r["value"]) for r in self.spark.read.text(f"{self.path}/manifests").collect()), key=lambda m: m["number"])
        parent = None
        for k, m in enumerate(found):
            if m["number"] != k or m["parent"] != parent:
                raise BrokenChain(f"package {m['number']} does not follow package {k - 1}")
            if m["name"] != self._name(m):
                raise BrokenChain(f"the manifest of package {k} was changed")
            parent = m["name"]
        return found

    @staticmethod
    def _name(manifest: dict) -> str:
        return hashlib.sha256(json.dumps({k: v for k, v in manifest.items() if k != "name"}, sort_keys=True).encode()).hexdigest()

    def save(self, tables: dict[str, tuple[DataFrame, str | list[str]]]) -> dict:
        """Adds a package that brings the chain to these tables, each with its key, a column or several; returns its manifest."""
        before = self.manifests()
        if before and set(before[-1]["tables"]) != set(tables):
            raise ValueError("a chain keeps its tables")
        folder, held = f"{self.path}/packages/{len(before)}-{uuid.uuid4().hex}", {}
        for name, (df, key) in tables.items():
            hashed = df.withColumn(KEY, F.col(key).cast("string") if isinstance(key, str) else F.to_json(F.struct(*key))).withColumn(HASH, row_hash(df))
            old = self._hashes(before, name) if before else None
            if old is None:
                changed, gone = hashed, self.spark.createDataFrame([], f"{KEY} string")
            else:
                changed = hashed.join(old, [KEY, HASH], "left_anti")
                gone = old.join(hashed.select(KEY), KEY, "left_anti").select(KEY)
            changed.write.option("compression", "zstd").parquet(f"{folder}/rows/{name}")
            gone.write.parquet(f"{folder}/gone/{name}")
            rows = self.spark.read.parquet(f"{folder}/rows/{name}")
            if repeated := rows.groupBy(KEY).count().where("count > 1").limit(1).collect():
                raise ValueError(f"{name} has several rows of key {repeated[0][KEY]}")
            held[name] = {"key": key, "rows": fingerprint(rows), "gone": self.spark.read.parquet(f"{folder}/gone/{name}").count(), "state": fingerprint(hashed)}
        manifest = {"number": len(before), "parent": before[-1]["name"] if before else None, "folder": folder, "tables": held}
        manifest["name"] = self._name(manifest)
        self._write(manifest)
        return manifest

    def _write(self, manifest: dict) -> None:
        final, fs = self._fs(f"{self.path}/manifests/{manifest['number']:06d}")
        written, _ = self._fs(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(written, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(written, final):
            raise BrokenChain(f"package {manifest['number']} was saved by another writer")

    def _changes(self, chain: list[dict], name: str, *columns: str) -> DataFrame:
        """Of each key the newest change: ``columns`` of its row, or none where it is gone."""
        out = None
        for m in chain:
            rows = self.spark.read.parquet(f"{m['folder']}/rows/{name}").select(KEY, *columns, F.lit(m["number"]).alias("number"), F.lit(True).alias("there"))
            gone = self.spark.read.parquet(f"{m['folder']}/gone/{name}").select(KEY, F.lit(m["number"]).alias("number"), F.lit(False).alias("there"))
            part = rows.unionByName(gone, allowMissingColumns=True)
            out = part if out is None else out.unionByName(part)
        newest = Window.partitionBy(KEY).orderBy(F.desc("number"))
        return out.withColumn("nth", F.row_number().over(newest)).where("nth = 1 AND there").drop("nth", "there", "number")

    def _hashes(self, chain: list[dict], name: str) -> DataFrame:
        return self._changes(chain, name, HASH)

    def materialise(self, upto: int | None = None) -> dict[str, DataFrame]:
        """The tables after package ``upto``, or after the last one, once every package and the result are what was saved."""
        chain = self.manifests()
        chain = chain if upto is None else chain[: upto + 1]
        if not chain or upto is not None and len(chain) <= upto:
            raise BrokenChain("there is no such package")
        out = {}
        for name in chain[-1]["tables"]:
            for m in chain:
                rows = self.spark.read.parquet(f"{m['folder']}/rows/{name}")
                own = rows.withColumn(HASH, row_hash(rows.drop(KEY, HASH)))
                if fingerprint(own) != m["tables"][name]["rows"] or not rows.select(HASH).exceptAll(own.select(HASH)).isEmpty():
                    raise BrokenChain(f"rows of {name} in package {m['number']} were changed")
            columns = [c for c in self.spark.read.parquet(f"{chain[-1]['folder']}/rows/{name}").columns if c not in (KEY, HASH)]
            state = self._changes(chain, name, HASH, *columns)
            if fingerprint(state) != chain[-1]["tables"][name]["state"]:
                raise BrokenChain(f"{name} is not what was saved")
            out[name] = state.select(*columns)
        return out


# ----------------------------------------------------------------------------------------------- registered queries


def replayed_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-21: videos saved in three states, and what the chain gives after the second and the third.

    Their moved ids can be those of other videos, whose codes differ, so the key is both."""
    columns = ["video_id", "video_code", "mid", "title"]
    with Scratch(spark) as s:
        chain = SnapshotChain(spark, s.path("chain", keep=True))
        for name in ("own_videos", "their_videos", "videos"):
            chain.save({"videos": (relation(spark, sf_dir, name).select(*columns), ["video_id", "video_code"])})
    states = [chain.materialise(k)["videos"].withColumn("package", F.lit(k)) for k in (1, 2)]
    return states[0].unionByName(states[1])


QUERIES = {"S-21_replayed_videos": replayed_videos}
ORACLES = {"S-21_replayed_videos": "SELECT video_id, video_code, mid, title, 1 AS package FROM their_videos UNION ALL SELECT video_id, video_code, mid, title, 2 AS package FROM videos"}
