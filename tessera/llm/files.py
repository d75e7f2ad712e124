"""Binary files in the shared folder, written by tasks and committed through a manifest.

A task writes under a temporary name that holds its attempt's number, and returns a manifest row.  Rows
reach the manifest table only from attempts that Spark accepted, so files of lost or repeated attempts are
never read.  ``commit`` then gives each file its final name; it may be repeated at any point.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at(url: str):
    """The file system of a URL or plain path, and the path in it."""
    return pafs.FileSystem.from_uri(url)


class Output:
    """One file of one task: ``write`` counts and digests what goes out."""

    def __init__(self, folder: str, name: str):
        task = TaskContext.get()
        self.name = name
        self.temporary = f"{name}.tmp-{task.taskAttemptId() if task else 0}"
        self.fs, root = at(folder)
        self.fs.create_dir(root, recursive=True)
        self.stream = self.fs.open_output_stream(f"{root}/{self.temporary}", compression=None, buffer_size=1 << 20)
        self.size, self.digest = 0, hashlib.sha256()

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)
        self.digest.update(data)

    def close(self) -> tuple[str, str, int, str]:
        """The manifest's first columns: final name, temporary name, bytes, SHA-256."""
        self.stream.close()
        return self.name, self.temporary, self.size, self.digest.hexdigest()


MANIFEST = "name string, temporary string, bytes long, sha256 string"


def commit(scratch, manifest: DataFrame, folder: str) -> DataFrame:
    """Renames the manifest's files, in tasks; returns the manifest, read from its table, once all bear their names."""

    def rename(batches):
        fs, root = at(folder)
        for batch in batches:
            for name, temporary in zip(*(batch.column(c).to_pylist() for c in ("name", "temporary")), strict=True):
                if fs.get_file_info(f"{root}/{temporary}").type != pafs.FileType.NotFound:
                    fs.move(f"{root}/{temporary}", f"{root}/{name}")
                elif fs.get_file_info(f"{root}/{name}").type == pafs.FileType.NotFound:
                    raise FileNotFoundError(f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"name": batch.column("name")})

    done = manifest.select("name", "temporary").mapInArrow(rename, "name string")
    done.agg(F.count("*")).collect()
    return manifest


def partitions_of(df: DataFrame) -> int:
    """As many partitions as the scan behind ``df`` has: in proportion to the input's bytes."""
    return max(1, df.rdd.getNumPartitions())


def spread(manifest: DataFrame, per_task: int = 4) -> DataFrame:
    """The manifest's rows (name and more) over as many tasks as its files ask for; a given number of partitions is kept."""
    return manifest.repartition(max(1, manifest.count() // per_task), "name")


#: A table is cut into at most so many ranges.
MOST_RANGES = 1 << 16


def bucket_of(bounds: list[tuple[int, int]]) -> Column:
    """How many of the ascending bounds (id, tag) are at most (id, tag), by halving."""
    ids, tags = (F.split(F.lit(",".join(str(b[k]) for b in bounds)), ",").cast("array<bigint>") for k in (0, 1))
    steps = F.array(*[F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)])

    def reached(at: Column) -> Column:
        low, tag = F.get(ids, at), F.get(tags, at)
        return (low < F.col("id")) | ((low == F.col("id")) & (tag <= F.col("tag")))

    return F.aggregate(steps, F.lit(0), lambda acc, step: F.when((acc + step <= len(bounds)) & F.coalesce(reached(acc + step - 1), F.lit(False)), acc + step).otherwise(acc))


def even_ranges(scratch, keys: DataFrame, least: int, name: str = "ranked") -> tuple[Column, int]:
    """A range's number as a function of (id, tag), ascending, and how many ranges there are.

    ``keys`` has (id, tag, bytes).  Ranges hold ``least`` bytes each, or more where there would be too many, by running sums over all keys in order: they
    follow from the keys alone, not from partitions, samples or cores.  One row per partition and per range reaches the driver.
    """
    n, total = keys.agg(F.count("*"), F.sum("bytes")).first()
    each = max(1, least, -(-(total or 0) // MOST_RANGES))
    parts = min(MOST_RANGES, max(1, n // 500_000 + 1))
    ranked = scratch.table(keys.repartitionByRange(parts, "id", "tag").withColumn("part", F.spark_partition_id()), name)
    before, so_far = [], 0
    for r in ranked.groupBy("part").agg(F.sum("bytes").alias("bytes")).orderBy("part").collect():
        before.append((r["part"], so_far))
        so_far += r["bytes"]
    running = F.sum("bytes").over(Window.partitionBy("part").orderBy("id", "tag").rowsBetween(Window.unboundedPreceding, -1))
    number = F.floor((F.col("before") + F.coalesce(running, F.lit(0))) / each)
    ranked = ranked.join(F.broadcast(scratch.spark.createDataFrame(before, "part int, before long")), "part").withColumn("range", number)
    lows = ranked.groupBy("range").agg(F.min(F.struct("id", "tag")).alias("low")).select("low.*").distinct().orderBy("id", "tag").collect()
    return bucket_of([(r["id"], r["tag"]) for r in lows[1:]]), max(1, len(lows))
