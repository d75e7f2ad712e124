"""Tables in the shared folder, which cut lineage and outlive an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one where that is unset, as in tests on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _OWN[app]


class Scratch:
    """Intermediate tables of one operator call.

    ``table`` writes a frame as Parquet and reads it again.  On leaving the ``with`` block every table
    is removed but those named to ``keep``, on which the result still depends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessera/{uuid.uuid4().hex}"
        self.paths: dict[str, bool] = {}

    def path(self, name: str, keep: bool = False) -> str:
        self.paths[f"{self.root}/{name}"] = keep
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        path = self.path(name, keep)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.paths.pop(path, None)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in [p for p, keep in self.paths.items() if not keep]:
            self._delete(path)
