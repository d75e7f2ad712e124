"""The package itself, sent to the executors, so that a session can be started from anywhere."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session's Python files, once."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))  # Spark serves it to the executors
    _SENT.add(context.applicationId)


def shipped(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @functools.wraps(function)
    def run(spark: SparkSession, *arguments) -> DataFrame:
        ship(spark)
        return function(spark, *arguments)

    return run
