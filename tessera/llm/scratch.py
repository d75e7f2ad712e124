"""Small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import Scratch, shared_dir

__all__ = ["NO_ID", "Scratch", "given", "held", "let", "shared_dir", "table", "unused"]

#: Stands for a null id inside operators, where ids are joined or stored as numbers.
NO_ID = -(1 << 63)


def held(key: str | Column) -> Column:
    return F.coalesce(F.col(key) if isinstance(key, str) else key, F.lit(NO_ID))


def given(key: str | Column) -> Column:
    return F.nullif(F.col(key) if isinstance(key, str) else key, F.lit(NO_ID))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, whatever its columns are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body).getItem(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
