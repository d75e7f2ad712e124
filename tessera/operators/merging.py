"""Union of two archives whose keys may collide: which incoming rows are new, known, or need another key.

Tables are gone through parents first.  A row's references are rewritten by what became of its parents, and only then is the row compared: a child that
looked the same may differ once its parent has moved, and one that looked different may turn out to be known.

* A row whose natural key is known takes the known row's key; with other content it is a conflict.
* Otherwise, a row whose key is taken by equal content is skipped, and by other content gets a new key beyond all keys of both sides.
* A row whose key is free is added as it is.
* History that is frozen (its identity is part of documents and digests) is never rewritten: a row of such a table that would get another key or other references is refused.

A table that refers to itself is gone through until nothing moves any more; moved rows only ever become more.  New keys are ``top + 1 + old``, so no numbering over a whole table is needed.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.dialect import relation
from tessera.sources.scratch import Scratch


@dataclass(frozen=True)
class Table:
    """``parents``: column and the table that it refers to (itself included); ``natural``: columns that identify a row beside its key."""

    name: str
    key: str
    natural: tuple[str, ...] = ()
    parents: dict[str, str] = field(default_factory=dict)
    frozen: bool = False


#: What became of an incoming row.
HOW = ("added", "skipped", "mapped", "remapped", "conflict", "frozen")
FATES = "old_id long, new_id long, how string"


def _rewritten(rows: DataFrame, table: Table, maps: dict[str, DataFrame]) -> DataFrame:
    for column, parent in table.parents.items():
        moved = maps[parent].where("old_id <> new_id").select(F.col("old_id").alias("__old"), F.col("new_id").alias("__new"))
        rows = rows.join(moved, F.col(column) == F.col("__old"), "left").withColumn(column, F.coalesce("__new", column)).drop("__old", "__new")
    return rows


def _same(columns: list[str], a: str, b: str) -> Column:
    return reduce(Column.__and__, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns], F.lit(True))


def fates(scratch: Scratch, table: Table, base: DataFrame, incoming: DataFrame, maps: dict[str, DataFrame]) -> DataFrame:
    """(old_id, new_id, how) of each incoming row of one table, given those of its parents."""
    spark, columns = base.sparkSession, [c for c in base.columns if c != table.key]
    top = max(df.agg(F.coalesce(F.max(table.key), F.lit(0))).first()[0] for df in (base, incoming))
    known = base.select(F.col(table.key).alias("known_id"), F.struct(*columns).alias("b"))
    maps = maps | {table.name: spark.createDataFrame([], FATES)} if table.name in table.parents.values() else maps
    before, turn = -1, 0
    while True:
        rows = _rewritten(incoming, table, maps).select(F.col(table.key).alias("old_id"), F.struct(*columns).alias("a"))
        if table.natural:
            named = base.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in table.natural])).select(*[F.col(c).alias(f"__{c}") for c in table.natural], F.col(table.key).alias("named_id"), F.struct(*columns).alias("m"))
            rows = rows.join(named, reduce(Column.__and__, [F.col(f"a.{c}") == F.col(f"__{c}") for c in table.natural]), "left")
        else:
            rows = rows.withColumns({"named_id": F.lit(None).cast("long"), "m": F.lit(None).cast(known.schema["b"].dataType)})
        rows = rows.join(known, F.col("old_id") == F.col("known_id"), "left")
        of_name = F.when(~_same(columns, "a", "m"), "conflict").when(F.col("named_id") == F.col("old_id"), "skipped").otherwise("mapped")
        how = F.when(F.col("named_id").isNotNull(), of_name).when(F.col("known_id").isNull(), "added").when(_same(columns, "a", "b"), "skipped").otherwise("remapped")
        new_id = F.when(F.col("named_id").isNotNull(), F.col("named_id")).when(how == "remapped", F.col("old_id") + top + 1).otherwise(F.col("old_id"))
        out = scratch.table(rows.select("old_id", new_id.alias("new_id"), how.alias("how")), f"{table.name}-{turn}", keep=True)
        if table.name not in maps:
            break
        moved = out.where("old_id <> new_id").count()
        if moved == before:
            break
        maps, before, turn = maps | {table.name: out}, moved, turn + 1
    if table.frozen:
        touched = _rewritten(incoming, table, maps).select(table.key, F.struct(*columns).alias("now")).join(incoming.select(F.col(table.key), F.struct(*columns).alias("then")), table.key).where(~F.col("now").eqNullSafe(F.col("then"))).select(F.col(table.key).alias("old_id"), F.lit(True).alias("touched"))
        refused = F.col("how").isin("mapped", "remapped") | F.coalesce("touched", F.lit(False))
        out = out.join(touched, "old_id", "left").select("old_id", "new_id", F.when(refused, "frozen").otherwise(F.col("how")).alias("how"))
    return out


def plan(scratch: Scratch, tables: list[Table], base: dict[str, DataFrame], incoming: dict[str, DataFrame]) -> DataFrame:
    """(table_name, old_id, new_id, how) of every incoming row; ``tables`` has parents first."""
    maps: dict[str, DataFrame] = {}
    for t in tables:
        if late := [p for p in t.parents.values() if p != t.name and p not in maps]:
            raise ValueError(f"{t.name} comes before its parents {late}")
        maps[t.name] = scratch.table(fates(scratch, t, base[t.name], incoming[t.name], maps), f"fates-{t.name}", keep=True)
    return reduce(DataFrame.unionByName, [df.withColumn("table_name", F.lit(name)) for name, df in maps.items()]).select("table_name", "old_id", "new_id", "how")


def merged(scratch: Scratch, tables: list[Table], base: dict[str, DataFrame], incoming: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The united tables; a ValueError names the tables with conflicts or refused rows, and then nothing is united."""
    fate = scratch.table(plan(scratch, tables, base, incoming), "plan", keep=True)
    bad = sorted((r["table_name"], r["how"]) for r in fate.where(F.col("how").isin("conflict", "frozen")).select("table_name", "how").distinct().collect())
    if bad:
        raise ValueError(f"not merged: {', '.join(f'{how} rows in {name}' for name, how in bad)}")
    maps = {t.name: fate.where(F.col("table_name") == t.name).drop("table_name") for t in tables}
    out = {}
    for t in tables:
        new = maps[t.name].where(F.col("how").isin("added", "remapped")).select("old_id", F.col("new_id").alias("__key"))
        rows = _rewritten(incoming[t.name], t, maps).join(new, F.col(t.key) == F.col("old_id")).withColumn(t.key, F.col("__key")).drop("old_id", "__key")
        out[t.name] = base[t.name].unionByName(rows)
    return out


# ----------------------------------------------------------------------------------------------- registered queries

TABLES = [
    Table("creators", "mid", ("display_name",)),
    Table("videos", "video_id", ("video_code",), {"mid": "creators"}),
    Table("parts", "part_id", ("video_id", "page"), {"video_id": "videos"}),
    Table("jobs", "job_id", (), {"part_id": "parts", "repair_of": "jobs"}),
    Table("transcripts", "transcript_id", (), {"part_id": "parts"}, frozen=True),
]
NAMES = {"creators": "own_creators", "videos": "own_videos", "parts": "own_parts", "jobs": "own_jobs", "transcripts": "own_transcripts"}


def key_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-07: what becomes of each row of a second archive with other creators, moved videos and re-used keys."""
    with Scratch(spark) as s:
        base, incoming = ({n: s.table(relation(spark, sf_dir, NAMES[n].replace("own", side)), f"{side}-{n}") for n in NAMES} for side in ("own", "their"))
        return plan(s, TABLES, base, incoming)


def _moved(name: str, alias: str) -> str:
    return f"LEFT JOIN (SELECT old_id, new_id FROM {name}_fate WHERE old_id <> new_id) AS {alias}"


def _level(name: str, key: str, columns: list[str], natural: list[str], rows: str) -> str:
    """A table's fates in the oracle's SQL; ``rows`` selects the rewritten rows."""
    same = lambda x, y: " AND ".join(f"{x}.{c} IS NOT DISTINCT FROM {y}.{c}" for c in columns)
    named = f"LEFT JOIN own_{name} AS m ON {' AND '.join(f'a.{c} = m.{c}' for c in natural)}" if natural else f"LEFT JOIN own_{name} AS m ON FALSE"
    how = f"CASE WHEN m.{key} IS NOT NULL THEN CASE WHEN NOT ({same('a', 'm')}) THEN 'conflict' WHEN m.{key} = a.{key} THEN 'skipped' ELSE 'mapped' END WHEN b.{key} IS NULL THEN 'added' WHEN {same('a', 'b')} THEN 'skipped' ELSE 'remapped' END"
    top = f"greatest((SELECT max({key}) FROM own_{name}), (SELECT max({key}) FROM their_{name}))"
    return f"""{name}_rows AS ({rows}), {name}_fate AS (SELECT old_id, how, CASE WHEN how IN ('conflict', 'mapped') THEN named_id WHEN how = 'remapped' THEN old_id + {top} + 1 ELSE old_id END AS new_id FROM
        (SELECT a.{key} AS old_id, m.{key} AS named_id, {how} AS how FROM {name}_rows AS a {named} LEFT JOIN own_{name} AS b ON b.{key} = a.{key}) AS x)"""


_JOBS = ["kind", "part_id", "status"]
_JOBS_SAME = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in _JOBS)
_SQL = f"""WITH RECURSIVE {_level("creators", "mid", ["display_name"], ["display_name"], "SELECT * FROM their_creators")},
    {_level("videos", "video_id", ["video_code", "mid", "title"], ["video_code"], f"SELECT video_id, video_code, coalesce(p.new_id, mid) AS mid, title FROM their_videos {_moved('creators', 'p')} ON p.old_id = mid")},
    {_level("parts", "part_id", ["video_id", "page", "status"], ["video_id", "page"], f"SELECT part_id, coalesce(p.new_id, video_id) AS video_id, page, status FROM their_parts {_moved('videos', 'p')} ON p.old_id = video_id")},
    jobs_rows AS (SELECT job_id, kind, coalesce(p.new_id, part_id) AS part_id, status, repair_of FROM their_jobs {_moved("parts", "p")} ON p.old_id = part_id),
    jobs_moved AS (SELECT a.job_id FROM jobs_rows AS a JOIN own_jobs AS b ON a.job_id = b.job_id WHERE NOT ({_JOBS_SAME} AND a.repair_of IS NOT DISTINCT FROM b.repair_of)
        UNION SELECT a.job_id FROM jobs_moved AS m JOIN jobs_rows AS a ON a.repair_of = m.job_id JOIN own_jobs AS b ON b.job_id = a.job_id),
    jobs_fate AS (SELECT a.job_id AS old_id, CASE WHEN m.job_id IS NOT NULL THEN 'remapped' WHEN b.job_id IS NULL THEN 'added' ELSE 'skipped' END AS how,
        CASE WHEN m.job_id IS NOT NULL THEN a.job_id + greatest((SELECT max(job_id) FROM own_jobs), (SELECT max(job_id) FROM their_jobs)) + 1 ELSE a.job_id END AS new_id
        FROM jobs_rows AS a LEFT JOIN own_jobs AS b ON b.job_id = a.job_id LEFT JOIN jobs_moved AS m ON m.job_id = a.job_id),
    {_level("transcripts", "transcript_id", ["part_id", "sha"], [], f"SELECT transcript_id, coalesce(p.new_id, part_id) AS part_id, sha FROM their_transcripts {_moved('parts', 'p')} ON p.old_id = part_id")},
    frozen AS (SELECT f.old_id, f.new_id, CASE WHEN how IN ('mapped', 'remapped') OR r.part_id IS DISTINCT FROM t.part_id THEN 'frozen' ELSE how END AS how FROM transcripts_fate AS f JOIN transcripts_rows AS r ON r.transcript_id = f.old_id JOIN their_transcripts AS t ON t.transcript_id = f.old_id)
    SELECT 'creators' AS table_name, old_id, new_id, how FROM creators_fate UNION ALL SELECT 'videos', old_id, new_id, how FROM videos_fate UNION ALL SELECT 'parts', old_id, new_id, how FROM parts_fate
    UNION ALL SELECT 'jobs', old_id, new_id, how FROM jobs_fate UNION ALL SELECT 'transcripts', old_id, new_id, how FROM frozen"""

QUERIES = {"G-07_key_fixpoint": key_fixpoint}
ORACLES = {"G-07_key_fixpoint": _SQL}
