"""Every archive query that has SQL, against DuckDB on the smallest tables."""

import numbers
import os

import duckdb
import pytest

from tessera.plans.catalog import ORACLE_SQL, QUERIES
from tessera.plans.dialect import TABLES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(frame):
    def plain(v):
        if v is None or v != v:
            return None
        if isinstance(v, numbers.Number) and not isinstance(v, bool):
            v = float(v)
            return int(v) if v == int(v) else round(v, 9)
        return bool(v) if type(v).__name__ == "bool_" else v

    frame = frame.astype(object).where(frame.notna(), None)
    return sorted((tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["Q-01_pending_subtitles", "Q-05_pipeline_state", "J-10_overlap_pairs", "W-08_preferred_transcript"])
def test_no_nested_loop_where_there_is_a_key(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
