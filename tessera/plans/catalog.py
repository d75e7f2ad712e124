"""The registered archive queries and their SQL."""

from __future__ import annotations

import tessera.sources.adapters  # noqa: F401  (defines the relations)
from tessera.functions import alignment, chunking, quality, sequences, text
from tessera.operators import gates, graph, hotwords, intervals, leases, merging, packing, ranking, retries, search
from tessera.operators.statements import STATEMENTS
from tessera.sources import exports, snapshots
from tessera.sources.shipping import shipped
from tessera.streaming import jobs

from .dialect import oracle_query, spark_query

QUERIES = {name: spark_query(sql) for name, sql in STATEMENTS.items()}
ORACLE_SQL = {name: oracle_query(sql) for name, sql in STATEMENTS.items()}
for _module in (gates, graph, hotwords, intervals, leases, merging, packing, ranking, retries, search, text, quality, alignment, chunking, sequences, jobs, exports, snapshots):
    QUERIES |= {name: shipped(query) for name, query in _module.QUERIES.items()}
    ORACLE_SQL |= {name: oracle_query(sql) for name, sql in _module.ORACLES.items()}
