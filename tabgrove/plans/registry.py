"""All registered queries of the library and the SQL of each."""

from __future__ import annotations

from tabgrove.plans import oracles, queries, table_queries, tuning_queries

QUERIES = {**queries.QUERIES, **table_queries.QUERIES, **tuning_queries.QUERIES}
ORACLES = {**oracles.ORACLES, **table_queries.ORACLES, **tuning_queries.ORACLES}
