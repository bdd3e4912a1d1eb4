"""Registered queries and their SQL oracles."""

from lodestate.plans import observed, oracles, queries, serving, topology, typed

FLAGSHIP = "state_versions"
QUERIES = queries.QUERIES | typed.QUERIES | observed.QUERIES | serving.QUERIES | topology.QUERIES
ORACLE_SQL = oracles.ORACLE_SQL | typed.ORACLE_SQL | observed.ORACLE_SQL | serving.ORACLE_SQL | topology.ORACLE_SQL

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
