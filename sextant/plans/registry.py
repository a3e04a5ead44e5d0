"""Every query of the engine, with the SQL that must give the same rows."""

from __future__ import annotations

from sextant.plans import graphs, reads, record_queries, retrieval, selection, statistics, texts, upkeep

MODULES = (statistics, selection, texts, retrieval, graphs, record_queries, upkeep, reads)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
FLAGSHIP = "hybrid_search"
