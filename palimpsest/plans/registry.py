"""All queries of the core, and their DuckDB equivalents."""

from . import audit_queries, detail_queries, graph_queries, listing_queries, loop_queries, search_queries, training, transcript_queries, write_queries

_PARTS = (training, audit_queries, graph_queries, listing_queries, search_queries, transcript_queries, write_queries, loop_queries, detail_queries)
QUERIES = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
ORACLES = {k: s for p in _PARTS for k, s in p.ORACLES.items()}
