"""All queries of the core, by name, with the SQL they are compared with."""

from __future__ import annotations

from corvida.plans import archive_queries, ops_queries, orphan_queries, search_queries, stream_queries, text_queries

MODULES = [search_queries, text_queries, archive_queries, ops_queries, stream_queries, orphan_queries]
FLAGSHIP = "hybrid_search"
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}
