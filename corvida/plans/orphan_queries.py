"""Queries of problem 4 and their SQL."""

from __future__ import annotations

from corvida.operators import orphans
from corvida.session import load


def p4_found(spark, d):
    refs = orphans.archive_references(load(spark, d, "evidence_pointers"), load(spark, d, "object_findings"))
    known = orphans.archive_parents(load(spark, d, "chunks"), load(spark, d, "raw_objects"), load(spark, d, "commits"))
    return orphans.find_orphans(refs, known)


def p4_report(spark, d):
    return orphans.count_orphans(p4_found(spark, d))


FOUND_SQL = """
WITH refs AS (
  SELECT 'evidence_pointers' AS ref_table, 'chunk_hash' AS ref_field, pointer_id AS ref_rowid, scope_id, chunk_hash AS ref_key, cited_at AS at_time FROM evidence_pointers
  UNION ALL SELECT 'evidence_pointers', 'raw_hash', pointer_id, scope_id, raw_hash, cited_at FROM evidence_pointers
  UNION ALL SELECT 'evidence_pointers', 'commit_hash', pointer_id, scope_id, commit_hash, cited_at FROM evidence_pointers
  UNION ALL SELECT 'object_findings', 'affected_commits', finding_id, scope_id, unnest(affected_commits), found_at FROM object_findings),
known AS (
  SELECT 'chunk_hash' AS ref_field, scope_id, chunk_hash AS ref_key, min(stored_at) AS first_stored, false AS gone FROM chunks GROUP BY 2, 3
  UNION ALL SELECT 'raw_hash', scope_id, raw_hash, min(stored_at), bool_or(coalesce(lifecycle_kind IN ('purged', 'erased'), false)) FROM raw_objects GROUP BY 2, 3
  UNION ALL SELECT 'commit_hash', scope_id, commit_hash, min(stored_at), false FROM commits GROUP BY 2, 3
  UNION ALL SELECT 'affected_commits', scope_id, commit_hash, min(stored_at), false FROM commits GROUP BY 2, 3)
SELECT DISTINCT r.ref_table, r.ref_field, strftime(r.at_time, '%Y-%m') AS ref_month, r.ref_rowid, r.ref_key
FROM refs r LEFT JOIN known k ON k.ref_field = r.ref_field AND k.scope_id = r.scope_id AND k.ref_key = r.ref_key
WHERE r.ref_key IS NOT NULL AND r.ref_key <> '' AND (k.ref_key IS NULL OR k.gone OR k.first_stored > r.at_time)
"""

QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
SQL = {
    "p4_found": FOUND_SQL,
    "p4_report": f"SELECT ref_table, ref_field, ref_month, count(*) AS n_refs, count(DISTINCT ref_key) AS n_keys FROM ({FOUND_SQL}) GROUP BY 1, 2, 3",
}
