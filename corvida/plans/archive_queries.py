"""Queries on history and life cycle, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvida.operators import history, lifecycle
from corvida.session import load


def _commits(spark, d):
    return load(spark, d, "commits").dropDuplicates(["commit_hash"])


def _heads(commits):
    return commits.join(history.edges(commits).select(F.col("parent").alias("commit_hash")), "commit_hash", "left_anti").select("commit_hash")


def _bindings(spark, d):
    p = load(spark, d, "evidence_pointers").where("commit_hash <> '' and raw_hash <> '' and path_at_commit is not null")
    return p.select("scope_id", "commit_hash", F.col("path_at_commit").alias("path"), "raw_hash").distinct()


def first_parent_walk(spark, d):
    c = _commits(spark, d)
    w = history.walk(_heads(c), history.first_parents(c))
    return w.groupBy("start").agg(F.max("depth").alias("longest"), F.count("*").alias("commits"), F.min("commit").alias("least"))


def all_parent_closure(spark, d):
    c = _commits(spark, d)
    return history.closure(_heads(c), history.edges(c)).groupBy("start").agg(F.count("*").alias("reachable"), F.max("commit").alias("greatest"))


def introductions(spark, d):
    """Ancestor-most introductions of each binding; canonical is the smallest hash among them."""
    c = _commits(spark, d)
    b = history.ancestor_most(history.introductions(_bindings(spark, d), history.edges(c)), c)
    return b.groupBy("path", "raw_hash").agg(F.count("*").alias("n"), F.min("commit_hash").alias("canonical"))


def newest_bindings(spark, d):
    c = _commits(spark, d)
    return history.newest_bindings(_bindings(spark, d), history.walk(_heads(c), history.first_parents(c)))


def _profiled(spark, d):
    """commit_hash, path, raw_hash, tool_profile_hash, gen; a pointer without a chunk names content that was not normalised."""
    p = load(spark, d, "evidence_pointers").where("commit_hash <> '' and raw_hash <> '' and path_at_commit is not null")
    profile = F.when(F.coalesce("chunk_hash", F.lit("")) != "", F.col("tool_profile_hash"))
    return p.select("commit_hash", F.col("path_at_commit").alias("path"), "raw_hash", profile.alias("tool_profile_hash"), F.col("schema_version").alias("gen")).distinct()


def plan_current(spark, d):
    c = _commits(spark, d)
    return history.plan(_profiled(spark, d), c, "current", _heads(c))


def plan_all_history(spark, d):
    c = _commits(spark, d)
    return history.plan(_profiled(spark, d), c, "all_history", _heads(c))


def plan_include_deleted(spark, d):
    c = _commits(spark, d)
    return history.plan(_profiled(spark, d), c, "include_deleted", _heads(c))


def alias_expansion(spark, d):
    """The most cited object of each scope as a ranked hit, with every path and commit its content has."""
    p = _bindings(spark, d)
    top = p.groupBy("scope_id").agg(F.max_by("raw_hash", F.struct(F.lit(1), "raw_hash")).alias("raw_hash"))
    ranked = top.select(F.lit("q").alias("query_id"), F.row_number().over(Window.partitionBy(F.lit("q")).orderBy("scope_id")).alias("rank"), "raw_hash")
    return history.aliases(ranked, p, ["raw_hash"]).select("rank", "path", "commit_hash", "alias_no")


def _tips_and_roots(spark, d):
    c = _commits(spark, d)
    e = c.where("scope_id is not null").groupBy("scope_id").agg(F.min_by("commit_hash", F.struct("created_at", "commit_hash")).alias("old"), F.max_by("commit_hash", F.struct("created_at", "commit_hash")).alias("new"), F.min("commit_hash").alias("some"))
    pair = lambda a, b: F.struct(F.col(a).alias("ancestor"), F.col(b).alias("descendant"))
    return e.select(F.explode(F.array(pair("old", "new"), pair("new", "old"), pair("some", "new"), pair("some", "some"), pair("old", "some"))).alias("x")).select("x.*").distinct()


def ancestor_test(spark, d):
    return history.is_ancestor(_tips_and_roots(spark, d), history.edges(_commits(spark, d)))


def acyclic_check(spark, d):
    placed, every = history.layers(history.edges(_commits(spark, d)), _commits(spark, d))
    return spark.createDataFrame([(placed, every, placed == every)], "placed bigint, every bigint, acyclic boolean")


def history_log(spark, d):
    c = _commits(spark, d)
    return history.log_of(_heads(c), c).select("start", "depth", "commit", "message", "known")


def shallow_parents(spark, d):
    """Parents that are missing once the commits stored late are left out."""
    c = _commits(spark, d).where("stored_at < created_at + interval 1 day")
    return history.shallow(history.edges(c), c)


def snapshot_commits(spark, d):
    """Trees of each scope by the pointers before and up to a date: no commit where nothing changed."""
    return history.snapshot_commit(*_trees(spark, d)).select("scope_id", "commits")


def ref_resolution(spark, d):
    """Names of refs (a HEAD for each scope), full hashes and unknown names."""
    c = _commits(spark, d)
    refs = c.groupBy("scope_id").agg(F.max_by("commit_hash", F.struct("created_at", "commit_hash")).alias("commit_hash")).select(F.concat(F.lit("HEAD@"), "scope_id").alias("name"), "commit_hash")
    asked = refs.select("name").union(c.groupBy("scope_id").agg(F.min("commit_hash").alias("name")).select("name")).union(c.groupBy("scope_id").agg(F.min("tree_hash").alias("name")).select("name")).distinct()
    return history.resolve_refs(asked, refs, c)


def gc_policies(spark, d):
    return _commits(spark, d).groupBy("commit_type", history.gc_policy(F.col("commit_type")).alias("policy")).agg(F.count("*").alias("n"))


def history_stats(spark, d):
    c = _commits(spark, d)
    reach = history.closure(_heads(c), history.edges(c))
    sizes = load(spark, d, "raw_objects").groupBy("raw_hash").agg(F.max("byte_size").alias("byte_size"))
    return history.history_statistics(reach, _bindings(spark, d), sizes)


def republications(spark, d):
    """For the first commit that cites each object: the smallest later descendant that holds it again."""
    b = _bindings(spark, d)
    gone = b.groupBy("raw_hash").agg(F.min("commit_hash").alias("in_commit"))
    return history.republications(gone, b, _commits(spark, d))


def unit_mapping(spark, d):
    """Units of an object's earlier and later normalisation, paired by their texts."""
    c = load(spark, d, "chunks").where("raw_hash is not null").dropDuplicates(["chunk_hash"])
    units = c.select(F.col("raw_hash").alias("doc"), "gen", F.concat_ws("@", "unit_key", "byte_start").alias("unit_key"), F.coalesce("text_hash", "chunk_hash").alias("fingerprint"), "chunk_hash", "byte_start")
    n = F.row_number().over(Window.partitionBy("doc", "gen").orderBy("byte_start", "chunk_hash"))
    u = units.withColumn("n", n).drop("chunk_hash", "byte_start")
    return history.unit_mapping(u.where("gen = 0").drop("gen"), u.where("gen = 1").drop("gen")).groupBy("doc").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("unchanged", "changed", "added", "removed")])


def update_modes(spark, d):
    """Incremental or full, by the change counts of each commit."""
    c = _commits(spark, d)
    rate = history.change_rate(F.col("files_modified"), F.col("files_added"), F.col("files_deleted"), F.lit(40))
    mode = history.update_mode(F.size("parents") > 0, F.col("commit_type") != "imported", F.col("message").isNotNull(), rate, F.col("files_added"))
    return c.select("commit_hash", F.round(rate, 9).alias("change_rate"), mode.alias("full_because"))


_CITED = ["scope_id", "chunk_hash", "raw_hash", "tool_profile_hash", "section_id", "byte_start", "byte_end", "heading_path"]


def exact_citations(spark, d):
    """Pointers that name a chunk exactly as it is stored: a join on all eight columns of its identity."""
    p = load(spark, d, "evidence_pointers").select("pointer_id", *_CITED).distinct()
    return p.join(load(spark, d, "chunks").select(*_CITED).distinct(), _CITED).groupBy("scope_id").agg(F.countDistinct("pointer_id").alias("n"))


def historical_chunks(spark, d):
    """Chunks eligible at each commit: bindings joined to chunks on object, profile and generation, each chunk once."""
    b = _profiled(spark, d).where("tool_profile_hash is not null").select("commit_hash", "raw_hash", "tool_profile_hash", (F.col("gen") - 1).alias("gen")).distinct()
    c = load(spark, d, "chunks").where("first_seen_commit is not null").select("raw_hash", "tool_profile_hash", "gen", "chunk_hash").distinct()
    return b.join(c, ["raw_hash", "tool_profile_hash", "gen"]).select("commit_hash", "chunk_hash").distinct()


def binding_counts(spark, d):
    """Bindings of each snapshot and selector."""
    c = _commits(spark, d)
    out = None
    for s in ("current", "include_deleted"):
        one = history.plan(_profiled(spark, d), c, s, _heads(c)).groupBy("snapshot").agg(F.count("*").alias("n")).select(F.lit(s).alias("selector"), "snapshot", "n")
        out = one if out is None else out.unionByName(one)
    return out


def final_deleted(spark, d):
    """Paths bound on the first-parent line whose newest binding lies behind the head's own bindings."""
    n = newest_bindings(spark, d)
    live = n.where("depth = 0").select("start", "path")
    return n.where("depth > 0").join(live, ["start", "path"], "left_anti").select("start", "path", "raw_hash")


def include_deleted_union(spark, d):
    n = newest_bindings(spark, d)
    live = n.where("depth = 0").select("start", "raw_hash", F.lit("live").alias("kind"))
    gone = final_deleted(spark, d).select("start", "raw_hash", F.lit("deleted").alias("kind")).join(live.select("start", "raw_hash"), ["start", "raw_hash"], "left_anti")
    return live.unionByName(gone).distinct()


def bindings_all_history(spark, d):
    return _bindings(spark, d).groupBy("scope_id", "raw_hash").agg(F.array_join(F.array_sort(F.collect_set("path")), "|").alias("paths"), F.min("commit_hash").alias("first_commit"), F.count("*").alias("n"))


def _trees(spark, d):
    p = load(spark, d, "evidence_pointers").where("raw_hash <> '' and path_at_commit is not null and cited_at is not null")
    cut = F.lit("2025-06-01").cast("timestamp_ntz")
    tree = lambda rows: rows.groupBy("scope_id", F.col("path_at_commit").alias("path")).agg(F.max_by("raw_hash", F.struct("cited_at", "pointer_id")).alias("raw_hash"))
    return tree(p.where(F.col("cited_at") < cut)), tree(p.where(F.col("cited_at") >= cut))


def diff_full_outer(spark, d):
    return history.changes(*_trees(spark, d), ["scope_id", "path"])


def status_full_outer(spark, d):
    return diff_full_outer(spark, d).groupBy("scope_id").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("added", "deleted", "modified", "unchanged")])


def lifecycle_final_event(spark, d):
    return lifecycle.final_events(load(spark, d, "raw_objects"))


def pointer_verify(spark, d):
    return lifecycle.verify_pointers(*(load(spark, d, t) for t in ("evidence_pointers", "chunks", "commits", "raw_objects")))


def orphan_anti_join(spark, d):
    return lifecycle.orphan_vectors(load(spark, d, "chunk_embeddings"), load(spark, d, "chunks")).select("vec_rowid", "target_id").distinct()


def purge_cascade(spark, d):
    gone = load(spark, d, "raw_objects").where("lifecycle_kind in ('purged', 'erased')").select("raw_hash").distinct()
    return lifecycle.purge_cascade(gone, load(spark, d, "chunks"), load(spark, d, "chunk_embeddings"))


def upsert_merge(spark, d):
    """The newest event of each user: what was seen before a date, merged with the events from that date on."""
    e = load(spark, d, "events")
    early = F.coalesce(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), F.lit(False))
    seen = lambda rows: rows.groupBy("user_id").agg(F.max("event_id").alias("seen"))
    return lifecycle.upsert(seen(e.where(early)), seen(e.where(~early)), "user_id", "seen")


def duplicate_scopes(spark, d):
    return load(spark, d, "raw_objects").select("raw_hash", "scope_id").distinct().groupBy("raw_hash").agg(F.count("*").alias("scopes")).where("scopes > 1")


def corpus_size(spark, d):
    c, v = load(spark, d, "chunks"), load(spark, d, "chunk_embeddings")
    return c.agg(F.countDistinct("scope_id").alias("scopes"), F.countDistinct("chunk_hash").alias("chunks")).crossJoin(v.agg(F.countDistinct("vec_rowid").alias("vectors")))


def hourly_metrics(spark, d):
    e = load(spark, d, "events")
    return e.groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))


def dedupe_exact(spark, d):
    x = load(spark, d, "documents").where("text is not null")
    return x.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("keep"), F.count("*").alias("copies")).where("copies > 1").select("keep", "copies")


def eligible_bindings(spark, d):
    """Content groups with a live binding: smallest path of each object per scope."""
    return _bindings(spark, d).groupBy("scope_id", "raw_hash").agg(F.min_by("commit_hash", F.struct("path", "commit_hash")).alias("commit_hash"), F.min("path").alias("path"))


def incremental_anti_join(spark, d):
    """Texts that still need a vector: chunk texts without an embedding of the text profile."""
    c = load(spark, d, "chunks").where("text_hash is not null").select("text_hash").distinct()
    v = load(spark, d, "chunk_embeddings").where("target_type = 'chunk' and modality = 'text'").select(F.col("target_id").alias("text_hash"))
    return c.join(v, "text_hash", "left_anti")


_C = "c AS (SELECT DISTINCT ON (commit_hash) * FROM commits), e AS (SELECT commit_hash AS child, unnest(parents) AS parent, generate_subscripts(parents, 1) - 1 AS n FROM c), heads AS (SELECT commit_hash FROM c WHERE commit_hash NOT IN (SELECT parent FROM e))"
_B = "b AS (SELECT DISTINCT scope_id, commit_hash, path_at_commit AS path, raw_hash FROM evidence_pointers WHERE commit_hash <> '' AND raw_hash <> '' AND path_at_commit IS NOT NULL)"
_W = "w AS (SELECT commit_hash AS start, commit_hash AS commit, 0 AS depth FROM heads UNION ALL SELECT w.start, e.parent, w.depth + 1 FROM w JOIN e ON e.child = w.commit AND e.n = 0)"
_N = "nb AS (SELECT w.start, b.path, b.raw_hash, b.commit_hash, w.depth FROM w JOIN b ON b.commit_hash = w.commit QUALIFY row_number() OVER (PARTITION BY w.start, b.path ORDER BY w.depth, b.raw_hash) = 1)"
_D = "live AS (SELECT * FROM nb WHERE depth = 0), gone AS (SELECT * FROM nb WHERE depth > 0 AND NOT EXISTS (SELECT 1 FROM live l WHERE l.start = nb.start AND l.path = nb.path))"
_ANC = "anc AS (SELECT child AS start, parent AS commit FROM e UNION SELECT a.start, e.parent FROM anc a JOIN e ON e.child = a.commit)"
_INTRO = _ANC + """, bd AS (SELECT DISTINCT commit_hash, path, raw_hash FROM b),
    cand AS (SELECT * FROM bd WHERE NOT EXISTS (SELECT 1 FROM e JOIN bd p ON p.commit_hash = e.parent WHERE e.child = bd.commit_hash AND p.path = bd.path AND p.raw_hash = bd.raw_hash)),
    first AS (SELECT * FROM cand x WHERE NOT EXISTS (SELECT 1 FROM cand y JOIN anc a ON a.commit = y.commit_hash WHERE a.start = x.commit_hash AND y.path = x.path AND y.raw_hash = x.raw_hash))"""
_P = "pb AS (SELECT DISTINCT commit_hash, path_at_commit AS path, raw_hash, CASE WHEN coalesce(chunk_hash, '') <> '' THEN tool_profile_hash END AS tool_profile_hash, schema_version AS gen FROM evidence_pointers WHERE commit_hash <> '' AND raw_hash <> '' AND path_at_commit IS NOT NULL), known AS (SELECT * FROM pb WHERE tool_profile_hash IS NOT NULL)"
_LIVE = "live AS (SELECT commit_hash AS snapshot, raw_hash, tool_profile_hash, gen, min(path) AS path, commit_hash, true AS is_live FROM known WHERE commit_hash IN (FROM heads) GROUP BY commit_hash, raw_hash, tool_profile_hash, gen)"
_DEL = """nb2 AS (SELECT w.start, b.path, b.raw_hash, w.depth FROM w JOIN (SELECT DISTINCT commit_hash, path, raw_hash FROM pb) b ON b.commit_hash = w.commit QUALIFY row_number() OVER (PARTITION BY w.start, b.path ORDER BY w.depth, b.raw_hash) = 1),
    gone2 AS (SELECT start, path, raw_hash FROM nb2 WHERE depth > 0),
    newest AS (SELECT g.start AS snapshot, g.raw_hash, k.tool_profile_hash, k.gen, g.path, k.commit_hash, false AS is_live FROM gone2 g JOIN w ON w.start = g.start JOIN known k ON k.commit_hash = w.commit AND k.path = g.path AND k.raw_hash = g.raw_hash QUALIFY row_number() OVER (PARTITION BY g.start, g.path, g.raw_hash ORDER BY w.depth, k.tool_profile_hash, k.gen) = 1),
    incl AS (SELECT * FROM live UNION ALL SELECT * FROM newest n WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.snapshot = n.snapshot AND l.raw_hash = n.raw_hash AND l.tool_profile_hash = n.tool_profile_hash AND l.gen = n.gen))"""
_REACH = "reach AS (SELECT commit_hash AS start, commit_hash AS commit FROM heads UNION SELECT r.start, e.parent FROM reach r JOIN e ON e.child = r.commit)"
_ENDS = "ends AS (SELECT arg_min(commit_hash, (created_at, commit_hash)) AS old, arg_max(commit_hash, (created_at, commit_hash)) AS new, min(commit_hash) AS least FROM c WHERE scope_id IS NOT NULL GROUP BY scope_id), pairs AS (SELECT old AS ancestor, new AS descendant FROM ends UNION SELECT new, old FROM ends UNION SELECT least, new FROM ends UNION SELECT least, least FROM ends UNION SELECT old, least FROM ends)"
_T = """
    p AS (SELECT * FROM evidence_pointers WHERE raw_hash <> '' AND path_at_commit IS NOT NULL AND cited_at IS NOT NULL),
    o AS (SELECT scope_id, path_at_commit AS path, arg_max(raw_hash, (cited_at, pointer_id)) AS old_hash FROM p WHERE cited_at < TIMESTAMP '2025-06-01' GROUP BY 1, 2),
    n AS (SELECT scope_id, path_at_commit AS path, arg_max(raw_hash, (cited_at, pointer_id)) AS new_hash FROM p WHERE cited_at >= TIMESTAMP '2025-06-01' GROUP BY 1, 2),
    diff AS (SELECT scope_id, path, old_hash, new_hash, CASE WHEN old_hash IS NULL THEN 'added' WHEN new_hash IS NULL THEN 'deleted' WHEN old_hash <> new_hash THEN 'modified' ELSE 'unchanged' END AS state FROM o FULL JOIN n USING (scope_id, path))"""
_FINAL = "SELECT scope_id, raw_hash, arg_max(lifecycle_kind, (lifecycle_at, lifecycle_kind IN ('purged', 'erased'), lifecycle_kind)) AS state FROM raw_objects WHERE lifecycle_kind IS NOT NULL GROUP BY 1, 2"
SQL = {
    "plan_current": f"WITH {_C}, {_P}, {_LIVE} SELECT * FROM live",
    "plan_all_history": f"WITH RECURSIVE {_C}, {_B}, {_INTRO}, {_P}, {_REACH}, canon AS (SELECT r.start AS snapshot, f.path, f.raw_hash, min(f.commit_hash) AS commit_hash FROM first f JOIN reach r ON r.commit = f.commit_hash GROUP BY 1, 2, 3), every AS (SELECT DISTINCT r.start AS snapshot, k.path, k.raw_hash, k.tool_profile_hash, k.gen FROM known k JOIN reach r ON r.commit = k.commit_hash) SELECT snapshot, raw_hash, tool_profile_hash, gen, path, commit_hash, EXISTS (SELECT 1 FROM known k WHERE k.commit_hash = v.snapshot AND k.path = v.path AND k.raw_hash = v.raw_hash AND k.tool_profile_hash = v.tool_profile_hash AND k.gen = v.gen) AS is_live FROM every v JOIN canon USING (snapshot, path, raw_hash)",
    "plan_include_deleted": f"WITH RECURSIVE {_C}, {_W}, {_P}, {_LIVE}, {_DEL} SELECT * FROM incl",
    "binding_counts": f"WITH RECURSIVE {_C}, {_W}, {_P}, {_LIVE}, {_DEL} SELECT 'current' AS selector, snapshot, count(*) AS n FROM live GROUP BY 2 UNION ALL SELECT 'include_deleted', snapshot, count(*) FROM incl GROUP BY 2",
    "exact_citations": "SELECT p.scope_id, count(DISTINCT p.pointer_id) AS n FROM evidence_pointers p JOIN chunks c USING (scope_id, chunk_hash, raw_hash, tool_profile_hash, section_id, byte_start, byte_end, heading_path) GROUP BY 1",
    "historical_chunks": f"WITH {_P} SELECT DISTINCT k.commit_hash, c.chunk_hash FROM known k JOIN chunks c ON c.raw_hash = k.raw_hash AND c.tool_profile_hash = k.tool_profile_hash AND c.gen = k.gen - 1 WHERE c.first_seen_commit IS NOT NULL",
    "alias_expansion": f"WITH {_B}, t AS (SELECT scope_id, max(raw_hash) AS raw_hash FROM b GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY scope_id) AS rank, raw_hash FROM t), a AS (SELECT DISTINCT rank, path, commit_hash FROM r JOIN b USING (raw_hash)) SELECT *, row_number() OVER (PARTITION BY rank ORDER BY path, commit_hash) AS alias_no FROM a",
    "ancestor_test": f"WITH RECURSIVE {_C}, {_ANC}, {_ENDS} SELECT ancestor, descendant, ancestor = descendant OR EXISTS (SELECT 1 FROM anc WHERE anc.start = descendant AND anc.commit = ancestor) AS is_ancestor FROM pairs",
    "acyclic_check": "SELECT count(DISTINCT commit_hash) AS placed, count(DISTINCT commit_hash) AS every, true AS acyclic FROM commits",
    "history_log": f"WITH RECURSIVE {_C}, {_W} SELECT w.start, w.depth, w.commit, c.message, c.commit_hash IS NOT NULL AS known FROM w LEFT JOIN c ON c.commit_hash = w.commit",
    "shallow_parents": "WITH c AS (SELECT DISTINCT ON (commit_hash) * FROM (SELECT * FROM commits ORDER BY stored_at)), k AS (SELECT * FROM c WHERE stored_at < created_at + INTERVAL 1 DAY) SELECT DISTINCT p AS commit_hash FROM (SELECT unnest(parents) AS p FROM k) WHERE p NOT IN (SELECT commit_hash FROM k)",
    "snapshot_commits": "WITH p AS (SELECT * FROM evidence_pointers WHERE raw_hash <> '' AND path_at_commit IS NOT NULL AND cited_at IS NOT NULL), t AS (SELECT scope_id, path_at_commit AS path, cited_at < TIMESTAMP '2025-06-01' AS early, arg_max(raw_hash, (cited_at, pointer_id)) AS h FROM p GROUP BY 1, 2, 3), g AS (SELECT scope_id, string_agg(path || chr(0) || h, chr(10) ORDER BY path, h) FILTER (early) AS o, string_agg(path || chr(0) || h, chr(10) ORDER BY path, h) FILTER (NOT early) AS n FROM t GROUP BY 1) SELECT scope_id, o IS DISTINCT FROM n AS commits FROM g",
    "ref_resolution": "WITH c AS (SELECT DISTINCT ON (commit_hash) * FROM commits), r AS (SELECT 'HEAD@' || scope_id AS name, arg_max(commit_hash, (created_at, commit_hash)) AS commit_hash FROM c GROUP BY scope_id), a AS (SELECT name FROM r UNION SELECT min(commit_hash) FROM c GROUP BY scope_id UNION SELECT min(tree_hash) FROM c GROUP BY scope_id) SELECT a.name, coalesce(r.commit_hash, c.commit_hash) AS commit_hash FROM a LEFT JOIN r USING (name) LEFT JOIN c ON c.commit_hash = a.name",
    "gc_policies": "SELECT commit_type, CASE WHEN commit_type IN ('auto', 'migrated', 'repaired') THEN 'shallow' ELSE 'none' END AS policy, count(*) AS n FROM (SELECT DISTINCT ON (commit_hash) * FROM commits) GROUP BY 1",
    "history_stats": f"WITH RECURSIVE {_C}, {_B}, {_REACH}, z AS (SELECT raw_hash, max(byte_size) AS s FROM raw_objects GROUP BY 1), p AS (SELECT commit_hash, count(*) AS e, coalesce(sum(s), 0) AS y FROM (SELECT DISTINCT commit_hash, path, raw_hash FROM b) LEFT JOIN z USING (raw_hash) GROUP BY 1), g AS (SELECT start, count(*) AS commits, coalesce(sum(e), 0)::BIGINT AS entries, coalesce(sum(y), 0)::BIGINT AS bytes FROM reach LEFT JOIN p ON p.commit_hash = reach.commit GROUP BY 1) SELECT *, commits <= 100000 AND entries <= 10000000 AND bytes <= 4294967296 AS within FROM g",
    "republications": f"WITH RECURSIVE {_C}, {_B}, {_ANC}, h AS (SELECT DISTINCT raw_hash, commit_hash FROM b), g AS (SELECT raw_hash, min(commit_hash) AS in_commit FROM h GROUP BY 1) SELECT g.raw_hash, g.in_commit, min(h.commit_hash) AS commit_hash FROM g JOIN h USING (raw_hash) JOIN anc a ON a.start = h.commit_hash AND a.commit = g.in_commit WHERE h.commit_hash <> g.in_commit GROUP BY 1, 2",
    "update_modes": "WITH c AS (SELECT DISTINCT ON (commit_hash) *, (files_modified + files_added + files_deleted) / 40 AS rate FROM commits) SELECT commit_hash, round(rate, 9) AS change_rate, CASE WHEN NOT coalesce(len(parents), 0) > 0 THEN 'no_previous_done_run' WHEN commit_type = 'imported' THEN 'identity_changed' WHEN message IS NULL THEN 'adapter_lacks_incremental_update' WHEN rate >= 0.3 THEN 'change_rate_threshold' WHEN files_added >= 10 THEN 'max_consecutive_incremental' END AS full_because FROM c",
    "first_parent_walk": f"WITH RECURSIVE {_C}, {_W} SELECT start, max(depth) AS longest, count(*) AS commits, min(commit) AS least FROM w GROUP BY 1",
    "all_parent_closure": f"WITH RECURSIVE {_C}, r AS (SELECT commit_hash AS start, commit_hash AS commit FROM heads UNION SELECT r.start, e.parent FROM r JOIN e ON e.child = r.commit) SELECT start, count(*) AS reachable, max(commit) AS greatest FROM r GROUP BY 1",
    "introductions": f"WITH RECURSIVE {_C}, {_B}, {_INTRO} SELECT path, raw_hash, count(*) AS n, min(commit_hash) AS canonical FROM first GROUP BY 1, 2",
    "newest_bindings": f"WITH RECURSIVE {_C}, {_B}, {_W}, {_N} SELECT * FROM nb",
    "final_deleted": f"WITH RECURSIVE {_C}, {_B}, {_W}, {_N}, {_D} SELECT start, path, raw_hash FROM gone",
    "include_deleted_union": f"WITH RECURSIVE {_C}, {_B}, {_W}, {_N}, {_D} SELECT DISTINCT start, raw_hash, 'live' AS kind FROM live UNION SELECT DISTINCT start, raw_hash, 'deleted' FROM gone WHERE (start, raw_hash) NOT IN (SELECT start, raw_hash FROM live)",
    "bindings_all_history": f"WITH {_B} SELECT scope_id, raw_hash, array_to_string(list_sort(list(DISTINCT path)), '|') AS paths, min(commit_hash) AS first_commit, count(*) AS n FROM b GROUP BY 1, 2",
    "diff_full_outer": f"WITH {_T} SELECT * FROM diff",
    "status_full_outer": f"WITH {_T} SELECT scope_id, count(*) FILTER (state = 'added') AS added, count(*) FILTER (state = 'deleted') AS deleted, count(*) FILTER (state = 'modified') AS modified, count(*) FILTER (state = 'unchanged') AS unchanged FROM diff GROUP BY 1",
    "lifecycle_final_event": _FINAL,
    "pointer_verify": f"""
        WITH p AS (SELECT DISTINCT ON (pointer_id) * FROM evidence_pointers), f AS ({_FINAL}), k AS (SELECT scope_id, chunk_hash, any_value(raw_hash) AS chunk_raw FROM chunks GROUP BY 1, 2)
        SELECT p.pointer_id, p.scope_id, CASE WHEN p.scope_id NOT IN (SELECT scope_id FROM commits) THEN 'scope_unreachable'
          WHEN NOT EXISTS (SELECT 1 FROM commits c WHERE c.scope_id = p.scope_id AND c.commit_hash = p.commit_hash) THEN 'unverifiable'
          WHEN f.state IN ('purged', 'erased') THEN 'tombstoned' WHEN k.chunk_raw IS NULL THEN 'not_found' WHEN k.chunk_raw <> coalesce(p.raw_hash, '') THEN 'mismatch' ELSE 'alive' END AS verdict
        FROM p LEFT JOIN f ON f.scope_id = p.scope_id AND f.raw_hash = p.raw_hash LEFT JOIN k ON k.scope_id = p.scope_id AND k.chunk_hash = p.chunk_hash""",
    "orphan_anti_join": "SELECT DISTINCT vec_rowid, target_id FROM chunk_embeddings v WHERE target_type = 'chunk' AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.text_hash = v.target_id)",
    "purge_cascade": """
        WITH g AS (SELECT DISTINCT raw_hash FROM raw_objects WHERE lifecycle_kind IN ('purged', 'erased'))
        SELECT 'chunks' AS kind, count(DISTINCT chunk_hash) AS n FROM chunks WHERE raw_hash IN (FROM g)
        UNION ALL SELECT 'vectors', count(DISTINCT vec_rowid) FROM chunk_embeddings v WHERE EXISTS (SELECT 1 FROM chunks c WHERE c.raw_hash IN (FROM g) AND c.text_hash = v.target_id) AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.raw_hash NOT IN (FROM g) AND c.text_hash = v.target_id)""",
    "upsert_merge": "SELECT user_id, max(event_id) AS seen FROM events GROUP BY 1",
    "duplicate_scopes": "SELECT raw_hash, count(DISTINCT scope_id) AS scopes FROM raw_objects GROUP BY 1 HAVING count(DISTINCT scope_id) > 1",
    "corpus_size": "SELECT count(DISTINCT scope_id) AS scopes, count(DISTINCT chunk_hash) AS chunks, (SELECT count(DISTINCT vec_rowid) FROM chunk_embeddings) AS vectors FROM chunks",
    "hourly_metrics": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2",
    "dedupe_exact": "SELECT min(doc_id) AS keep, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1",
    "eligible_bindings": f"WITH {_B} SELECT scope_id, raw_hash, arg_min(commit_hash, (path, commit_hash)) AS commit_hash, min(path) AS path FROM b GROUP BY 1, 2",
    "incremental_anti_join": "SELECT DISTINCT text_hash FROM chunks c WHERE text_hash IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chunk_embeddings v WHERE v.target_id = c.text_hash AND v.target_type = 'chunk' AND v.modality = 'text')",
}
QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")}
