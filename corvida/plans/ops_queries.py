"""Queries on ledger, tasks, life cycle of stores and evaluation, with their SQL.

The archive has no ledger or task table, so events stand for ledger rows and task steps: purchases are settled charges,
signups open reservations, errors failed steps; the value is the amount, the key in props the number of units.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvida.functions import text
from corvida.operators import ledger, lifecycle
from corvida.session import load

NOW = "2024-01-31 00:00:00"


def _rows(spark, d):
    e = load(spark, d, "events")
    adapter = F.element_at(F.array(F.lit("markdownize"), F.lit("embedding"), F.lit("summary")), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select("event_id", "user_id", "event_type", "ts", F.date_format("ts", "yyyy-MM").alias("month"), F.concat(F.lit("s"), (F.col("user_id") % 20).cast("string")).alias("scope_id"), adapter.alias("adapter_kind"), F.round(F.col("value") * 100).cast("bigint").alias("cents"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))


_R = "r AS (SELECT event_id, user_id, event_type, ts, strftime(ts, '%Y-%m') AS month, 's' || user_id % 20 AS scope_id, ['markdownize', 'embedding', 'summary'][event_id % 3 + 1] AS adapter_kind, round(value * 100)::BIGINT AS cents, json_extract(props, '$.k')::BIGINT AS k FROM events)"


def _charges(spark, d):
    r = _rows(spark, d)
    return r.where("event_type = 'purchase'"), r.where("event_type = 'signup'")


def ledger_month_total(spark, d):
    """Month totals of the device, of one scope, of one adapter, and of every scope."""
    c, r = _charges(spark, d)
    one = lambda name, t: t.select(F.lit(name).alias("filter"), "month", "spent")
    every = ledger.month_total(c, r, ["scope_id"]).select(F.concat(F.lit("each "), "scope_id").alias("filter"), "month", "spent")
    return one("device", ledger.month_total(c, r)).unionByName(one("scope s3", ledger.month_total(c, r, scope="s3"))).unionByName(one("embedding", ledger.month_total(c, r, adapter="embedding"))).unionByName(every)


def ledger_cap_check(spark, d):
    """Every click as a candidate charge against the caps of device, scope and adapter; some cost nothing."""
    c, r = _charges(spark, d)
    t = ledger.month_total(c, r).select("month", F.lit("device").alias("layer"), F.lit("").alias("key"), "spent")
    t = t.unionByName(ledger.month_total(c, r, ["scope_id"]).select("month", F.lit("folder").alias("layer"), F.col("scope_id").alias("key"), "spent"))
    t = t.unionByName(ledger.month_total(c, r, ["adapter_kind"]).select("month", F.lit("per_adapter").alias("layer"), F.col("adapter_kind").alias("key"), "spent"))
    most = {x.layer: int(x.m) for x in t.groupBy("layer").agg(F.max("spent").alias("m")).collect()}  # three layers
    caps = {"device": most.get("device", 0) + 40_000, "folder": most.get("folder", 0) + 100, "per_adapter": most.get("per_adapter", 0) + 2_000}
    x = _rows(spark, d).where("event_type = 'click'").withColumn("cents", F.when(F.col("event_id") % 10 == 0, 0).otherwise(F.col("cents")))
    return ledger.cap_check(x, t, caps).select("event_id", "cents", "verdict")


def latest_by_path(spark, d):
    return ledger.latest_by(load(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def retention_kept(spark, d):
    c = load(spark, d, "commits").dropDuplicates(["commit_hash"])
    tips = c.groupBy("scope_id").agg(F.max_by("commit_hash", F.struct("created_at", "commit_hash")).alias("commit_hash"))
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    return ledger.retention(c, tips, now)


def percentile_nearest_rank(spark, d):
    return ledger.nearest_rank(load(spark, d, "events"), ["event_type"], "value", [50, 95, 99])


def cost_preview(spark, d):
    return ledger.cost_preview(load(spark, d, "raw_objects").dropDuplicates(["raw_hash"]), 2, 1)


def billed_amount(spark, d):
    """A user's reports of one day as one usage report: kinds may repeat or be unknown, counts may be missing."""
    kind = F.element_at(F.array(F.lit("pages"), F.lit("tokens_in"), F.lit("tokens_out"), F.lit("images")), F.when(F.col("k") > 96, 4).otherwise(F.col("k") % 3 + 1).cast("int"))
    r = _rows(spark, d).select(F.concat_ws("/", "user_id", F.date_format("ts", "MM-dd")).alias("id"), kind.alias("kind"), F.when(F.col("k") != 13, F.col("k")).alias("count"), F.col("cents").alias("estimate"))
    return ledger.billed(r, {"pages": 20, "tokens_in": 1, "tokens_out": 4})


def task_rollup(spark, d):
    g = _rows(spark, d).groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_if(F.col("event_type") == "purchase").alias("done"), F.count_if(F.col("event_type") == "error").alias("failed"), F.bool_or(F.col("k") == 99).alias("blocked"))
    return g.select("user_id", "day", ledger.task_state(F.col("done"), F.col("failed"), F.col("blocked")).alias("state"))


_REASONS = ["network_error", "rate_limit", "auth_error", "quota_exceeded", "invalid_input", "budget_exceeded", "odd"]


def retry_classes(spark, d):
    reason = F.element_at(F.array(*[F.lit(x) for x in _REASONS]), (F.col("event_id") % 7 + 1).cast("int"))
    t = _rows(spark, d).where("event_type = 'error'").select("event_id", F.lit("failed").alias("status"), reason.alias("reason"), (F.col("k") % 6).alias("attempts"))
    return ledger.retries(t).select("event_id", "kind", "backoff", "paused", "retry", "terminal")


def hold_reasons(spark, d):
    reason = F.element_at(F.array(*[F.lit(x) for x in [*_REASONS, "secrets_tier_b"]]), (F.col("event_id") % 8 + 1).cast("int"))
    return _rows(spark, d).groupBy(reason.alias("reason"), text.hold_reason(reason).alias("hold")).agg(F.count("*").alias("n"))


_STATE = "CASE event_type WHEN 'view' THEN 'pending' WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'paused' END"


def task_machine(spark, d):
    e = _rows(spark, d).withColumn("state", F.expr(_STATE))
    return ledger.task_machine(e, "user_id", ["ts", "event_id"], "state").select("user_id", "state", "violations", "events")


def _requests(spark, d):
    return _rows(spark, d).select("event_id", "scope_id", "adapter_kind", F.when(F.col("k") % 2 == 0, "sync").otherwise("batch").alias("request_kind"), (F.col("k") % 5).cast("int").alias("state"), F.when(F.col("k") % 3 == 0, F.col("event_id")).alias("intent_token"), F.when(F.col("k") % 4 == 1, F.concat(F.lit("job-"), F.col("event_id").cast("string"))).alias("batch_job_id"), F.when(F.col("k") % 7 != 0, F.col("ts") + F.expr("interval 2 days")).alias("stale_after_at"))


_Q = "q AS (SELECT event_id, scope_id, adapter_kind, CASE WHEN k % 2 = 0 THEN 'sync' ELSE 'batch' END AS request_kind, k % 5 AS state, CASE WHEN k % 3 = 0 THEN event_id END AS intent_token, CASE WHEN k % 4 = 1 THEN 'job-' || event_id END AS batch_job_id, CASE WHEN k % 7 <> 0 THEN ts + INTERVAL 2 DAY END AS stale_after_at FROM r)"


def stale_reservations(spark, d):
    return ledger.stale_reservations(_requests(spark, d), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("event_id")


def recovery_and_poll(spark, d):
    q = _requests(spark, d)
    return ledger.recovery_candidates(q).select(F.lit("recovery").alias("lane"), "event_id").unionByName(ledger.poll_candidates(q).select(F.lit("poll").alias("lane"), "event_id"))


def sweep_topk(spark, d):
    """A bounded sweep: own key first, then general and prunable rows as the capacity is split."""
    q = _rows(spark, d).where("event_type = 'error'")
    return ledger.sweep(q, F.col("user_id") == 7, F.col("k") < 3, "event_id", 40, 10, 8)


def submit_once(spark, d):
    r = _rows(spark, d)
    asked = r.where("event_type in ('click', 'view')").select(F.col("user_id").alias("key"), F.col("k").alias("seq"), F.col("ts").alias("at"))
    return ledger.submit_once(asked, r.where("event_type = 'purchase'").select(F.col("user_id").alias("key"), F.col("k").alias("seq")))


def submission_seq(spark, d):
    e = load(spark, d, "events").where("event_type = 'error'")
    return e.select("event_id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"), (F.count("*").over(Window.partitionBy("user_id")) + 1).alias("next_seq"))


def budget_warnings(spark, d):
    g = _charges(spark, d)[0].groupBy("scope_id").agg(F.sum("cents").alias("folder"), F.sum(F.when(F.col("adapter_kind") == "embedding", F.col("cents")).otherwise(0)).alias("device"))
    return g.select("scope_id", ledger.budget_warning({"device": F.col("device"), "folder": F.col("folder")}, {"device": 300_000, "folder": 1_000_000}, 80).alias("warning"))


def jobs_reconcile(spark, d):
    q = _requests(spark, d)
    provider = q.where("event_id % 3 <> 0").select(F.concat(F.lit("job-"), F.col("event_id").cast("string")).alias("job_id"))
    return ledger.reconcile_jobs(provider, q.select(F.col("batch_job_id").alias("job_id"))).groupBy("state").agg(F.count("*").alias("n"))


def promotions(spark, d):
    """Objects whose every page up to their last was read well enough replace what is shown."""
    p = load(spark, d, "page_images").dropDuplicates(["image_hash"])
    i = p.select(F.col("raw_hash").alias("instance"), F.col("page_no").alias("unit"), F.when(F.col("confidence") > 0.5, "done").otherwise("failed").alias("status"))
    return ledger.promotable(i.withColumn("expected", F.count("*").over(Window.partitionBy("instance"))))


def batch_answers(spark, d):
    q = _requests(spark, d).select(F.col("scope_id").alias("batch"), F.col("event_id").cast("string").alias("key"), "state", "intent_token")
    answers = q.where("state < 4 or batch <> 's3'").select("batch", F.when((F.col("batch") == "s5") & (F.col("state") == 0), F.lit("strange")).otherwise(F.col("key")).alias("key"))
    return ledger.batch_lines(q, answers)


def run_outcomes(spark, d):
    g = _rows(spark, d).groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("done"), F.count_if((F.col("event_type") == "error") & (F.col("k") < 50)).alias("retryable"), F.count_if((F.col("event_type") == "error") & (F.col("k") >= 50)).alias("permanent"))
    o = ledger.run_outcome(F.col("done"), F.col("retryable"), F.col("permanent"))
    return g.select("user_id", o.alias("outcome"), ledger.exit_code(o).alias("code"))


def archive_limits(spark, d):
    r = load(spark, d, "raw_objects").dropDuplicates(["raw_hash"])
    return ledger.within_limits(r, "scope_id", "raw_hash", "byte_size", 2_000_000, 60_000_000, 100).groupBy("scope_id", "over").agg(F.count("*").alias("n"))


def coverage_gates(spark, d):
    """Whether every chunk of a kind of unit has a vector."""
    c = load(spark, d, "chunks").where("text_hash is not null")
    need = c.select(F.substring_index("unit_key", ":", 1).alias("kind"), F.col("text_hash").alias("key"))
    got = load(spark, d, "chunk_embeddings").where("target_type = 'chunk'").select(F.col("target_id").alias("key")).distinct()
    return ledger.coverage_gates(need, need.join(got, "key", "left_semi"))


def enriched_ratio(spark, d):
    """Share of a scope's texts that have a vector, and how many are pending."""
    c = load(spark, d, "chunks").where("text_hash is not null").select("scope_id", "text_hash").distinct()
    v = load(spark, d, "chunk_embeddings").where("target_type = 'chunk'").select(F.col("target_id").alias("text_hash"), F.lit(1).alias("v")).distinct()
    return c.join(v, "text_hash", "left").groupBy("scope_id").agg(F.round(F.count("v") / F.count("*"), 9).alias("enriched"), (F.count("*") - F.count("v")).alias("pending"))


def ocr_discovery(spark, d):
    """Page images as discovered units of their objects; numbers begin at the object's own first page."""
    p = load(spark, d, "page_images").dropDuplicates(["image_hash"])
    media = F.element_at(F.array(F.lit("application/pdf"), F.lit("image/png"), F.lit("text/plain")), F.when(F.col("scope_id") == "relay-runbooks", 2).when(F.col("scope_id") == "delta-audits", 3).otherwise(1))
    first = F.min("page_no").over(Window.partitionBy("raw_hash"))
    u = p.withColumn("n", F.col("page_no") - first).select("raw_hash", media.alias("media_type"), F.when(F.col("scope_id") == "relay-runbooks", "image").otherwise("page").alias("kind"), "n", (F.col("n") + 1).cast("string").alias("selector"))
    return ledger.discovery_error(u)


def task_owners(spark, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("online", "normalized_instance", "offline", "embedding", "broken")]), (F.col("k") % 5 + 1).cast("int"))
    o = ledger.task_owner(kind, F.col("event_type") == "purchase", F.col("k") % 3 == 0, F.col("k") % 2 == 0)
    return _rows(spark, d).groupBy(kind.alias("kind"), o.alias("owner")).agg(F.count("*").alias("n"))


def layout_recovered(spark, d):
    """Layout JSON of each object's pages: headers, footers and numbers come back in reading order."""
    p = load(spark, d, "page_images").where("visible_text is not null").dropDuplicates(["image_hash"])
    label = F.element_at(F.array(*[F.lit(x) for x in ("header", "text", "footer", "number")]), F.pmod(F.col("page_no"), F.lit(4)) + 1)
    box = F.when(F.col("page_no") % 5 > 0, F.array((F.col("page_no") % 3).cast("bigint"), (F.col("page_no") % 7).cast("bigint"), F.lit(9).cast("bigint"), F.lit(9).cast("bigint")))
    block = F.struct(label.alias("block_label"), box.alias("block_bbox"), F.col("image_hash").alias("block_content"))
    j = p.groupBy("raw_hash").agg(F.array_sort(F.collect_list(F.struct("page_no", "image_hash", block.alias("b")))).alias("l"))
    doc = j.select("raw_hash", F.to_json(F.struct(F.struct(F.transform("l", lambda x: x["b"]).alias("parsing_res_list")).alias("prunedResult"))).alias("json"))
    return ledger.recovered_blocks(ledger.layout_blocks(doc, "raw_hash", "json"), "raw_hash").select("raw_hash", F.array_join("recovered", "|").alias("recovered"))


def corpus_attestation(spark, d):
    """Eligible chunks, rows of the text index and the manifest's number must agree per scope."""
    c = load(spark, d, "chunks").dropDuplicates(["chunk_hash"])
    a = c.where("first_seen_commit is not null").groupBy("scope_id").agg(F.count("*").alias("eligible"), F.count("text").alias("indexed"))
    m = c.groupBy("scope_id").agg(F.count("*").alias("manifest"))
    return a.join(m, "scope_id").withColumn("attested", (F.col("eligible") == F.col("indexed")) & (F.col("indexed") == F.col("manifest")))


def answer_oracle(spark, d):
    """Findings joined to commits, cited pointers and the state of the cited object: what a checker must be able to answer."""
    f = load(spark, d, "object_findings").dropDuplicates(["finding_id"]).select("finding_id", "scope_id", F.explode(F.array_distinct("affected_commits")).alias("commit_hash"))
    c = load(spark, d, "commits").select("scope_id", "commit_hash").distinct()
    p = load(spark, d, "evidence_pointers").dropDuplicates(["pointer_id"]).select("pointer_id", "commit_hash", "raw_hash")
    o = lifecycle.final_events(load(spark, d, "raw_objects")).select("raw_hash", "state")
    j = f.join(c, ["scope_id", "commit_hash"]).join(p, "commit_hash").join(o, "raw_hash")
    return j.groupBy("finding_id", "state").agg(F.count("*").alias("pointers"))


def _life(spark, d):
    r = load(spark, d, "raw_objects").where("lifecycle_kind is not null").select("raw_hash", "lifecycle_kind", "lifecycle_at", "stored_at").distinct()
    marker = F.when(F.col("lifecycle_kind") == "erased", "receipt").otherwise("tombstone")
    n = F.row_number().over(Window.partitionBy("raw_hash", "marker").orderBy("lifecycle_at", "stored_at", "lifecycle_kind"))
    return r.withColumn("marker", marker).select("raw_hash", "marker", n.alias("n"), F.col("lifecycle_kind").alias("kind"), F.col("lifecycle_at").alias("at"), F.when(F.length("raw_hash") > 0, "asked").alias("reason"))


def event_grammar(spark, d):
    return lifecycle.event_errors(_life(spark, d))


def _journal(spark, d):
    e = _rows(spark, d).where("event_type <> 'click'").select("user_id", F.expr("CASE event_type WHEN 'view' THEN 'prepared' WHEN 'signup' THEN 'tombstoned' WHEN 'error' THEN 'deleted' ELSE 'committed' END").alias("phase"), "ts", "event_id")
    return e.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("n <= 4").select(F.col("user_id").alias("purge_id"), "n", "phase")


def purge_phases(spark, d):
    return lifecycle.purge_phases(_journal(spark, d))


def read_barrier(spark, d):
    """Chunks of scopes with an erased object still to be cleared are not to be read."""
    busy = load(spark, d, "raw_objects").where("lifecycle_kind = 'erased' and lifecycle_at >= timestamp_ntz'2025-12-01 00:00:00'").select("scope_id")
    return lifecycle.read_barrier(load(spark, d, "chunks").select("scope_id", "chunk_hash").distinct(), busy).groupBy("scope_id").agg(F.count("*").alias("n"))


def store_findings(spark, d):
    """Texts of chunks as objects of a store, cited by pointers: corrupt, missing and orphan ones with the commits they touch."""
    c = load(spark, d, "chunks").where("text_hash is not null").select("chunk_hash", "text_hash", "text").dropDuplicates(["chunk_hash"])
    objects = c.where("text is not null").select(F.col("text_hash").alias("object_hash"), F.col("text").alias("content"))
    p = load(spark, d, "evidence_pointers").dropDuplicates(["pointer_id"]).select("commit_hash", "chunk_hash").join(c.select("chunk_hash", F.col("text_hash").alias("object_hash")), "chunk_hash").select("object_hash", "commit_hash")
    f = lifecycle.findings(objects, p, load(spark, d, "commits"))
    return f.select("kind", "object_hash", F.size("affected").alias("n_affected"))


def prune_orphans(spark, d):
    stored = load(spark, d, "page_images").select("scope_id", "image_hash").distinct()
    live = load(spark, d, "chunk_embeddings").where("target_type = 'image'").select(F.col("target_id").alias("image_hash"))
    blocked = load(spark, d, "object_findings").where("finding_kind = 'tree_corrupt'").select("scope_id")
    return lifecycle.prunable(stored, live, "image_hash", blocked)


def _registry(spark, d):
    c = load(spark, d, "commits").groupBy("scope_id").agg(F.count("*").alias("n"), F.max("stored_at").alias("at"))
    return c.select("scope_id", F.concat(F.lit("/archive/"), "scope_id").alias("root_path"), (F.col("n") % 3 != 0).alias("participates"), (F.col("n") % 2 == 0).alias("indexed"))


def registry_participating(spark, d):
    return lifecycle.participating(_registry(spark, d)).select("root_path", "scope_id")


def registry_prune(spark, d):
    present = load(spark, d, "documents").where("source is not null").select(F.concat(F.lit("/archive/"), "source").alias("root_path"))
    return lifecycle.registry_prune(_registry(spark, d), present).select("scope_id")


def scope_conflicts(spark, d):
    r = _registry(spark, d)
    return lifecycle.conflicting_scopes(r.where("participates"), r.where("not indexed"))


def live_scopes(spark, d):
    """Scopes of the chunks that are registered, and those that have left."""
    r = _registry(spark, d).where("participates")
    c = load(spark, d, "chunks").select("scope_id").distinct()
    return c.join(r, "scope_id", "left_semi").select("scope_id", F.lit("live").alias("state")).unionByName(c.join(r, "scope_id", "left_anti").select("scope_id", F.lit("departed").alias("state")))


def restore_plan(spark, d):
    """Restores by raw hash, by path and by commit of the smallest cited ones, with the state of each file."""
    p = load(spark, d, "evidence_pointers").where("commit_hash <> '' and raw_hash <> '' and path_at_commit is not null").select(F.col("path_at_commit").alias("path"), "raw_hash", "commit_hash").distinct()
    m = p.agg(F.min("raw_hash").alias("r"), F.min("path").alias("p"), F.min("commit_hash").alias("c"))
    none = F.lit(None).cast("string")
    asked = m.select(F.explode(F.array(F.struct(F.col("r").alias("raw_hash"), none.alias("path"), none.alias("commit_hash")), F.struct(none.alias("raw_hash"), F.col("p").alias("path"), none.alias("commit_hash")), F.struct(none.alias("raw_hash"), none.alias("path"), F.col("c").alias("commit_hash")))).alias("x")).select("x.*")
    return lifecycle.restore_lookup(asked, p, load(spark, d, "raw_objects"))


def legacy_import(spark, d):
    r = _rows(spark, d).select(F.col("event_type").alias("source"), F.col("user_id").alias("key"), "cents")
    have = r.where("source = 'purchase'").select("key").distinct()
    old = r.where("source in ('view', 'click', 'error')")
    return lifecycle.import_once(have, old, spark.createDataFrame([("click",)], "source string"), ["key"]).select("key", "source", "cents")


def log_rotation(spark, d):
    e = lifecycle.rotated(load(spark, d, "events"), "ts", F.lit("2024-01-31").cast("date"), 14)
    return e.groupBy("day", "dropped").agg(F.count("*").alias("n"))


def pinned_trees(spark, d):
    r = load(spark, d, "raw_objects").select("scope_id", F.col("raw_hash").alias("path"), F.col("media_type").alias("raw_hash")).distinct()
    m = r.where("scope_id <> 'delta-audits' or raw_hash <> 'application/pdf'").withColumn("raw_hash", F.when(F.col("scope_id") == "meadow-grants", F.lit("x")).otherwise(F.col("raw_hash")))
    t = lifecycle.pinned_tree(r, m)
    return t.select("scope_id", F.size("tree").alias("entries"), "error")


def insert_or_ignore(spark, d):
    c = load(spark, d, "chunks")
    have = c.where("gen = 0").select("raw_hash").distinct()
    return lifecycle.insert_missing(have, c.where("gen > 0").select("raw_hash", "raw_path"), ["raw_hash"])


def association_checks(spark, d):
    """Associations of chunks with configurations: those published and eligible, their greatest number, 0 for none."""
    c = load(spark, d, "chunks").dropDuplicates(["chunk_hash"]).join(load(spark, d, "chunking_configs").select("chunking_config_hash"), "chunking_config_hash", "left_semi")
    g = c.groupBy("scope_id").agg(F.coalesce(F.max(F.when(F.col("first_seen_commit").isNotNull(), F.col("byte_end"))), F.lit(0)).alias("greatest"), F.count_if(F.col("first_seen_commit").isNotNull() & (F.col("byte_end") <= 1500)).alias("eligible"))
    return g


_CAP = "c AS (SELECT month, sum(cents) AS s FROM r WHERE event_type = 'purchase' GROUP BY 1)"
_MONTHS = "(SELECT DISTINCT month FROM r WHERE event_type = 'purchase')"
_TOTALS = f"""t AS (
  SELECT month, 'device' AS layer, '' AS key, (SELECT coalesce(sum(cents), 0) FROM r x WHERE x.event_type = 'purchase' AND x.month = m.month) + (SELECT coalesce(sum(cents), 0) FROM r x WHERE x.event_type = 'signup') AS spent FROM {_MONTHS} m
  UNION ALL SELECT m.month, 'folder', k.scope_id, (SELECT coalesce(sum(cents), 0) FROM r x WHERE x.event_type = 'purchase' AND x.month = m.month AND x.scope_id = k.scope_id) + (SELECT coalesce(sum(cents), 0) FROM r x WHERE x.event_type = 'signup' AND x.scope_id = k.scope_id) FROM {_MONTHS} m, (SELECT DISTINCT scope_id FROM r WHERE event_type IN ('purchase', 'signup')) k
  UNION ALL SELECT m.month, 'per_adapter', k.adapter_kind, (SELECT coalesce(sum(cents), 0) FROM r x WHERE x.event_type = 'purchase' AND x.month = m.month AND x.adapter_kind = k.adapter_kind) + (SELECT coalesce(sum(cents), 0) FROM r x WHERE x.event_type = 'signup' AND x.adapter_kind = k.adapter_kind) FROM {_MONTHS} m, (SELECT DISTINCT adapter_kind FROM r WHERE event_type IN ('purchase', 'signup')) k)"""
_LEVEL = "epoch(TIMESTAMP '2026-01-01') - epoch(created_at)"
_LIFE = "l AS (SELECT raw_hash, marker, row_number() OVER (PARTITION BY raw_hash, marker ORDER BY lifecycle_at, stored_at, kind) AS n, kind, lifecycle_at AS moment FROM (SELECT DISTINCT raw_hash, CASE WHEN lifecycle_kind = 'erased' THEN 'receipt' ELSE 'tombstone' END AS marker, lifecycle_kind AS kind, lifecycle_at, stored_at FROM raw_objects WHERE lifecycle_kind IS NOT NULL))"
_REG = "g AS (SELECT scope_id, '/archive/' || scope_id AS root_path, count(*) % 3 <> 0 AS participates, count(*) % 2 = 0 AS indexed FROM commits GROUP BY 1)"
_FINAL = "SELECT scope_id, raw_hash, arg_max(lifecycle_kind, (lifecycle_at, lifecycle_kind IN ('purged', 'erased'), lifecycle_kind)) AS state FROM raw_objects WHERE lifecycle_kind IS NOT NULL GROUP BY 1, 2"
SQL = {
    "ledger_month_total": f"WITH {_R}, {_TOTALS} SELECT 'device' AS filter, month, spent::BIGINT AS spent FROM t WHERE layer = 'device' UNION ALL SELECT 'scope s3', month, spent::BIGINT FROM t WHERE layer = 'folder' AND key = 's3' UNION ALL SELECT 'embedding', month, spent::BIGINT FROM t WHERE layer = 'per_adapter' AND key = 'embedding' UNION ALL SELECT 'each ' || key, month, spent::BIGINT FROM t WHERE layer = 'folder'",
    "ledger_cap_check": f"""WITH {_R}, {_TOTALS}, caps AS (SELECT layer, max(spent) + CASE layer WHEN 'device' THEN 40000 WHEN 'folder' THEN 100 ELSE 2000 END AS cap FROM t GROUP BY 1),
        x AS (SELECT event_id, month, scope_id, adapter_kind, CASE WHEN event_id % 10 = 0 THEN 0 ELSE cents END AS cents FROM r WHERE event_type = 'click')
        SELECT event_id, cents, CASE WHEN cents = 0 THEN 'exempt'
          WHEN coalesce((SELECT spent FROM t WHERE layer = 'device' AND t.month = x.month), 0) + cents >= (SELECT cap FROM caps WHERE layer = 'device') THEN 'denied_device'
          WHEN coalesce((SELECT spent FROM t WHERE layer = 'folder' AND t.month = x.month AND key = x.scope_id), 0) + cents >= (SELECT cap FROM caps WHERE layer = 'folder') THEN 'denied_folder'
          WHEN coalesce((SELECT spent FROM t WHERE layer = 'per_adapter' AND t.month = x.month AND key = x.adapter_kind), 0) + cents >= (SELECT cap FROM caps WHERE layer = 'per_adapter') THEN 'denied_per_adapter' ELSE 'allowed' END AS verdict FROM x""",
    "latest_by_path": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "retention_kept": f"""
        WITH c AS (SELECT DISTINCT ON (commit_hash) * FROM commits), tips AS (SELECT arg_max(commit_hash, (created_at, commit_hash)) AS commit_hash FROM c GROUP BY scope_id),
        l AS (SELECT *, CASE WHEN {_LEVEL} < 86400 THEN 0 WHEN {_LEVEL} < 7 * 86400 THEN 1 WHEN {_LEVEL} < 28 * 86400 THEN 2 WHEN {_LEVEL} < 180 * 86400 THEN 3 ELSE 4 END AS level FROM c),
        k AS (SELECT *, row_number() OVER (PARTITION BY scope_id, commit_type, level, CASE level WHEN 1 THEN date_trunc('hour', created_at) WHEN 2 THEN date_trunc('day', created_at)::TIMESTAMP WHEN 3 THEN date_trunc('week', created_at)::TIMESTAMP END ORDER BY created_at DESC, commit_hash DESC) AS last,
          row_number() OVER (PARTITION BY scope_id, commit_type ORDER BY created_at DESC, commit_hash DESC) AS nth FROM l)
        SELECT commit_hash, CASE WHEN commit_hash IN (FROM tips) THEN true WHEN commit_type = 'auto' THEN level = 0 OR (level < 4 AND last = 1) WHEN commit_type IN ('migrated', 'repaired') THEN nth <= 5 ELSE true END AS kept FROM k""",
    "percentile_nearest_rank": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, " + ", ".join(f"max(value) FILTER (rn = ceil(n * {p} / 100)) AS p{p}" for p in (50, 95, 99)) + ", min(value) AS least, max(value) AS most FROM r GROUP BY 1",
    "cost_preview": "WITH g AS (SELECT scope_id, sum(CASE WHEN media_type IN ('text/markdown', 'text/plain', 'text/x-code') THEN 0 ELSE coalesce(byte_size, 0) END) AS b, sum(coalesce(byte_size, 0)) AS a FROM (SELECT DISTINCT ON (raw_hash) * FROM raw_objects) GROUP BY 1) SELECT scope_id, ceil(b / 3000)::BIGINT AS pages, (a / 4)::DOUBLE AS tokens, ceil(b / 3000)::BIGINT * 2 AS page_cost, (a / 4)::DOUBLE AS token_cost FROM g",
    "billed_amount": f"""
        WITH {_R}, u AS (SELECT user_id || '/' || strftime(ts, '%m-%d') AS id, CASE WHEN k > 96 THEN 'images' ELSE ['pages', 'tokens_in', 'tokens_out'][k % 3 + 1] END AS kind, CASE WHEN k <> 13 THEN k END AS n, cents FROM r),
        g AS (SELECT id, bool_and(coalesce(kind <> 'images' AND n >= 0, false)) AND count(kind) = count(DISTINCT kind) AS ok, sum(n * CASE kind WHEN 'pages' THEN 20 WHEN 'tokens_in' THEN 1 ELSE 4 END) AS total, max(cents) AS est FROM u GROUP BY 1)
        SELECT id, (CASE WHEN ok THEN total ELSE est END)::BIGINT AS billed, NOT ok AS estimated FROM g""",
    "task_rollup": f"WITH {_R}, g AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'error') AS failed, bool_or(k = 99) AS blocked FROM r GROUP BY 1, 2) SELECT user_id, day, CASE WHEN blocked OR (done = 0 AND failed > 0) THEN 'failed' WHEN done > 0 AND failed > 0 THEN 'partial' WHEN done > 0 THEN 'done' ELSE 'pending' END AS state FROM g",
    "retry_classes": f"""
        WITH {_R}, t AS (SELECT event_id, [{', '.join(f"'{x}'" for x in _REASONS)}][event_id % 7 + 1] AS reason, k % 6 AS attempts FROM r WHERE event_type = 'error'), x AS (SELECT *, CASE reason WHEN 'odd' THEN 'contract_violation' ELSE reason END AS kind FROM t)
        SELECT event_id, kind, CASE kind WHEN 'network_error' THEN 'exp(base=2s,cap=60s,full_jitter)' WHEN 'rate_limit' THEN 'retry_after' WHEN 'auth_error' THEN 'user_action' WHEN 'quota_exceeded' THEN 'fixed(1h)' WHEN 'invalid_input' THEN 'none' WHEN 'contract_violation' THEN 'immediate' ELSE 'override_budget_required' END AS backoff,
          kind IN ('auth_error', 'budget_exceeded') AS paused, CASE kind WHEN 'network_error' THEN attempts < 5 WHEN 'rate_limit' THEN true WHEN 'quota_exceeded' THEN attempts < 3 WHEN 'contract_violation' THEN attempts < 1 ELSE false END AS retry, NOT CASE kind WHEN 'network_error' THEN attempts < 5 WHEN 'rate_limit' THEN true WHEN 'quota_exceeded' THEN attempts < 3 WHEN 'contract_violation' THEN attempts < 1 ELSE false END AS terminal FROM x""",
    "hold_reasons": f"SELECT reason, CASE reason WHEN 'budget_exceeded' THEN 'budget' WHEN 'secrets_tier_b' THEN 'tier_b_approval' WHEN 'auth_error' THEN 'auth' END AS hold, count(*) AS n FROM (SELECT [{', '.join(chr(39) + x + chr(39) for x in [*_REASONS, 'secrets_tier_b'])}][event_id % 8 + 1] AS reason FROM events) GROUP BY 1",
    "task_machine": f"""
        WITH {_R}, s AS (SELECT *, {_STATE} AS state FROM r), b AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'none') AS before FROM s)
        SELECT user_id, arg_max(state, (ts, event_id)) AS state, count(*) FILTER (NOT (before = state OR (before = 'none' AND state = 'pending') OR (before, state) IN ({', '.join(f"('{a}', '{b}')" for a, b in ledger.STEPS)}))) AS violations, count(*) AS events FROM b GROUP BY 1""",
    "stale_reservations": f"WITH {_R}, {_Q} SELECT event_id FROM q WHERE request_kind = 'sync' AND state IN (0, 1) AND (stale_after_at IS NULL OR stale_after_at <= TIMESTAMP '2024-01-20')",
    "recovery_and_poll": f"WITH {_R}, {_Q} SELECT 'recovery' AS lane, event_id FROM q WHERE request_kind = 'batch' AND (state IN (0, 1) OR (state IN (2, 3) AND intent_token IS NOT NULL)) UNION ALL SELECT 'poll', event_id FROM q WHERE request_kind = 'batch' AND state IN (0, 1) AND batch_job_id IS NOT NULL",
    "sweep_topk": f"""
        WITH {_R}, e AS (SELECT * FROM r WHERE event_type = 'error'), n AS (SELECT count(*) FILTER (k < 3) AS p, count(*) FILTER (k >= 3) AS g FROM e WHERE user_id <> 7), c AS (SELECT least(g, 40 - least(10, p)) AS gen, least(p, 40 - least(g, 40 - least(10, p))) AS prn FROM n),
        x AS (SELECT event_id, CASE WHEN user_id = 7 THEN 'own' WHEN k < 3 THEN 'prune' ELSE 'general' END AS pool FROM e), y AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY event_id) AS n FROM x)
        SELECT pool, event_id FROM y, c WHERE n <= CASE pool WHEN 'own' THEN 8 WHEN 'prune' THEN prn ELSE gen END""",
    "submit_once": f"WITH {_R} SELECT user_id AS key, k AS seq, min(ts) AS at FROM r WHERE event_type IN ('click', 'view') AND NOT EXISTS (SELECT 1 FROM r s WHERE s.event_type = 'purchase' AND s.user_id = r.user_id AND s.k = r.k) GROUP BY 1, 2",
    "submission_seq": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, count(*) OVER (PARTITION BY user_id) + 1 AS next_seq FROM events WHERE event_type = 'error'",
    "budget_warnings": f"""
        WITH {_R}, g AS (SELECT scope_id, sum(cents) AS folder, sum(CASE WHEN adapter_kind = 'embedding' THEN cents ELSE 0 END) AS device FROM r WHERE event_type = 'purchase' GROUP BY 1), p AS (SELECT scope_id, device * 100.0::DOUBLE / 300000 AS dp, folder * 100.0::DOUBLE / 1000000 AS fp FROM g)
        SELECT scope_id, CASE WHEN dp >= 80 AND dp >= fp THEN 'device budget at ' || round(dp)::BIGINT || '% of cap' WHEN fp >= 80 THEN 'folder budget at ' || round(fp)::BIGINT || '% of cap' END AS warning FROM p""",
    "jobs_reconcile": f"WITH {_R}, {_Q}, p AS (SELECT DISTINCT 'job-' || event_id AS job_id FROM q WHERE event_id % 3 <> 0), o AS (SELECT DISTINCT batch_job_id AS job_id FROM q WHERE batch_job_id IS NOT NULL) SELECT CASE WHEN p.job_id IS NULL THEN 'unknown' WHEN o.job_id IS NULL THEN 'orphan' ELSE 'known' END AS state, count(*) AS n FROM p FULL JOIN o ON o.job_id = p.job_id GROUP BY 1",
    "promotions": "WITH p AS (SELECT DISTINCT ON (image_hash) * FROM page_images) SELECT raw_hash AS instance FROM p GROUP BY 1 HAVING bool_and(coalesce(confidence > 0.5, false)) AND count(DISTINCT page_no) = count(*)",
    "batch_answers": f"""
        WITH {_R}, {_Q}, b AS (SELECT scope_id AS batch, event_id::VARCHAR AS key, state FROM q), a AS (SELECT DISTINCT batch, CASE WHEN batch = 's5' AND state = 0 THEN 'strange' ELSE key END AS key FROM b WHERE state < 4 OR batch <> 's3'), j AS (SELECT coalesce(b.batch, a.batch) AS batch, b.key AS asked, a.key AS got FROM (SELECT DISTINCT batch, key FROM b) b FULL JOIN a ON a.batch = b.batch AND a.key = b.key)
        SELECT batch, count(asked) AS asked, count(got) FILTER (asked IS NOT NULL) AS answered, CASE WHEN count(*) FILTER (asked IS NULL) > 0 THEN 'contract_violation' WHEN count(got) FILTER (asked IS NOT NULL) < count(asked) THEN 'incomplete' ELSE 'done' END AS state FROM j GROUP BY 1""",
    "run_outcomes": f"WITH {_R}, g AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS d, count(*) FILTER (event_type = 'error' AND k < 50) AS r, count(*) FILTER (event_type = 'error' AND k >= 50) AS p FROM r GROUP BY 1), o AS (SELECT user_id, CASE WHEN r + p = 0 THEN 'success' WHEN d = 0 AND r = 0 THEN 'permanent_failure' ELSE 'partial_failure' END AS outcome FROM g) SELECT user_id, outcome, CASE outcome WHEN 'success' THEN 0 WHEN 'permanent_failure' THEN 4 ELSE 3 END AS code FROM o",
    "archive_limits": "WITH r AS (SELECT DISTINCT ON (raw_hash) * FROM raw_objects), w AS (SELECT scope_id, byte_size, count(*) OVER w AS n, sum(coalesce(byte_size, 0)) OVER w AS total FROM r WINDOW w AS (PARTITION BY scope_id ORDER BY raw_hash ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT scope_id, CASE WHEN byte_size > 2000000 THEN 'file' WHEN n > 100 THEN 'entries' WHEN total > 60000000 THEN 'scope' END AS over, count(*) AS n FROM w GROUP BY 1, 2",
    "coverage_gates": "WITH n AS (SELECT DISTINCT string_split(unit_key, ':')[1] AS kind, text_hash FROM chunks WHERE text_hash IS NOT NULL) SELECT kind, count(*) AS required, count(*) FILTER (text_hash IN (SELECT target_id FROM chunk_embeddings WHERE target_type = 'chunk')) AS recalled, count(*) = count(*) FILTER (text_hash IN (SELECT target_id FROM chunk_embeddings WHERE target_type = 'chunk')) AS passed FROM n GROUP BY 1",
    "enriched_ratio": "WITH c AS (SELECT DISTINCT scope_id, text_hash, text_hash IN (SELECT target_id FROM chunk_embeddings WHERE target_type = 'chunk') AS v FROM chunks WHERE text_hash IS NOT NULL) SELECT scope_id, round(count(*) FILTER (v) / count(*), 9) AS enriched, count(*) FILTER (NOT v) AS pending FROM c GROUP BY 1",
    "ocr_discovery": """
        WITH p AS (SELECT DISTINCT ON (image_hash) * FROM page_images), u AS (SELECT raw_hash, scope_id, page_no - min(page_no) OVER (PARTITION BY raw_hash) AS n, image_hash FROM p), w AS (SELECT *, row_number() OVER (PARTITION BY raw_hash ORDER BY n, (n + 1)::VARCHAR) AS place FROM u)
        SELECT raw_hash, CASE WHEN any_value(scope_id) = 'delta-audits' THEN 'unsupported_media' WHEN any_value(scope_id) = 'relay-runbooks' AND count(*) <> 1 THEN 'not_one_unit' WHEN NOT bool_and(n = place - 1) THEN 'not_contiguous' END AS error FROM w GROUP BY 1""",
    "task_owners": f"WITH {_R}, t AS (SELECT ['online', 'normalized_instance', 'offline', 'embedding', 'broken'][k % 5 + 1] AS kind, event_type, k FROM r) SELECT kind, CASE kind WHEN 'online' THEN 'online' WHEN 'normalized_instance' THEN CASE WHEN k % 2 = 0 AND (k % 3 = 0 OR event_type = 'purchase') THEN 'online' END WHEN 'offline' THEN 'offline' WHEN 'embedding' THEN 'embedding' END AS owner, count(*) AS n FROM t GROUP BY 1, 2",
    "layout_recovered": """
        WITH p AS (SELECT DISTINCT ON (image_hash) raw_hash, image_hash, page_no FROM page_images WHERE visible_text IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY raw_hash ORDER BY page_no, image_hash) AS n, page_no % 5 = 0 AS boxless, CASE WHEN page_no % 5 > 0 THEN page_no % 7 END AS y, CASE WHEN page_no % 5 > 0 THEN page_no % 3 END AS x FROM p)
        SELECT raw_hash, string_agg(image_hash, '|' ORDER BY boxless, y NULLS FIRST, x NULLS FIRST, n) AS recovered FROM n WHERE page_no % 4 <> 1 GROUP BY 1""",
    "corpus_attestation": "WITH c AS (SELECT DISTINCT ON (chunk_hash) * FROM chunks), a AS (SELECT scope_id, count(*) FILTER (first_seen_commit IS NOT NULL) AS eligible, count(text) FILTER (first_seen_commit IS NOT NULL) AS indexed, count(*) AS manifest FROM c GROUP BY 1) SELECT *, eligible = indexed AND indexed = manifest AS attested FROM a WHERE eligible > 0",
    "answer_oracle": f"""
        WITH f AS (SELECT DISTINCT finding_id, scope_id, unnest(affected_commits) AS commit_hash FROM object_findings), c AS (SELECT DISTINCT scope_id, commit_hash FROM commits), p AS (SELECT DISTINCT ON (pointer_id) * FROM evidence_pointers), o AS ({_FINAL})
        SELECT f.finding_id, o.state, count(*) AS pointers FROM f JOIN c ON c.scope_id = f.scope_id AND c.commit_hash = f.commit_hash JOIN p ON p.commit_hash = f.commit_hash JOIN o ON o.raw_hash = p.raw_hash GROUP BY 1, 2""",
    "event_grammar": f"WITH {_LIFE}, x AS (SELECT *, lag(moment) OVER (PARTITION BY raw_hash, marker ORDER BY n) AS last_at, CASE WHEN n % 2 = 0 THEN 'retired' WHEN marker = 'tombstone' THEN 'purged' ELSE 'erased' END AS want FROM l), e AS (SELECT *, CASE WHEN kind <> want THEN 'not_alternating' WHEN moment IS NULL THEN 'no_time' WHEN moment < last_at THEN 'time_goes_back' END AS error FROM x) SELECT raw_hash, marker, arg_min(error, n) AS error FROM e WHERE error IS NOT NULL GROUP BY 1, 2",
    "purge_phases": f"""
        WITH {_R}, e AS (SELECT user_id AS purge_id, CASE event_type WHEN 'view' THEN 1 WHEN 'signup' THEN 2 WHEN 'error' THEN 3 ELSE 4 END AS place, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM r WHERE event_type <> 'click'), s AS (SELECT *, place - coalesce(lag(place) OVER (PARTITION BY purge_id ORDER BY n), 0) AS step FROM e WHERE n <= 4)
        SELECT purge_id, ['prepared', 'tombstoned', 'deleted', 'committed'][arg_max(place, n)] AS phase, bool_and(step IN (0, 1)) AS monotone, arg_max(place, n) <> 4 AS active FROM s GROUP BY 1""",
    "read_barrier": "SELECT scope_id, count(DISTINCT chunk_hash) AS n FROM chunks WHERE scope_id NOT IN (SELECT scope_id FROM raw_objects WHERE lifecycle_kind = 'erased' AND lifecycle_at >= TIMESTAMP '2025-12-01' AND scope_id IS NOT NULL) GROUP BY 1",
    "store_findings": """
        WITH c AS (SELECT DISTINCT ON (chunk_hash) chunk_hash, text_hash, text FROM chunks WHERE text_hash IS NOT NULL), o AS (SELECT text_hash AS h, bool_and('sha256:' || sha256(text) = text_hash) AS sound FROM c WHERE text IS NOT NULL GROUP BY 1),
        r AS (SELECT c.text_hash AS h, count(DISTINCT p.commit_hash) AS n FROM (SELECT DISTINCT ON (pointer_id) * FROM evidence_pointers) p JOIN c USING (chunk_hash) WHERE p.commit_hash IN (SELECT commit_hash FROM commits) GROUP BY 1)
        SELECT CASE WHEN sound IS NULL THEN 'missing' WHEN NOT sound THEN 'corrupt' ELSE 'orphan' END AS kind, h AS object_hash, coalesce(n, 0)::INT AS n_affected FROM o FULL JOIN r USING (h) WHERE sound IS NULL OR NOT sound OR n IS NULL""",
    "prune_orphans": "SELECT DISTINCT scope_id, image_hash FROM page_images WHERE image_hash NOT IN (SELECT target_id FROM chunk_embeddings WHERE target_type = 'image' AND target_id IS NOT NULL) AND scope_id NOT IN (SELECT scope_id FROM object_findings WHERE finding_kind = 'tree_corrupt')",
    "registry_participating": f"WITH {_REG} SELECT root_path, scope_id FROM g WHERE participates AND indexed",
    "registry_prune": f"WITH {_REG} SELECT scope_id FROM g WHERE scope_id NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)",
    "scope_conflicts": f"WITH {_REG} SELECT scope_id FROM g WHERE participates AND NOT indexed",
    "live_scopes": f"WITH {_REG} SELECT DISTINCT scope_id, CASE WHEN scope_id IN (SELECT scope_id FROM g WHERE participates) THEN 'live' ELSE 'departed' END AS state FROM chunks",
    "restore_plan": """
        WITH p AS (SELECT DISTINCT path_at_commit AS path, raw_hash, commit_hash FROM evidence_pointers WHERE commit_hash <> '' AND raw_hash <> '' AND path_at_commit IS NOT NULL), m AS (SELECT min(raw_hash) AS r, min(path) AS p, min(commit_hash) AS c FROM p), h AS (SELECT DISTINCT p.path, p.raw_hash FROM p, m WHERE p.raw_hash = m.r OR p.path = m.p OR p.commit_hash = m.c),
        o AS (SELECT raw_hash, bool_or(coalesce(lifecycle_kind IN ('purged', 'erased'), false)) AS removed FROM raw_objects GROUP BY 1) SELECT h.path, h.raw_hash, CASE WHEN removed IS NULL THEN 'missing' WHEN removed THEN 'removed' ELSE 'ready' END AS state FROM h LEFT JOIN o USING (raw_hash)""",
    "legacy_import": f"WITH {_R}, x AS (SELECT event_type AS source, user_id AS key, cents FROM r WHERE event_type IN ('view', 'error') AND user_id NOT IN (SELECT user_id FROM r WHERE event_type = 'purchase')) SELECT key, source, cents FROM x QUALIFY row_number() OVER (PARTITION BY key ORDER BY source, cents) = 1",
    "log_rotation": "SELECT ts::DATE AS day, ts::DATE < DATE '2024-01-17' AS dropped, count(*) AS n FROM events GROUP BY 1, 2",
    "pinned_trees": """
        WITH r AS (SELECT DISTINCT scope_id, raw_hash AS path, media_type FROM raw_objects), f AS (SELECT scope_id, path, max(media_type) AS h, count(*) AS n FROM r GROUP BY 1, 2)
        SELECT scope_id, CASE WHEN scope_id = 'meadow-grants' OR (scope_id = 'delta-audits' AND bool_or(h = 'application/pdf')) OR max(n) > 1 THEN NULL ELSE count(*) END::INT AS entries,
          CASE WHEN max(n) > 1 THEN 'repeated' WHEN scope_id = 'meadow-grants' THEN 'changed' WHEN scope_id = 'delta-audits' AND bool_or(h = 'application/pdf') THEN 'unlisted' END AS error FROM f GROUP BY scope_id""",
    "insert_or_ignore": "SELECT raw_hash, min(raw_path) AS raw_path FROM chunks WHERE gen > 0 AND raw_hash NOT IN (SELECT raw_hash FROM chunks WHERE gen = 0 AND raw_hash IS NOT NULL) GROUP BY 1",
    "association_checks": "WITH c AS (SELECT DISTINCT ON (chunk_hash) * FROM chunks WHERE chunking_config_hash IN (SELECT chunking_config_hash FROM chunking_configs)) SELECT scope_id, coalesce(max(byte_end) FILTER (first_seen_commit IS NOT NULL), 0) AS greatest, count(*) FILTER (first_seen_commit IS NOT NULL AND byte_end <= 1500) AS eligible FROM c GROUP BY 1",
}
QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")}
