"""Removal life cycle and verification of citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def final_events(raw_objects: DataFrame) -> DataFrame:
    """The last lifecycle event of each object; at equal times a removal wins over a retirement."""
    removal = F.col("lifecycle_kind").isin("purged", "erased").cast("int")
    e = raw_objects.where("lifecycle_kind is not null")
    return e.groupBy("scope_id", "raw_hash").agg(F.max_by("lifecycle_kind", F.struct("lifecycle_at", removal, "lifecycle_kind")).alias("state"))


def verify_pointers(pointers: DataFrame, chunks: DataFrame, commits: DataFrame, raw_objects: DataFrame) -> DataFrame:
    """A verdict per pointer: scope_unreachable, unverifiable (commit unknown), tombstoned, not_found, mismatch, alive.

    Each parent is reduced to its keys before the join, so the wide pointer table is joined with narrow sides.
    """
    p = pointers.dropDuplicates(["pointer_id"])
    scopes = commits.select("scope_id").distinct().withColumn("has_scope", F.lit(True))
    known = commits.select("scope_id", "commit_hash").distinct().withColumn("has_commit", F.lit(True))
    state = final_events(raw_objects).select("scope_id", "raw_hash", "state")
    chunk = chunks.groupBy("scope_id", "chunk_hash").agg(F.first("raw_hash").alias("chunk_raw"))
    j = p.join(scopes, "scope_id", "left").join(known, ["scope_id", "commit_hash"], "left").join(state, ["scope_id", "raw_hash"], "left").join(chunk, ["scope_id", "chunk_hash"], "left")
    verdict = (
        F.when(F.col("has_scope").isNull(), "scope_unreachable")
        .when(F.col("has_commit").isNull(), "unverifiable")
        .when(F.col("state").isin("purged", "erased"), "tombstoned")
        .when(F.col("chunk_raw").isNull(), "not_found")
        .when(F.col("chunk_raw") != F.coalesce("raw_hash", F.lit("")), "mismatch")
        .otherwise("alive")
    )
    return j.select("pointer_id", "scope_id", verdict.alias("verdict"))


def orphan_vectors(embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk vectors whose text no chunk has any more (anti join on the content hash)."""
    return embeddings.where("target_type = 'chunk'").join(chunks.select(F.col("text_hash").alias("target_id")).where("target_id is not null").distinct(), "target_id", "left_anti")


def purge_cascade(raw_hashes: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """What a purge of objects removes: their chunks, and vectors of texts that no other object's chunk has."""
    gone = chunks.join(raw_hashes, "raw_hash", "left_semi")
    kept = chunks.join(raw_hashes, "raw_hash", "left_anti").select(F.col("text_hash").alias("target_id"))
    vectors = embeddings.join(gone.select(F.col("text_hash").alias("target_id")), "target_id", "left_semi").join(kept, "target_id", "left_anti")
    return gone.agg(F.lit("chunks").alias("kind"), F.countDistinct("chunk_hash").alias("n")).union(vectors.agg(F.lit("vectors"), F.countDistinct("vec_rowid")))


def upsert(base: DataFrame, delta: DataFrame, key: str, value: str) -> DataFrame:
    """Merge that keeps the greater value of a key."""
    b, x = base.select(key, F.col(value).alias("b")), delta.select(key, F.col(value).alias("x"))
    return b.join(x, key, "full_outer").select(key, F.greatest("b", "x").alias(value))


def event_errors(events: DataFrame) -> DataFrame:
    """raw_hash, marker, error: markers whose events do not begin with the marker's kind or do not alternate with 'retired'.

    events: raw_hash, marker (tombstone or receipt), n, kind, at, reason. Times must not go back and a removal needs
    a reason; the first broken rule of a marker is reported.
    """
    opening = F.when(F.col("marker") == "tombstone", "purged").otherwise("erased")
    w = Window.partitionBy("raw_hash", "marker").orderBy("n")
    place = F.row_number().over(w)
    e = events.withColumn("place", place).withColumn("last_at", F.lag("at").over(w))
    want = F.when(F.col("place") % 2 == 1, opening).otherwise("retired")
    error = F.when(F.col("kind") != want, "not_alternating").when(F.col("at").isNull(), "no_time").when(F.col("at") < F.col("last_at"), "time_goes_back").when((F.col("kind") != "retired") & (F.coalesce("reason", F.lit("")) == ""), "no_reason")
    return e.withColumn("error", error).where("error is not null").groupBy("raw_hash", "marker").agg(F.min_by("error", "place").alias("error"))


# Phases of a purge, in order.
PHASES = ["prepared", "tombstoned", "deleted", "committed"]


def purge_phases(journal: DataFrame) -> DataFrame:
    """purge_id, phase, monotone, active: the last phase of each purge, whether phases came one by one in order, and whether it still bars reads."""
    place = F.array_position(F.array(*[F.lit(p) for p in PHASES]), F.col("phase"))
    w = Window.partitionBy("purge_id").orderBy("n")
    j = journal.withColumn("place", place).withColumn("step", place - F.coalesce(F.lag(place).over(w), F.lit(0)))
    g = j.groupBy("purge_id").agg(F.max_by("phase", "n").alias("phase"), F.bool_and(F.col("step").isin(0, 1) & (F.col("place") > 0)).alias("monotone"))
    return g.withColumn("active", F.col("phase") != "committed")


def read_barrier(candidates: DataFrame, active: DataFrame) -> DataFrame:
    """Candidates of scopes without an active purge journal; to be applied before ranking and again before answering."""
    return candidates.join(active.select("scope_id").distinct(), "scope_id", "left_anti")


def findings(objects: DataFrame, references: DataFrame, commits: DataFrame) -> DataFrame:
    """kind, object_hash, affected: what a check of a store finds.

    objects: object_hash, content; references: object_hash, commit_hash. ``corrupt`` is an object whose content has
    another hash, ``missing`` one that references name and that is not there, ``orphan`` one that nothing names.
    ``affected`` are the known commits that name it, in order.
    """
    o = objects.select("object_hash", (F.concat(F.lit("sha256:"), F.sha2(F.col("content").cast("binary"), 256)) == F.col("object_hash")).alias("sound")).groupBy("object_hash").agg(F.bool_and("sound").alias("sound"))
    r = references.where("object_hash is not null and object_hash <> ''").join(commits.select("commit_hash").distinct(), "commit_hash", "left_semi")
    named = r.groupBy("object_hash").agg(F.array_sort(F.collect_set("commit_hash")).alias("affected"))
    j = o.join(named, "object_hash", "full_outer")
    kind = F.when(F.col("sound").isNull(), "missing").when(~F.col("sound"), "corrupt").when(F.col("affected").isNull(), "orphan")
    return j.withColumn("kind", kind).where("kind is not null").select("kind", "object_hash", F.coalesce("affected", F.array().cast("array<string>")).alias("affected"))


def prunable(stored: DataFrame, live: DataFrame, key: str, blocked: DataFrame) -> DataFrame:
    """Stored keys nothing live names, in scopes (scope_id) without an active journal or an open task."""
    return stored.join(live.select(key).distinct(), key, "left_anti").join(blocked.select("scope_id").distinct(), "scope_id", "left_anti")


def registry_prune(registry: DataFrame, present: DataFrame) -> DataFrame:
    """Registered scopes whose root is no longer present."""
    return registry.join(present.select("root_path").distinct(), "root_path", "left_anti")


def participating(registry: DataFrame) -> DataFrame:
    """Scopes that take part in search and are indexed, in order of root and id."""
    return registry.where("participates and indexed").orderBy("root_path", "scope_id")


def conflicting_scopes(active: DataFrame, excluded: DataFrame) -> DataFrame:
    """Scopes that are both active and excluded; a sound cursor has none."""
    return active.select("scope_id").intersect(excluded.select("scope_id"))


def insert_missing(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` to append so that each key is there once; of repeated new rows the smallest stays."""
    rest = [c for c in new.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r_")).select(*keys, "r_.*") if rest else new.distinct()
    return once.join(stored.select(*keys).distinct(), keys, "left_anti")


def restore_lookup(asked: DataFrame, bindings: DataFrame, objects: DataFrame) -> DataFrame:
    """What a restore by evidence (raw_hash), path or commit would write: path, raw_hash and state (ready, removed, missing).

    asked: any of raw_hash, path, commit_hash, null where not asked for; every given one must agree.
    """
    on = F.lit(True)
    for c in ("raw_hash", "path", "commit_hash"):
        on = on & (F.col(f"a.{c}").isNull() | (F.col(f"a.{c}") == F.col(f"b.{c}")))
    hit = bindings.alias("b").join(F.broadcast(asked.alias("a")), on).select("b.path", "b.raw_hash").distinct()  # asked: the few requests of one command
    o = objects.groupBy("raw_hash").agg(F.bool_or(F.coalesce(F.col("lifecycle_kind").isin("purged", "erased"), F.lit(False))).alias("removed"))
    return hit.join(o, "raw_hash", "left").select("path", "raw_hash", F.when(F.col("removed").isNull(), "missing").when(F.col("removed"), "removed").otherwise("ready").alias("state"))


def import_once(ledger: DataFrame, legacy: DataFrame, markers: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a legacy log (source, keys, ...) to add to the ledger: those of sources without a marker, each key once."""
    return insert_missing(ledger, legacy.join(markers.select("source").distinct(), "source", "left_anti"), keys)


def rotated(rows: DataFrame, ts: str, today: Column, days: int) -> DataFrame:
    """Log rows with their daily partition and whether retention drops it."""
    day = F.to_date(ts)
    return rows.withColumn("day", day).withColumn("dropped", F.coalesce(day < F.date_sub(today, days), F.lit(False)))


def pinned_tree(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """scope_id, tree, error: the sorted entries of each scope's files where they are what the manifest pins; error names
    the first difference: repeated paths, changed, missing or unlisted files."""
    f = files.groupBy("scope_id", "path").agg(F.max("raw_hash").alias("raw_hash"), F.count("*").alias("n"))
    j = f.join(manifest.select("scope_id", "path", F.col("raw_hash").alias("pinned")), ["scope_id", "path"], "full_outer")
    error = F.when(F.col("n") > 1, "1 repeated").when(F.col("pinned").isNull(), "4 unlisted").when(F.col("raw_hash").isNull(), "3 missing").when(F.col("raw_hash") != F.col("pinned"), "2 changed")
    g = j.withColumn("error", error).groupBy("scope_id").agg(F.substring(F.min("error"), 3, 99).alias("error"), F.array_sort(F.collect_list(F.concat_ws(" ", "path", "raw_hash"))).alias("tree"))
    return g.select("scope_id", F.when(F.col("error").isNull(), F.col("tree")).alias("tree"), "error")
