"""References to records that do not exist (orphan references).

``find_orphans`` reduces the references to distinct non-null keys before they meet the parents, decides each key once
against the pre-aggregated parents (left anti join for keys that lead nowhere, a verdict for removed and late
parents), and joins only the suspicious keys back to the narrow reference rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def references(df: DataFrame, table: str, field: str, rowid: str, scope: str, key: Column, at: str) -> DataFrame:
    """Uniform reference rows. Null and empty keys are no references; a null scope or time stays null."""
    return df.select(
        F.lit(table).alias("ref_table"),
        F.lit(field).alias("ref_field"),
        F.col(rowid).cast("bigint").alias("ref_rowid"),
        F.col(scope).alias("scope"),
        key.alias("ref_key"),
        F.col(at).alias("at"),
    ).where("ref_key is not null and ref_key <> ''")


def parents(df: DataFrame, field_names: list[str], key: str, scope: str, stored_at: str, removed: Column | None = None) -> DataFrame:
    """One row per (field, scope, key): when the key was first stored and whether its record is gone."""
    gone = F.lit(False) if removed is None else F.coalesce(removed, F.lit(False))
    return (
        df.select(F.col(scope).alias("scope"), F.col(key).alias("ref_key"), F.col(stored_at).alias("s"), gone.alias("g"))
        .where("ref_key is not null")
        .groupBy("scope", "ref_key")
        .agg(F.min("s").alias("first_stored"), F.max("g").alias("gone"))
        .withColumn("ref_field", F.explode(F.array(*[F.lit(x) for x in field_names])))
    )


def find_orphans(refs: DataFrame, known: DataFrame) -> DataFrame:
    """Reference rows whose key has no record, whose record came later, or whose record is removed.

    refs: rows of ``references``; known: rows of ``parents`` (or a union of several).
    Defined cases: a null ``at`` can only be an orphan through a missing or removed record, as no time lies
    before it; a reference with a null scope matches no record; a record whose stored_at is null everywhere
    counts as stored in time; repeated reference rows come out once; empty tables give no rows.
    """
    fks = refs.groupBy("ref_field", "scope", "ref_key").agg(F.min("at").alias("first_at"))
    keys = ["ref_field", "scope", "ref_key"]
    nowhere = fks.join(known, keys, "left_anti").select(*keys, F.lit(True).alias("always"), F.lit(None).cast("timestamp_ntz").alias("first_stored"))
    doubtful = (
        fks.join(known.withColumn("first_stored", F.col("first_stored").cast("timestamp_ntz")), keys)
        .where(F.col("gone") | (F.col("first_stored") > F.col("first_at")))
        .select(*keys, F.col("gone").alias("always"), "first_stored")
    )
    # A hot missing key may hold a third of all references, so both sides are salted; the key side is tiny.
    salt = F.pmod(F.xxhash64("ref_rowid"), F.lit(SALTS)).cast("int")
    bad = nowhere.unionByName(doubtful).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    r, b = refs.withColumn("salt", salt).alias("r"), bad.alias("b")
    on = (F.col("r.ref_field") == F.col("b.ref_field")) & F.col("r.scope").eqNullSafe(F.col("b.scope")) & (F.col("r.ref_key") == F.col("b.ref_key")) & (F.col("r.salt") == F.col("b.salt"))
    return (
        r.join(b, on)
        .where(F.col("b.always") | (F.col("b.first_stored") > F.col("r.at")))
        .select("r.ref_table", "r.ref_field", F.date_format("r.at", "yyyy-MM").alias("ref_month"), "r.ref_rowid", "r.ref_key")
        .distinct()
    )


def count_orphans(orphans: DataFrame) -> DataFrame:
    """Number of orphan references and of distinct missing keys per table, field and month."""
    return orphans.groupBy("ref_table", "ref_field", "ref_month").agg(F.count("*").alias("n_refs"), F.countDistinct("ref_key").alias("n_keys"))


def archive_references(pointers: DataFrame, findings: DataFrame) -> DataFrame:
    """The references of the archive's own tables: three fields of a pointer, one array field of a finding."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("key")) for f in ("chunk_hash", "raw_hash", "commit_hash")])  # one scan for all three
    each = pointers.select(F.lit("evidence_pointers").alias("ref_table"), F.col("pointer_id").cast("bigint").alias("ref_rowid"), F.col("scope_id").alias("scope"), F.col("cited_at").alias("at"), F.explode(fields).alias("f"))
    out = each.select("ref_table", F.col("f.field").alias("ref_field"), "ref_rowid", "scope", F.col("f.key").alias("ref_key"), "at").where("ref_key is not null and ref_key <> ''")
    elements = findings.select("finding_id", "scope_id", F.explode("affected_commits").alias("e"), "found_at")
    return out.unionByName(references(elements, "object_findings", "affected_commits", "finding_id", "scope_id", F.col("e"), "found_at"))


def archive_parents(chunks: DataFrame, raw_objects: DataFrame, commits: DataFrame) -> DataFrame:
    """Parent keys of those references; purged and erased objects are gone, retired ones are back."""
    return (
        parents(chunks, ["chunk_hash"], "chunk_hash", "scope_id", "stored_at")
        .unionByName(parents(raw_objects, ["raw_hash"], "raw_hash", "scope_id", "stored_at", F.col("lifecycle_kind").isin("purged", "erased")))
        .unionByName(parents(commits, ["commit_hash", "affected_commits"], "commit_hash", "scope_id", "stored_at"))
    )
