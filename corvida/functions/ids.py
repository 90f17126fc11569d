"""Content ids: sha256 of bytes or of canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_id(text: Column) -> Column:
    """``sha256:`` and 64 hex digits of a string's or binary's bytes; null stays null."""
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def is_sha256_id(x: Column) -> Column:
    return F.coalesce(x.rlike("^sha256:[0-9a-f]{64}$"), F.lit(False))


def fan_out_path(x: Column) -> Column:
    """ab/cd/<64 hex digits> of an id."""
    digits = F.substring(x, 8, 64)
    return F.concat(F.substring(digits, 1, 2), F.lit("/"), F.substring(digits, 3, 2), F.lit("/"), digits)


def short_id(x: Column) -> Column:
    return F.substring(x, 8, 12)


def canonical_json(**fields: Column) -> Column:
    """Canonical JSON of an object: keys in order, absent (null) fields left out. For strings, integers and arrays."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "true"})


def chunking_config_id(strategy: Column, max_chars: Column) -> Column:
    return sha256_id(canonical_json(max_chars=max_chars.cast("bigint"), spec_version=F.lit(1), strategy=strategy))


def chunk_id(raw_hash: Column, tool_profile_hash: Column, gen: Column, unit_key: Column, heading_path: Column, section_id: Column, byte_start: Column, byte_end: Column) -> Column:
    """Identity of a chunk by where it comes from, not by its text."""
    return sha256_id(canonical_json(raw_hash=raw_hash, tool_profile_hash=tool_profile_hash, gen=gen.cast("bigint"), unit_key=unit_key, heading_path=heading_path, section_id=section_id, byte_start=byte_start, byte_end=byte_end, spec_version=F.lit(1)))


def unit_ref(unit_key: Column) -> Column:
    return F.substring(F.sha2(unit_key.cast("binary"), 256), 1, 16)


def idempotency_key(input_hash: Column, profile_hash: Column) -> Column:
    return sha256_id(F.concat(input_hash, F.lit("\x00"), profile_hash))


def set_digest(ids: Column) -> Column:
    """Digest of a set of ids, whatever their order: sorted, one per line."""
    return sha256_id(F.concat(F.array_join(F.array_sort(F.array_distinct(ids)), "\n"), F.lit("\n")))
