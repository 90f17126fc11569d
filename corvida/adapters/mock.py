"""Deterministic stand-ins for online adapters, as Arrow UDFs; and vectors as bytes."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType())


def seeded_vector(seed: str, width: int) -> np.ndarray:
    """Unit vector of a text: 32-bit words of sha256(text and a counter), mapped to [-1, 1], divided by its length in
    single precision."""
    words: list[bytes] = []
    for n in range(-(-width // 8)):
        words.append(hashlib.sha256(seed.encode() + n.to_bytes(4, "little")).digest())
    x = (np.frombuffer(b"".join(words), dtype="<u4")[:width] / float(0xFFFFFFFF) * 2.0 - 1.0).astype(np.float32)
    total = np.float32(0)
    for v in x * x:
        total += v
    length = np.sqrt(total)
    return x / length if length > 0 else x


def embed(width: int):
    """A function of a text column to vectors of ``width``; null texts have none."""

    @F.pandas_udf(VECTOR)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: seeded_vector(t, width).tolist(), na_action="ignore")

    return run


def fnv_score(query: str, text: str) -> float:
    """64-bit FNV-1a of query, NUL and text, scaled into [0, 1)."""
    h = 0xCBF29CE484222325
    for b in query.encode() + b"\0" + text.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return (h >> 11) / float(1 << 53)


@F.pandas_udf(T.DoubleType())
def rerank_score(queries: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([None if q is None or t is None else fnv_score(q, t) for q, t in zip(queries, texts)], dtype="float64")


@F.pandas_udf(T.BinaryType())
def vector_bytes(vectors: pd.Series) -> pd.Series:
    """Little-endian single precision."""
    return vectors.map(lambda v: np.asarray(v, dtype="<f4").tobytes(), na_action="ignore")


@F.pandas_udf(VECTOR)
def vector_of(blobs: pd.Series) -> pd.Series:
    """Back from bytes; a length that is no multiple of four is no vector."""
    return blobs.map(lambda b: np.frombuffer(bytes(b), dtype="<f4").tolist() if len(b) % 4 == 0 else None, na_action="ignore")


# Fields of a tool profile that its identity is made of.
PROFILE_FIELDS = ["adapter_kind", "adapter_role", "model_or_tool_family", "model_version_pin", "prompt_template_id", "prompt_template_hash", "sampling", "output_schema", "render_params", "dimensions", "distance", "modality", "input_construction", "runtime_kind", "spec_version"]


def profile_id(**fields: Column) -> Column:
    """Identity of a tool profile: its known fields that are not null, as canonical JSON, hashed; null for a pin that can move."""
    from corvida.functions.ids import canonical_json, sha256_id
    from corvida.functions.text import mutable_alias

    kept = {k: v for k, v in fields.items() if k in PROFILE_FIELDS}
    body = sha256_id(canonical_json(**kept))
    pin = fields.get("model_version_pin")
    return body if pin is None else F.when(~F.coalesce(mutable_alias(pin), F.lit(False)), body)
