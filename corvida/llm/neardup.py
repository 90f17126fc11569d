"""Near-duplicate records with small edits (problem 6).

Similarity is the Jaccard coefficient of the sets of five consecutive characters of the normalised texts.

1. Texts equal after normalisation are one class; what follows works on classes.
2. MinHash: ``BANDS`` bands of ``ROWS`` values; classes that share a band value are candidates. A pair at the
   threshold of 0.7 is missed with a probability of (1 - 0.7**4)**28 = 0.0005, one at 0.75 with 0.00003.
   A band value that more than ``HOT`` classes share is joined in blocks, each block pair its own key.
3. Sequential Bayesian verification: one-bit signatures are compared batch by batch; a candidate is dropped as
   soon as the posterior probability that its similarity reaches the threshold falls below ``miss``.
4. Survivors are verified exactly on their texts: runs of five characters are packed into one integer without loss.
5. Classes are expanded to records, or grouped by connected components.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvida.session import written

SHINGLE, BANDS, ROWS = 5, 28, 4
BITS, BATCH, MISS = 128, 64, 1e-5
VALUES = max(BANDS * ROWS, BITS)
HOT = 4096  # classes of one band value that are joined as one group
_RNG = np.random.default_rng(20240607)
_MULTIPLY = (_RNG.integers(0, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, VALUES, dtype=np.uint32)
_WHITE = re.compile(r"\s+")


def normalise(text: str) -> str:
    return _WHITE.sub(" ", text.lower()).strip()


def shingles(text: str) -> set[str]:
    return {text[i : i + SHINGLE] for i in range(len(text) - SHINGLE + 1)}


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and for each place where a run of SHINGLE characters of one text begins
    that place and the text's number."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    size = np.array([len(t) for t in texts], dtype=np.int64)
    runs = np.maximum(size - SHINGLE + 1, 0)
    owner = np.repeat(np.arange(len(texts)), runs)
    first = np.cumsum(size) - size
    return codes, np.repeat(first - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum()), owner


def _distinct_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 32-bit hashes of each text's runs, text after text, and how many each text has."""
    codes, at, owner = _codes(texts)
    h = np.zeros(len(at), np.uint64)
    for j, odd in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)):
        h += codes[at + j].astype(np.uint64) * np.uint64(odd)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    key = (owner.astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32))
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key.astype(np.uint32), np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=len(texts))


def signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """MinHash values [texts, VALUES] of texts that all have a shingle, and their numbers of shingles; worked in
    slices that stay in cache."""
    out, sizes = np.empty((len(texts), VALUES), np.uint32), np.empty(len(texts), np.int64)
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (size < 1 << 15 or end == at):
            size += len(texts[end])
            end += 1
        flat, n = _distinct_hashes(texts[at:end])
        sizes[at:end], starts = n, np.cumsum(n) - n
        for k in range(VALUES):
            v = flat * _MULTIPLY[k]
            v += _ADD[k]
            v ^= v >> np.uint32(15)
            out[at:end, k] = np.minimum.reduceat(v, starts)
        at = end
    return out, sizes


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, the band's number mixed in."""
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(sig), BANDS)).copy()
    for r in range(ROWS):
        keys ^= sig[:, : BANDS * ROWS].reshape(len(sig), BANDS, ROWS)[:, :, r].astype(np.uint64)
        keys *= np.uint64(0xFF51AFD7ED558CCD)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def bit_words(sig: np.ndarray) -> np.ndarray:
    """The first BITS values reduced to one mixed bit each, packed into 64-bit words."""
    v = sig[:, :BITS] * np.uint32(0x85EBCA6B)
    bits = ((v >> np.uint32(16)) & np.uint32(1)).astype(np.uint64).reshape(len(sig), BITS // 64, 64)
    return (bits << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64).view(np.int64)


@functools.cache
def least_matches(bits: int, threshold: float, miss: float = MISS) -> int:
    """The fewest equal bits of ``bits`` at which P(similarity >= threshold | matches) is at least ``miss``.

    A bit agrees with probability p = (1 + similarity) / 2; p is uniform on [0.5, 1] beforehand.
    """
    p = np.linspace(0.5, 1, 20001)[1:-1]
    for m in range(bits + 1):
        log = m * np.log(p) + (bits - m) * np.log1p(-p)
        w = np.exp(log - log.max())
        if w[p >= (1 + threshold) / 2].sum() / w.sum() >= miss:
            return m
    return bits


def may_match(a: str, b: str, threshold: float, miss: float = MISS) -> Column:
    """Step 3 as a column: batch after batch of signature words, and before them the bound that sizes set (sizes are
    counted on hashes, hence the slack)."""
    test = F.least(f"{a}.n", f"{b}.n") + 2 >= F.greatest(f"{a}.n", f"{b}.n") * (threshold - 0.001)
    equal = F.lit(0)
    for w in range(BITS // BATCH):
        equal = equal + F.lit(64) - F.bit_count(F.col(f"{a}.w{w}").bitwiseXOR(F.col(f"{b}.w{w}")))
        test = test & (equal >= least_matches((w + 1) * BATCH, threshold, miss))
    return test


def classes(records: DataFrame) -> DataFrame:
    """record, grp, cls, n (shingles), bands and signature words of each record with a text; written, as several steps read it."""
    words = BITS // 64

    def sign(batches):
        for batch in batches:
            record, grp, text = (batch.column(i).to_pylist() for i in range(3))
            norm = [normalise(t) for t in text]
            cls = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in norm]
            long = [i for i, t in enumerate(norm) if len(t) >= SHINGLE]
            bands, ws, n = [None] * len(norm), [[0] * len(norm) for _ in range(words)], [0] * len(norm)
            sig, sizes = signatures([norm[i] for i in long])
            keys, packed = band_keys(sig), bit_words(sig)
            for r, i in enumerate(long):
                bands[i] = keys[r]
                n[i] = int(sizes[r])
                for w in range(words):
                    ws[w][i] = int(packed[r, w])
            yield pa.RecordBatch.from_arrays(
                [pa.array(record, pa.string()), pa.array(grp, pa.string()), pa.array(cls, pa.binary()), pa.array(n, pa.int32()), pa.array(bands, pa.list_(pa.int64())), *(pa.array(w, pa.int64()) for w in ws)],
                names=["record", "grp", "cls", "n", "bands", *(f"w{w}" for w in range(words))],
            )

    schema = "record string, grp string, cls binary, n int, bands array<bigint>" + "".join(f", w{w} bigint" for w in range(words))
    return written(records.where("text is not null and record is not null").dropDuplicates(["record"]).mapInArrow(sign, schema), "p6")


def candidates(postings: DataFrame, threshold: float, miss: float) -> DataFrame:
    """a, b (a < b): classes that share a band value and pass step 3; a pair comes as often as it shares values.

    postings: key, cls, n and the signature words. Band values are counted first, with partial sums in every task;
    those of more than HOT classes are joined as a grid of blocks, so no group of unbounded size meets in one task.
    """
    hot = written(postings.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > HOT), "p6hot")
    cold = postings

    def meet(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
        a, b = rows.alias("a"), other.alias("b")
        on = (F.col("a.cls") < F.col("b.cls")) & may_match("a", "b", threshold, miss)
        for k in keys:
            on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
        return a.join(b, on).select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b"))

    found = None
    if hot.limit(1).count():
        cold = postings.join(hot, "key", "left_anti")
        grid = postings.join(hot, "key").withColumn("nb", F.ceil(F.col("c") / HOT).cast("int")).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        words = [c for c in postings.columns if c != "key"]
        found = meet(grid.select("key", *words, F.col("own").alias("i"), F.col("o").alias("j")), grid.select("key", *words, F.col("o").alias("i"), F.col("own").alias("j")), ["key", "i", "j"])
    # most band values occur once; counting them in the partition they are joined in drops those before the join
    shared = cold.withColumn("c", F.count("*").over(Window.partitionBy("key"))).where("c > 1").drop("c")
    near = meet(shared, shared, ["key"])
    return near if found is None else near.unionByName(found)


def _packed(texts: list[str]) -> list[np.ndarray] | None:
    """The distinct runs of SHINGLE characters of each text as integers, 12 bits a character, in order; None where
    the texts together have more than 4,096 different characters."""
    codes, at, owner = _codes(texts)
    alphabet = np.flatnonzero(np.bincount(codes, minlength=1)) if len(codes) else codes
    if len(alphabet) > 4096:
        return None
    place = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, np.uint64)
    place[alphabet] = np.arange(len(alphabet), dtype=np.uint64)
    dense, key = place[codes], np.zeros(len(at), np.uint64)
    for j in range(SHINGLE):
        key = (key << np.uint64(12)) | dense[at + j]
    parts = np.split(key, np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1])
    for k in parts:
        k.sort()
    return [k[np.concatenate([[True], k[1:] != k[:-1]])] if len(k) else k for k in parts]


def overlap(x: str, y: str) -> tuple[int, int]:
    """Common and all sequences of two normalised texts, for pairs whose characters do not fit the packed form."""
    packed = _packed([x, y])
    if packed is None:
        sx, sy = shingles(x), shingles(y)
        return len(sx & sy), len(sx | sy)
    return _common(*packed)


def _common(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    both = np.concatenate([x, y])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common, len(both) - common


def similar_classes(signed: DataFrame, records: DataFrame, threshold: float, miss: float = MISS) -> DataFrame:
    """Pairs (a, b) of different classes, a < b, whose exact similarity reaches the threshold; written."""
    words = [f"w{w}" for w in range(BITS // 64)]
    one = signed.where("n > 0").dropDuplicates(["cls"]).select("cls", "n", "bands", *words)
    postings = one.select(F.explode("bands").alias("key"), "cls", "n", *words)
    pairs = written(candidates(postings, threshold, miss).distinct(), "p6pairs")

    ids = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    texts = signed.select("cls", "record").join(ids, "cls", "left_semi").groupBy("cls").agg(F.min("record").alias("record")).join(records.select("record", "text").dropDuplicates(["record"]), "record").select("cls", "text")
    both = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b")
    top, low = int(round(threshold * 1000)), 1000

    def verify(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                a, b, ta, tb = (c.to_pylist() for c in batch.columns)
                held = dict(zip(a, ta)) | dict(zip(b, tb))  # a text takes part in several pairs; it is packed once
                norm = {k: normalise(t) for k, t in held.items()}
                packed = _packed(list(norm.values()))
                runs = dict(zip(norm, packed)) if packed is not None else {}
                found = [_common(runs[x], runs[y]) if runs else overlap(norm[x], norm[y]) for x, y in zip(a, b)]
                keep = [c * low >= top * u for c, u in found]
                sizes = [c / u if u else 1.0 for c, u in found]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.float64())], names=["a", "b", "similarity"]).filter(pa.array(keep, pa.bool_()))

    return written(both.select("a", "b", "ta", "tb").mapInArrow(verify, "a binary, b binary, similarity double"), "p6links")


def near_duplicates(records: DataFrame, threshold: float = 0.7, miss: float = MISS) -> tuple[DataFrame, DataFrame]:
    """(signed records, similar class pairs) of records (record, grp, text).

    ``miss`` is the posterior probability of reaching the threshold below which a candidate is dropped unverified.

    Defined cases: null texts take part in nothing; texts without a shingle (fewer than five characters) are
    similar only to texts equal after normalisation, at 1; a record delivered again counts once; ties do not
    matter as all pairs come out; an empty table gives no rows; texts of any length are compared whole.
    """
    signed = classes(records)
    return signed, similar_classes(signed, records, threshold, miss)


def record_pairs(signed: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of records of different non-null groups in one class or in similar classes, smaller record first."""
    who = signed.select("cls", "record", "grp").where("grp is not null")
    x, y = who.alias("x"), who.alias("y")
    copies = x.join(y, (F.col("x.cls") == F.col("y.cls")) & (F.col("x.record") < F.col("y.record")) & (F.col("x.grp") != F.col("y.grp"))).select(F.col("x.record").alias("p"), F.col("y.record").alias("q"))
    near = (
        links.join(who.select(F.col("cls").alias("a"), F.col("record").alias("p"), F.col("grp").alias("g")), "a")
        .join(who.select(F.col("cls").alias("b"), F.col("record").alias("q"), F.col("grp").alias("h")), "b")
        .where("g <> h")
        .select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
    )
    return copies.unionByName(near)


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(cls, label): label is the smallest class of the connected component. Labels spread to neighbours and then
    jump to their label's label, so the number of rounds grows with the logarithm of the longest path."""
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "p6edges")
    labels = written(edges.groupBy(F.col("a").alias("cls")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "p6labels")
    for _ in range(most_rounds):
        spread = edges.join(labels.select(F.col("cls").alias("b"), "label"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("label").alias("near"))
        least = labels.join(spread, "cls").select("cls", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("cls").alias("label"), F.col("label").alias("far"))
        new = written(least.join(jump, "label", "left").select("cls", F.least("label", F.coalesce("far", "label")).alias("label"), "old"), "p6labels")
        if not new.where("label <> old").limit(1).count():
            return new.select("cls", "label")
        labels = new.select("cls", "label")
    raise RuntimeError("components did not settle; raise most_rounds")


def groups(signed: DataFrame, links: DataFrame) -> DataFrame:
    """One row per record with a text: group (smallest class id of its component, in hex), size of the group in
    records, and the number of similar texts its own text has."""
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    of = signed.select("record", "cls").join(components(links), "cls", "left").join(degree, "cls", "left").select("record", F.hex(F.coalesce("label", "cls")).alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    sizes = of.groupBy("group_id").agg(F.count("*").alias("group_size"))
    return of.join(sizes, "group_id")
