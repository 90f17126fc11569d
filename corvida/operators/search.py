"""Evidence search for many queries at once: text lane (BM25), short lane, vector lane, fusion, diversification.

Statistics come from the whole collection, rows from the eligible part: eligibility is a semi join below the
top-k, never a filter above it. Every order is total, so results do not depend on partitioning.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from corvida.functions.text import filename_context
from corvida.functions.vectors import cosine, is_usable
from corvida.session import written

K1, B, HEADING_WEIGHT = 1.2, 0.75, 0.3


def corpus(chunks: DataFrame) -> DataFrame:
    """Searchable rows: scope_id, chunk_hash, raw_hash, created_at, lower-cased text and heading JSON, token counts."""
    heading = F.to_json(F.coalesce("heading_path", F.array().cast("array<string>")))
    tokens = lambda c: F.greatest(F.char_length(c) - 2, F.lit(0))
    return chunks.where("text is not null").select("scope_id", "chunk_hash", "raw_hash", "created_at", F.lower("text").alias("body"), F.lower(heading).alias("head"), (tokens(F.col("text")) + tokens(heading)).alias("size"))


def occurrences(haystack: Column, needle: str) -> Column:
    """Overlapping occurrences of a fixed string, by a lookahead."""
    first, rest = needle[0], needle[1:]
    quote = lambda s: "".join("\\" + ch if not ch.isalnum() else ch for ch in s)
    return F.regexp_count(haystack, F.lit(f"{quote(first)}(?={quote(rest)})" if rest else quote(first)))


def bm25(rows: DataFrame, queries: dict[str, list[str]], eligible: DataFrame | None = None, k: int = 10) -> DataFrame:
    """query_id, scope_id, chunk_hash, raw_hash, score (lower is better), rank.

    A phrase of three or more characters matches as a case-folded substring of text or heading; a query's phrases
    are OR-ed. ``eligible`` (chunk_hash) narrows the rows but not the statistics. One pass over the corpus counts all
    queries' phrases in codegen and takes the statistics on the way; texts are left behind before the rows are reduced
    to one a chunk, and only rows with a hit are written.
    """
    phrases = sorted({p.lower() for ps in queries.values() for p in ps if len(p) >= 3})
    counted = rows.select("scope_id", "chunk_hash", "raw_hash", "size", *[(occurrences(F.col("body"), p) + HEADING_WEIGHT * occurrences(F.col("head"), p)).alias(f"f{i}") for i, p in enumerate(phrases)])
    seen = Observation()
    counted = counted.dropDuplicates(["chunk_hash"]).observe(seen, F.count("*").alias("n"), F.avg("size").alias("avg_size"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(phrases))])
    any_hit = F.lit(False)
    for i in range(len(phrases)):
        any_hit = any_hit | (F.col(f"f{i}") > 0)
    hits = written(counted.where(any_hit), "hits")
    stats = seen.get
    n, avg_size = stats["n"], stats["avg_size"] or 1.0
    if eligible is not None:
        hits = hits.join(eligible.select("chunk_hash").distinct(), "chunk_hash", "left_semi")

    def part(i: int) -> Column:
        f, d = F.col(f"f{i}"), F.lit(float(stats[f"d{i}"]))
        idf = F.log((F.lit(float(n)) - d + 0.5) / (d + 0.5))
        return F.when(f > 0, F.when(idf > 0, idf).otherwise(1e-6) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("size") / F.lit(float(avg_size))))).otherwise(0.0)

    scored = F.array(*[F.struct(F.lit(q).alias("query_id"), (-sum((part(phrases.index(p.lower())) for p in ps if len(p) >= 3), F.lit(0.0))).alias("score")) for q, ps in queries.items()])
    flat = hits.select("scope_id", "chunk_hash", "raw_hash", F.explode(scored).alias("s")).select("scope_id", "chunk_hash", "raw_hash", "s.query_id", F.round("s.score", 9).alias("score")).where("score < 0")
    return ranked(flat, ["score", "scope_id", "chunk_hash"], k)


# Term pairs of two languages that stand for each other in queries; our own small dictionary.
TERMS = {"retention": "保存期間", "rollback": "復旧", "plan": "計画", "inventory": "棚卸表", "report": "報告書"}
_SEGMENT = re.compile(r"((?:[\u3041-\u309f]\u30fc*)+|[\u30a1-\u30fa\u30fc-\u30ff]+|[\u4e00-\u9fff々〆]+|[A-Za-z0-9]*[0-9](?:[.,][0-9](?:[A-Za-z0-9]*[0-9])?)*[.,][0-9][A-Za-z0-9]*|[A-Za-z0-9]+)")


def forms(unit: str) -> list[str]:
    """A unit and what it may be replaced by: the other spelling of a whole number, its term in the other language."""
    out = [unit]
    plain = unit.replace(",", "")
    if re.fullmatch(r"\d{4,}|\d{1,3}(?:,\d{3})+", unit) and len(plain) > 3:
        out.append(f"{int(plain):,}" if plain == unit else plain)
    other = TERMS | {b: a for a, b in TERMS.items()}
    if unit.lower() in other:
        out.append(other[unit.lower()])
    return out


def query_plan(query: str) -> tuple[list[str], list[list[str]]]:
    """(phrases, short tokens) of a query. Units are the tokens in NFC and their script pieces, each once. With a unit of
    three or more characters the phrases are those units and their forms, OR-ed, and shorter ones are dropped; with
    none the tokens go to the short lane, each with its forms. A query without tokens is an error."""
    tokens = unicodedata.normalize("NFC", query).split()
    if not tokens:
        raise ValueError("the query has no tokens")
    units = list(dict.fromkeys(u for t in tokens for u in (t, *_SEGMENT.findall(t))))
    long = [u for u in units if len(u) >= 3]
    phrases = list(dict.fromkeys(f for u in long for f in forms(u) if len(f) >= 3))
    return phrases, [] if long else [forms(t) for t in dict.fromkeys(tokens)]


def search_mode(asked: str, *, offline: bool = False, online_adapter: bool = False, same_profile: bool = True, consent: bool = True, in_flight: bool = False, sound: bool = True, vectors: bool = True, text: bool = True) -> tuple[str | None, str | None]:
    """(mode, reason for falling back) of a search; (None, reason) where nothing is left. The first reason that holds counts."""
    if asked != "auto":
        return asked, None
    reasons = [(offline and online_adapter, "offline"), (not same_profile, "vector_incompatible"), (online_adapter and not consent, "vector_unauthorized"), (in_flight, "embedding_in_flight"), (not sound, "embedding_contract_violation"), (not vectors, "vector_unavailable")]
    reason = next((r for holds, r in reasons if holds), None)
    if reason is None:
        return ("hybrid", None) if text else ("vector", None)
    return ("text", reason) if text else (None, reason)


def ranked(rows: DataFrame, order: list, k: int | None, by: str = "query_id") -> DataFrame:
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return out if k is None else out.where(F.col("rank") <= k)


def short_lane(rows: DataFrame, queries: dict[str, list[list[str]]], k: int = 10) -> DataFrame:
    """Queries of short tokens only: every token must occur in one of its forms; order by where the first form of
    the first token stands (0 where another form matched)."""
    each = []
    for q, tokens in queries.items():
        ok = F.lit(True)
        for forms in tokens:
            one = F.lit(False)
            for f in forms:
                one = one | F.col("body").contains(f.lower())
            ok = ok & one
        each.append(F.struct(F.lit(q).alias("query_id"), ok.alias("ok"), F.instr("body", tokens[0][0].lower()).alias("pos")))
    flat = rows.select("scope_id", "chunk_hash", F.explode(F.array(*each)).alias("s")).where("s.ok").select("scope_id", "chunk_hash", "s.query_id", "s.pos")
    return ranked(flat, ["pos", "scope_id", "chunk_hash"], k)


MOST_QUERIES = 1024  # query vectors that travel to all tasks at once


def knn(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Exact cosine top-k of each query vector (query_id, q) over rows (item, v); vectors of another width are passed over.

    The queries are counted: up to MOST_QUERIES are broadcast, more are cut into blocks that every row meets in turn.
    Partial top-k by range of items first, so no query's candidates meet in one task.
    """
    n = queries.count()
    fits = F.size("v") == F.size("q")
    if n <= MOST_QUERIES:
        near = rows.crossJoin(F.broadcast(queries)).where(fits)
    else:
        blocks = -(-n // MOST_QUERIES)
        block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
        near = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(queries.withColumn("block", block), "block").where(fits)
    near = near.select("query_id", "item", F.round(cosine(F.col("v"), F.col("q")), 9).alias("similarity"), F.pmod(F.xxhash64("item"), F.lit(64)).alias("part"))
    best = Window.partitionBy("query_id", "part").orderBy(F.desc("similarity"), "item")
    local = near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r", "part")
    return ranked(local, [F.desc("similarity"), "item"], k)


def _optional(df: DataFrame, name: str) -> Column:
    """A text column that older tables may lack."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string").alias(name)


def content_vectors(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """scope_id, chunk_hash, raw_hash, vector: each chunk's own vector among those of its text.

    One candidate is taken as it is; of several the one whose context is that of the chunk's file name, else the
    first by embedding_hash and vec_rowid. Broken vectors take no part.
    """
    v = embeddings.where("target_type = 'chunk'").where(is_usable(F.col("vector"), F.col("dimensions"))).select(F.col("target_id").alias("text_hash"), _optional(embeddings, "context_key"), _optional(embeddings, "embedding_hash"), "vec_rowid", "vector").dropDuplicates(["vec_rowid"])
    c = chunks.where("text_hash is not null").select("scope_id", "chunk_hash", "raw_hash", "text_hash", filename_context(_optional(chunks, "raw_path")).alias("want")).dropDuplicates(["chunk_hash"])
    order = F.struct((~F.col("context_key").eqNullSafe(F.col("want"))).cast("int"), "embedding_hash", "vec_rowid")
    j = c.join(v.drop("vector"), "text_hash").groupBy("scope_id", "chunk_hash", "raw_hash").agg(F.min_by("vec_rowid", order).alias("vec_rowid"))
    return j.join(v.select("vec_rowid", "vector"), "vec_rowid").select("scope_id", "chunk_hash", "raw_hash", "vector")


def image_chunks(images: DataFrame, chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """scope_id, image_hash, raw_hash, chunk_hash: the lowest chunk that cites each image: of the same object, or by the
    given columns."""
    by = by or ["scope_id", "raw_hash"]
    c = chunks.groupBy(*by).agg(F.min("chunk_hash").alias("chunk_hash"))
    return images.select("scope_id", "image_hash", "raw_hash").distinct().join(c, by).select("scope_id", "image_hash", "raw_hash", "chunk_hash")


def vector_rows(chunks: DataFrame, images: DataFrame, embeddings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """scope_id, row_id, chunk_hash, raw_hash, v: the vectors of chunks and images in one space (one profile's).

    The searched profile is the cosine one with the most chunk vectors.
    """
    cos = embeddings.where("distance = 'cosine'")
    profile = cos.where("target_type = 'chunk'").groupBy("profile_hash").count().orderBy(F.desc("count"), "profile_hash").limit(1).select("profile_hash")
    v = cos.join(F.broadcast(profile), "profile_hash", "left_semi")
    own = content_vectors(chunks, v).select("scope_id", F.col("chunk_hash").alias("row_id"), "chunk_hash", "raw_hash", F.col("vector").alias("v"))
    seen = v.where("target_type = 'image'").where(is_usable(F.col("vector"), F.col("dimensions"))).groupBy(F.col("target_id").alias("image_hash")).agg(F.min_by("vector", "vec_rowid").alias("v"))
    shown = image_chunks(images, chunks, by).join(seen, "image_hash").select("scope_id", F.col("image_hash").alias("row_id"), "chunk_hash", "raw_hash", "v")
    return own.unionByName(shown)


def query_vectors(embeddings: DataFrame, names: list[str], rows: DataFrame, text: DataFrame) -> DataFrame:
    """query_id, q: cached query vectors of the searched profile's width in order of age of their ids, one a query;
    a query without one takes the vector of its best text hit that has one, and has no vector lane without that."""
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    cached = embeddings.where("target_type = 'query_cache' and distance = 'cosine'").where(is_usable(F.col("vector"), F.col("dimensions")) & (F.size("vector") == width)).select("vec_rowid", "vector").orderBy("vec_rowid").limit(len(names)).collect()
    spark = rows.sparkSession
    given = spark.createDataFrame([(n, list(r.vector)) for n, r in zip(sorted(names), cached)], "query_id string, given array<float>")
    hit = text.select("query_id", "chunk_hash", "rank").join(rows.where("row_id = chunk_hash").select("chunk_hash", "v"), "chunk_hash").groupBy("query_id").agg(F.min_by("v", "rank").alias("best"))
    return given.join(hit, "query_id", "full_outer").select("query_id", F.coalesce("given", "best").alias("q"))


def vector_lane(rows: DataFrame, queries: DataFrame, k: int = 200) -> DataFrame:
    """query_id, scope_id, row_id, chunk_hash, raw_hash, similarity, rank over vector_rows, chunks and images in one
    sequence; ties by scope, row and chunk. The few query vectors of a search are broadcast."""
    near = rows.crossJoin(F.broadcast(queries)).where(F.size("v") == F.size("q")).select("query_id", "scope_id", "row_id", "chunk_hash", "raw_hash", F.round(cosine(F.col("v"), F.col("q")), 9).alias("similarity"))
    part = F.pmod(F.xxhash64("row_id"), F.lit(64))
    order = [F.desc("similarity"), "scope_id", "row_id", "chunk_hash"]
    local = near.withColumn("part", part).withColumn("r", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order))).where(F.col("r") <= k).drop("r", "part")
    return ranked(local, order, k)


def assemble(text: DataFrame, vector: DataFrame) -> DataFrame:
    """query_id, scope_id, row_id, chunk_hash, raw_hash, t_rank, v_rank: the union of both lanes by row; an image takes
    the text rank of the chunk that cites it."""
    t = text.select("query_id", "scope_id", "chunk_hash", F.col("raw_hash").alias("t_raw"), F.col("rank").alias("t_rank"))
    v = vector.select("query_id", "scope_id", "row_id", "chunk_hash", F.col("raw_hash").alias("v_raw"), F.col("rank").alias("v_rank"))
    own = t.withColumn("row_id", F.col("chunk_hash")).join(v, ["query_id", "scope_id", "row_id", "chunk_hash"], "full_outer")
    heir = t.select("query_id", "scope_id", "chunk_hash", F.col("t_rank").alias("heir"))
    j = own.join(heir, ["query_id", "scope_id", "chunk_hash"], "left")
    return j.select("query_id", "scope_id", "row_id", "chunk_hash", F.coalesce("t_raw", "v_raw").alias("raw_hash"), F.coalesce("t_rank", F.when(F.col("row_id") != F.col("chunk_hash"), F.col("heir"))).alias("t_rank"), "v_rank")


def fuse(rows: DataFrame, k: int = 60, w_text: float = 1.0, w_vector: float = 1.0, depth: int = 200) -> DataFrame:
    """Adds score and rank by reciprocal ranks; a missing rank or one behind ``depth`` counts nothing, ties go by chunk and row."""
    part = lambda w, r: F.when(F.col(r) <= depth, F.lit(w) / (F.lit(float(k)) + F.col(r))).otherwise(F.lit(0.0))
    return ranked(rows.withColumn("score", F.round(part(w_text, "t_rank") + part(w_vector, "v_rank"), 12)), [F.desc("score"), "chunk_hash", "row_id", "scope_id"], None)


def diversify(rows: DataFrame, strategy: str, most: int = 3, lam: float = 0.7, depth: int = 100) -> DataFrame:
    """Rows (query_id, item, raw_hash, score, rank, v) by strategy: ``off`` leaves them, ``group_by_raw_hash`` caps rows of one
    object, ``mmr`` reorders before that cap; a query with a row without vector is not reordered, but capped."""
    if strategy == "off":
        return rows.drop("v")
    if strategy not in ("group_by_raw_hash", "mmr"):
        raise ValueError(f"unknown strategy {strategy}")
    if strategy == "mmr":
        whole = rows.groupBy("query_id").agg(F.bool_and(F.col("v").isNotNull()).alias("all"))
        yes = rows.join(whole.where("all"), "query_id", "left_semi")
        order = mmr(yes, lam, depth).select("query_id", "item", F.col("rank").alias("new"))
        rows = rows.join(order, ["query_id", "item"], "left").withColumn("rank", F.coalesce("new", "rank")).drop("new")
    return cap_per_group(rows.drop("v"), "raw_hash", most)


def rerank(rows: DataFrame, scores: DataFrame, top_n: int, depth: int) -> DataFrame:
    """Rows (query_id, item, rank) with those in the first ``depth`` that a reranker scored first, best score first and old
    order on ties, at most ``top_n`` (of what was sent) of them; all others follow in old order. A candidate scored twice
    or never sent is an error of the reranker."""
    sent = rows.where(F.col("rank") <= depth)
    bad = scores.groupBy("query_id", "item").count().where("count > 1").select("query_id", "item").union(scores.join(sent, ["query_id", "item"], "left_anti").select("query_id", "item"))
    if bad.limit(1).count():
        raise ValueError("the reranker answered twice or for what was not sent")
    j = rows.join(scores.select("query_id", "item", F.col("score").alias("s")), ["query_id", "item"], "left").withColumn("n", F.row_number().over(Window.partitionBy("query_id", F.col("s").isNull()).orderBy(F.desc("s"), "rank")))
    head = F.col("s").isNotNull() & (F.col("n") <= top_n)
    order = Window.partitionBy("query_id").orderBy(F.when(head, 0).otherwise(1), F.when(head, -F.col("s")), "rank")
    return j.withColumn("new", F.row_number().over(order)).select("query_id", "item", F.col("new").alias("rank"))


def reciprocal_rank_fusion(text: DataFrame, vector: DataFrame, key: str, k: int = 60, w_text: float = 1.0, w_vector: float = 1.0, depth: int = 200) -> DataFrame:
    """Full outer join of two ranked lists (query_id, key, rank); a missing rank counts nothing."""
    t = text.where(F.col("rank") <= depth).select("query_id", key, F.col("rank").alias("t_rank"))
    v = vector.where(F.col("rank") <= depth).select("query_id", key, F.col("rank").alias("v_rank"))
    part = lambda w, r: F.coalesce(F.lit(w) / (F.lit(float(k)) + F.col(r)), F.lit(0.0))
    fused = t.join(v, ["query_id", key], "full_outer").withColumn("score", F.round(part(w_text, "t_rank") + part(w_vector, "v_rank"), 12))
    return ranked(fused, [F.desc("score"), key], None)


def cap_per_group(rows: DataFrame, group: str, most: int) -> DataFrame:
    """The first ``most`` rows of each group in rank order, renumbered; 0 keeps all."""
    if most:
        rows = rows.withColumn("g", F.row_number().over(Window.partitionBy("query_id", group).orderBy("rank"))).where(F.col("g") <= most).drop("g")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def mmr(rows: DataFrame, lam: float = 0.7, depth: int = 100) -> DataFrame:
    """Maximal marginal relevance of (query_id, item, score, rank, v): per query a pool of at most ``depth`` rows is
    reordered, what lies behind keeps its order. Scores are scaled to [0, 1] in the pool, 1 where all are equal."""
    import numpy as np

    def pick(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("rank", kind="stable").reset_index(drop=True)
        pool, tail = p.iloc[:depth], p.iloc[depth:]
        s = pool["score"].to_numpy(float)
        s = np.ones(len(s)) if len(s) and s.max() == s.min() else (s - s.min()) / (s.max() - s.min() if len(s) else 1)
        x = np.stack(pool["v"].to_numpy()).astype(float)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
        sim, left, order, near = x @ x.T, list(range(len(pool))), [], np.zeros(len(pool))
        while left:
            best = max(left, key=lambda i: (round(lam * s[i] - (1 - lam) * max(0.0, near[i]), 12), -i))
            order.append(best)
            left.remove(best)
            near = np.maximum(near, sim[best])
        out = pd.concat([pool.iloc[order], tail])
        return out.assign(rank=range(1, len(out) + 1))[["query_id", "item", "score", "rank"]]

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy("query_id").applyInPandas(pick, f"query_id {kinds['query_id']}, item {kinds['item']}, score double, rank int")


def documents_of(rows: DataFrame) -> DataFrame:
    """One row per (scope_id, raw_hash) of each query: its first hit, in order of first hits."""
    first = rows.groupBy("query_id", "scope_id", "raw_hash").agg(F.min("rank").alias("first_rank"), F.count("*").alias("hits"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first_rank")))


def page_of(rows: DataFrame, offset: int, size: int) -> DataFrame:
    return rows.where((F.col("rank") > offset) & (F.col("rank") <= offset + size))


def page_after(rows: DataFrame, consumed: DataFrame, size: int) -> DataFrame:
    """The next ``size`` rows of a recomputed list, after those each scope (scope_id, consumed) has already given."""
    w = Window.partitionBy("query_id", "scope_id").orderBy("rank")
    left = rows.withColumn("nth", F.row_number().over(w)).join(F.broadcast(consumed), "scope_id", "left").where(F.col("nth") > F.coalesce("consumed", F.lit(0))).drop("nth", "consumed")  # consumed: one row a scope
    return left.withColumn("page_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("page_rank") <= size)


def evidence_pointer(rows: DataFrame) -> DataFrame:
    """Adds the pointer of a hit as a struct and as a URI of five segments."""
    from corvida.functions.text import SCHEME

    p = F.struct(F.lit(1).alias("schema_version"), "commit_hash", "tree_hash", "raw_hash", "tool_profile_hash", "chunk_hash", "path_at_commit", "heading_path", "section_id", "byte_start", "byte_end", "scope_id")
    uri = F.concat(F.lit(f"{SCHEME}://"), F.concat_ws("/", "scope_id", "commit_hash", "raw_hash", "tool_profile_hash", "chunk_hash"))
    return rows.withColumn("pointer", p).withColumn("uri", uri)


def parse_evidence_uri(uri: Column) -> Column:
    """The five segments of an evidence URI; null for object URIs, other schemas (sv=), schemes and counts of segments."""
    from corvida.functions.text import SCHEME

    body = F.regexp_extract(uri, f"^{SCHEME}://([^?]*)", 1)
    query = F.regexp_extract(uri, r"\?(.*)$", 1)
    version = F.element_at(F.concat(F.array(F.lit("sv=1")), F.filter(F.split(query, "&"), lambda x: x.startswith("sv="))), -1)
    part = F.split(body, "/")
    names = ["scope_id", "commit_hash", "raw_hash", "tool_profile_hash", "chunk_hash"]
    ok = uri.startswith(f"{SCHEME}://") & (F.size(part) == 5) & (F.get(part, 1) != "object") & (version == "sv=1") & ~F.exists(part, lambda x: x == "")
    return F.when(ok, F.struct(*[part[i].alias(n) for i, n in enumerate(names)]))


def titles(rows: DataFrame, bindings: DataFrame, commits: DataFrame, selector: str) -> DataFrame:
    """Adds title (the path a document has from the selector's point of view) and changed_at.

    bindings: raw_hash, path, commit_hash. ``current`` and ``at`` show the binding at the given commit, ``all_history`` the
    last commit that holds the content.
    """
    b = bindings.join(commits.select("commit_hash", "created_at"), "commit_hash")
    last = F.struct("created_at", "commit_hash", "path")
    if selector in ("current", "at"):
        picked = b.groupBy("raw_hash").agg(F.min("path").alias("title"), F.min("created_at").alias("changed_at"))
    else:
        picked = b.groupBy("raw_hash").agg(F.max_by("path", last).alias("title"), F.max("created_at").alias("changed_at"))
    return rows.join(picked, "raw_hash", "left")


def refresh_scope(replica: DataFrame, fresh: DataFrame, markers: DataFrame, required: DataFrame) -> DataFrame:
    """The replica after scopes are refreshed: their rows replaced as a whole, others kept. A scope all of whose required
    bindings have a marker is refreshed, another stays as it was."""
    lacking = required.join(markers, ["scope_id", "binding"], "left_anti").select("scope_id").distinct()
    ready = required.select("scope_id").distinct().join(lacking, "scope_id", "left_anti")
    return replica.join(ready, "scope_id", "left_anti").unionByName(fresh.join(ready, "scope_id", "left_semi"))


def apply_delta(vectors: DataFrame, delta: DataFrame, generations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors after a delta (scope_id, generation, chunk_hash, vector): only where the scope's generation is the one the
    delta was made for and the chunk is known; the rest of the delta is passed over."""
    fit = delta.join(generations, ["scope_id", "generation"], "left_semi").join(chunks.select("scope_id", "chunk_hash").distinct(), ["scope_id", "chunk_hash"], "left_semi").select("scope_id", "chunk_hash", "vector")
    return vectors.join(fit, ["scope_id", "chunk_hash"], "left_anti").select("scope_id", "chunk_hash", "vector").unionByName(fit)


def stamp_digest(stamps: DataFrame) -> DataFrame:
    """One digest of all generation stamps (scope_id, generation): a cursor made under another digest is stale."""
    return stamps.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "scope_id", F.col("generation").cast("string")))), "\n"), 256).alias("digest"))


def write_vectors(stored: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors after the write, text_hashes whose chunk links fall away) of writing chunk vectors
    (embedding_hash, text_hash, profile_hash, vector).

    Vectors of other profiles of a written text go, and where any went all links of that text with them; an id that is
    there keeps its vector, and another vector under one id is an error.
    """
    both = stored.unionByName(new)
    clash = both.groupBy("embedding_hash").agg(F.countDistinct("vector").alias("n")).where("n > 1")
    if clash.limit(1).count():
        raise ValueError("an embedding id has two vectors")
    w = new.select("text_hash", F.col("profile_hash").alias("p")).distinct()
    evicted = stored.join(w, "text_hash").where("profile_hash <> p").select("embedding_hash", "text_hash").distinct()
    return both.join(evicted.select("embedding_hash"), "embedding_hash", "left_anti").dropDuplicates(["embedding_hash"]), evicted.select("text_hash").distinct()
