"""Queries on search, fusion and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from corvida.adapters import mock
from corvida.functions import text, vectors
from corvida.operators import ledger, search
from corvida.session import load, written

PHRASES = {"q1": ["retention table"], "q2": ["rollback procedure", "復旧計画"], "q3": ["Wartung", "calibration sheet", "quarterly"]}
SHORT = {"s1": [["計画"], ["3"]], "s2": [["No"], ["12", "11"]]}


def _chunks(spark, d):
    return load(spark, d, "chunks").dropDuplicates(["chunk_hash"])


def bm25_single(spark, d):
    return search.bm25(search.corpus(load(spark, d, "chunks")), {"q1": PHRASES["q1"]})


def bm25_or_phrases(spark, d):
    return search.bm25(search.corpus(load(spark, d, "chunks")), PHRASES)


def bm25_scope_narrowed(spark, d):
    c = load(spark, d, "chunks")
    return search.bm25(search.corpus(c), PHRASES, c.where("scope_id = 'relay-runbooks' and first_seen_commit is not null"))


def short_term_lane(spark, d):
    return search.short_lane(search.corpus(_chunks(spark, d)), SHORT)


def since_filter(spark, d):
    c = load(spark, d, "chunks")
    return search.bm25(search.corpus(c), {"q1": PHRASES["q1"]}, c.where("created_at >= timestamp_ntz'2025-06-01 00:00:00'"))


def eligible_semi_join(spark, d):
    configs = load(spark, d, "chunking_configs").where("max_chars <= 2000")
    return _chunks(spark, d).where("first_seen_commit is not null").join(configs, "chunking_config_hash", "left_semi").select("chunk_hash", "scope_id")


def knn_cosine_topk(spark, d):
    e = load(spark, d, "embeddings")
    return search.knn(e.select(F.col("vec_id").alias("item"), F.col("embedding").alias("v")), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")))


def _images(spark, d):
    """The page images; an archive without any has no such table."""
    try:
        return load(spark, d, "page_images")
    except AnalysisException:
        return spark.createDataFrame([], "scope_id string, image_hash string, raw_hash string")


def _archive_lanes(spark, d):
    """Text lane, vector lane and the vectors behind it, over the archive's chunks and images."""
    c = load(spark, d, "chunks")
    text = written(search.bm25(search.corpus(c), PHRASES, k=200), "text")
    e = load(spark, d, "chunk_embeddings")
    rows = written(search.vector_rows(c, _images(spark, d), e, ["scope_id"]), "vectors")  # no object here has both chunks and images, so a scope's first chunk cites its images
    q = search.query_vectors(e, list(PHRASES), rows, text)
    return text, search.vector_lane(rows, q), rows


def _fused(spark, d, **weights):
    text, vector, rows = _archive_lanes(spark, d)
    return search.fuse(search.assemble(text, vector), **weights), rows


def vector_lane(spark, d):
    return _archive_lanes(spark, d)[1].select("query_id", "scope_id", "row_id", "similarity", "rank")


def rrf_fusion(spark, d):
    return _fused(spark, d)[0].select("query_id", "row_id", "t_rank", "v_rank", "score", "rank")


def rrf_weighted(spark, d):
    return _fused(spark, d, w_text=0.0)[0].where("rank <= 5").select("query_id", "row_id", "score", "rank")


def cap_per_raw_hash(spark, d):
    return search.cap_per_group(_fused(spark, d)[0], "raw_hash", 1).select("query_id", "row_id", "raw_hash", "rank")


def _with_vectors(spark, d, depth):
    fused, rows = _fused(spark, d)
    v = rows.select("scope_id", "row_id", "v")
    top = fused.where(F.col("rank") <= depth).join(v, ["scope_id", "row_id"], "left")
    return top.select("query_id", F.col("row_id").alias("item"), "raw_hash", "score", "rank", "v")


def mmr_diversify(spark, d):
    """MMR of the vector-backed head of each fused list: rows without a vector left out, ranks renumbered."""
    rows = search.ranked(_with_vectors(spark, d, 60).where("v is not null").drop("rank"), [F.desc("score"), "item"], None)
    return search.mmr(rows).select("query_id", "item", "score", "rank")


def diversify_strategies(spark, d):
    """The first ten rows of each query under each strategy; a missing vector turns MMR off, not the cap."""
    rows = written(_with_vectors(spark, d, 60), "div")
    out = None
    for s in ("off", "group_by_raw_hash", "mmr"):
        one = search.diversify(rows, s, most=1).where("rank <= 10").select(F.lit(s).alias("strategy"), "query_id", "item", "rank")
        out = one if out is None else out.unionByName(one)
    return out


def doc_grouping(spark, d):
    return search.documents_of(bm25_or_phrases(spark, d))


def page_offset(spark, d):
    return search.page_of(bm25_or_phrases(spark, d), 3, 4)


def cursor_page(spark, d):
    """The next page of a recomputed list after two rows of one scope were given."""
    spent = spark.createDataFrame([("relay-runbooks", 2), ("orchard-contracts", 1)], "scope_id string, consumed int")
    return search.page_after(bm25_or_phrases(spark, d), spent, 3).select("query_id", "chunk_hash", "page_rank")


def hybrid_search(spark, d):
    """Flagship: text and vector lanes over the archive's chunks and images, fused, capped per object, first ten of each query."""
    fused = _fused(spark, d)[0]
    return search.page_of(search.cap_per_group(fused, "raw_hash", 3), 0, 10).select("query_id", "rank", "scope_id", "chunk_hash", "row_id", "score")


def query_plans(spark, d):
    """The title of every document as a query: how many phrases its plan has and whether it goes to the short lane."""
    t = load(spark, d, "documents").where("title is not null and title rlike '\\\\S'").select("title").distinct()
    units = text.query_units(F.col("title"))
    long = F.size(F.filter(units, lambda u: F.char_length(u) >= 3))
    return t.select("title", F.size(units).alias("units"), long.alias("phrases"), (long == 0).alias("short"))


def evidence_uris(spark, d):
    p = load(spark, d, "evidence_pointers").where("chunk_hash <> '' and commit_hash <> '' and raw_hash <> ''").dropDuplicates(["pointer_id"])
    u = search.evidence_pointer(p)
    back = search.parse_evidence_uri(F.col("uri"))
    return u.select("pointer_id", "uri", back["chunk_hash"].alias("chunk"), back["scope_id"].alias("scope"), F.col("pointer.byte_end").alias("byte_end"))


def stale_cursor(spark, d):
    """Generation stamps of all scopes (their newest stored commit) in one digest, before and after a day."""
    c = load(spark, d, "commits")
    stamp = lambda rows: search.stamp_digest(rows.groupBy("scope_id").agg(F.date_format(F.max("stored_at"), "yyyy-MM-dd HH:mm:ss").alias("generation")))
    old = stamp(c.where("stored_at < timestamp_ntz'2025-06-01 00:00:00'"))
    return old.select(F.col("digest").alias("old")).crossJoin(stamp(c)).withColumn("stale", F.col("old") != F.col("digest"))


def document_titles(spark, d):
    p = load(spark, d, "evidence_pointers").where("commit_hash <> '' and raw_hash <> '' and path_at_commit is not null")
    b = p.select("raw_hash", F.col("path_at_commit").alias("path"), "commit_hash").distinct()
    rows = load(spark, d, "raw_objects").select("raw_hash").distinct()
    return search.titles(rows, b, _unique(load(spark, d, "commits"), "commit_hash"), "all_history")


def _unique(rows, key):
    return rows.dropDuplicates([key])


def content_vector_choice(spark, d):
    e = load(spark, d, "chunk_embeddings").where("distance = 'cosine'")
    return search.content_vectors(load(spark, d, "chunks"), e).select("chunk_hash", F.round(F.col("vector")[0].cast("double"), 6).alias("first"))


def image_citations(spark, d):
    return search.image_chunks(load(spark, d, "page_images"), load(spark, d, "chunks"), ["scope_id"])


def vector_write(spark, d):
    """Vectors of one profile written over all: how many stay of each profile, and of how many texts the links fall away."""
    e = load(spark, d, "chunk_embeddings").where("target_type = 'chunk' and vector is not null").dropDuplicates(["embedding_hash"]).select("embedding_hash", F.col("target_id").alias("text_hash"), "profile_hash", "vector", "distance")
    stored, fell = search.write_vectors(e.drop("distance"), e.where("distance = 'l2'").drop("distance"))
    return stored.groupBy("profile_hash").agg(F.count("*").alias("n")).unionByName(fell.agg(F.count("*").alias("n")).select(F.lit("links").alias("profile_hash"), "n"))


def replica_refresh(spark, d):
    """Scopes whose every cited chunk is stored are refreshed from the chunks, the others keep their old rows."""
    c = load(spark, d, "chunks").select("scope_id", "chunk_hash", "gen").dropDuplicates(["chunk_hash"])
    old = c.where("gen = 0").select("scope_id", "chunk_hash", F.lit("old").alias("state"))
    fresh = c.select("scope_id", "chunk_hash", F.lit("new").alias("state"))
    need = load(spark, d, "evidence_pointers").where("chunk_hash <> '' and schema_version = 1 and section_id is null").select("scope_id", F.col("chunk_hash").alias("binding")).distinct()
    after = search.refresh_scope(old, fresh, c.select("scope_id", F.col("chunk_hash").alias("binding")), need)
    return after.groupBy("scope_id", "state").agg(F.count("*").alias("n"))


def vector_delta(spark, d):
    """A delta made for generation 1 of some scopes: applied where the scope is still there, unknown chunks passed over."""
    c = load(spark, d, "chunks").dropDuplicates(["chunk_hash"])
    gens = c.groupBy("scope_id").agg(F.max("gen").alias("generation"))
    v = c.where("gen = 0").select("scope_id", "chunk_hash", F.lit(0).alias("vector"))
    delta = c.where("unit_key = 'doc:1'").select("scope_id", F.lit(1).alias("generation"), F.when(F.col("gen") == 1, F.concat("chunk_hash", F.lit("x"))).otherwise(F.col("chunk_hash")).alias("chunk_hash"), F.lit(1).alias("vector"))
    return search.apply_delta(v, delta, gens, c).groupBy("scope_id").agg(F.count("*").alias("n"), F.sum("vector").alias("changed"))


def rerank_mock(spark, d):
    """BM25 lists reordered by the stand-in reranker: five of the first eight come first, the rest keep their order."""
    hits = written(bm25_or_phrases(spark, d).select("query_id", F.col("chunk_hash").alias("item"), "rank"), "rerank")
    sent = hits.where("rank <= 8")
    return search.rerank(hits, sent.select("query_id", "item", mock.rerank_score(F.col("query_id"), F.col("item")).alias("score")), 5, 8)


def _expected(spark, d):
    """What a query should find: the first chunks that hold its first phrase, by hash."""
    c = load(spark, d, "chunks").where("text is not null").select("chunk_hash", F.lower("text").alias("t"))
    one = F.array(*[F.struct(F.lit(q).alias("query_id"), F.lit(ps[0].lower()).alias("p")) for q, ps in PHRASES.items()])
    hit = c.select("chunk_hash", "t", F.explode(one).alias("q")).where(F.expr("contains(t, q.p)")).select("q.query_id", F.col("chunk_hash").alias("row_id")).distinct()
    return search.ranked(hit, ["row_id"], 5).drop("rank")


def recall_at_k(spark, d):
    return ledger.recall_at_k(rrf_fusion(spark, d), _expected(spark, d), "row_id", 10)


def worst_expected_rank(spark, d):
    return ledger.worst_expected_rank(rrf_fusion(spark, d), _expected(spark, d), "row_id")


def scenario_gate(spark, d):
    r = recall_at_k(spark, d).withColumn("scenario", F.when(F.col("query_id") == "q1", "single").otherwise("several"))
    return r.groupBy("scenario").agg(F.round(F.avg("recall"), 6).alias("recall"), (F.avg("recall") >= 0.8).alias("passed"))


def rerank_comparison(spark, d):
    """How fusion moves the expected rows against the text lane alone."""
    t = bm25_or_phrases(spark, d).select("query_id", F.col("chunk_hash").alias("key"), "rank")
    f = rrf_fusion(spark, d).where("rank <= 10").select("query_id", F.col("row_id").alias("key"), "rank")
    return ledger.rerank_effect(t, f)


def same_space(spark, d):
    """Cosine of vectors of one text and profile under different contexts: smallest and mean, whether all share a space."""
    e = load(spark, d, "chunk_embeddings").where("target_type = 'chunk'").where(vectors.is_usable(F.col("vector"), F.col("dimensions"))).dropDuplicates(["vec_rowid"])
    w = Window.partitionBy("profile_hash", "target_id").orderBy("vec_rowid")
    pair = e.withColumn("first", F.first("vector").over(w)).withColumn("n", F.row_number().over(w)).where("n > 1").withColumn("c", vectors.cosine(F.col("vector"), F.col("first")))
    return pair.groupBy("profile_hash").agg(F.count("*").alias("pairs"), F.round(F.min("c"), 6).alias("least"), F.round(F.avg("c"), 6).alias("mean"))


def _bm25_sql(queries, eligible="true", k=10):
    phrases = sorted({p.lower() for ps in queries.values() for p in ps})
    occ = lambda c, p: f"len(list_filter(range(1, greatest(length({c}) - {len(p)} + 2, 1)), lambda i: {c}[i:i + {len(p) - 1}] = '{p}'))"
    f = ", ".join(f"{occ('body', p)} + 0.3 * {occ('head', p)} AS f{i}" for i, p in enumerate(phrases))
    stats = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(phrases)))

    def part(i):
        idf = f"ln((n - d{i} + 0.5) / (d{i} + 0.5))"
        return f"CASE WHEN f{i} > 0 THEN (CASE WHEN {idf} > 0 THEN {idf} ELSE 1e-6 END)::DOUBLE * f{i}::DOUBLE * 2.2 / (f{i}::DOUBLE + 1.2 * (0.25 + 0.75 * size / avg_size)) ELSE 0 END"

    each = " UNION ALL ".join(f"SELECT '{q}' AS query_id, scope_id, chunk_hash, raw_hash, round(-({' + '.join(part(phrases.index(p.lower())) for p in ps)}), 9) AS score FROM hits, stats WHERE {eligible}" for q, ps in queries.items())
    return f"""
        WITH c AS (SELECT DISTINCT ON (chunk_hash) * FROM chunks),
        rows AS (SELECT *, lower(text) AS body, lower(to_json(heading_path)::VARCHAR) AS head, greatest(length(text) - 2, 0) + greatest(length(to_json(heading_path)::VARCHAR) - 2, 0) AS size FROM c WHERE text IS NOT NULL),
        hits AS (SELECT *, {f} FROM rows), stats AS (SELECT count(*) AS n, avg(size) AS avg_size, {stats} FROM hits), s AS ({each}),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, scope_id, chunk_hash) AS rank FROM s WHERE score < 0)
        SELECT query_id, scope_id, chunk_hash, raw_hash, score, rank FROM r WHERE rank <= {k}"""


_KNN = """
    SELECT query_id, item, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item) AS rank FROM (
      SELECT q.vec_id AS query_id, e.vec_id AS item, round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 9) AS similarity
      FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) QUALIFY rank <= 10"""
_USABLE = "vector IS NOT NULL AND len(vector) = dimensions AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0"
_COS = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform({b}, lambda x: x::DOUBLE * x::DOUBLE))))"
_NAME = "regexp_replace(regexp_replace(raw_path, '^.*/', ''), '(.)\\.[^.]*$', '\\1')"
_CONTEXT = f"nullif(trim(regexp_replace(regexp_replace(regexp_replace({_NAME}, '[-_]', ' ', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '\\s+', ' ', 'g')), '')"
_CHOICE = f"""
    cand AS (SELECT DISTINCT c.scope_id, c.chunk_hash, c.raw_hash, {_CONTEXT} AS want, e.context_key, e.embedding_hash, e.vec_rowid, e.vector
      FROM (SELECT DISTINCT ON (chunk_hash) * FROM chunks) c JOIN ve e ON e.target_id = c.text_hash),
    own AS (SELECT scope_id, chunk_hash, raw_hash, vector FROM cand QUALIFY row_number() OVER (PARTITION BY scope_id, chunk_hash, raw_hash ORDER BY (context_key IS DISTINCT FROM want)::INT, embedding_hash, vec_rowid) = 1)"""
_VECTORS = f"""
    prof AS (SELECT profile_hash FROM chunk_embeddings WHERE distance = 'cosine' AND target_type = 'chunk' GROUP BY 1 ORDER BY count(*) DESC, profile_hash LIMIT 1),
    usable AS (SELECT DISTINCT ON (vec_rowid) * FROM chunk_embeddings WHERE distance = 'cosine' AND {_USABLE}),
    ve AS (SELECT * FROM usable WHERE target_type = 'chunk' AND profile_hash IN (FROM prof)), {_CHOICE},
    cites AS (SELECT DISTINCT i.scope_id, i.image_hash, i.raw_hash, c.chunk_hash FROM page_images i JOIN (SELECT scope_id, min(chunk_hash) AS chunk_hash FROM chunks GROUP BY 1) c USING (scope_id)),
    iv AS (SELECT target_id AS image_hash, arg_min(vector, vec_rowid) AS v FROM usable WHERE target_type = 'image' AND profile_hash IN (FROM prof) GROUP BY 1),
    vrows AS (SELECT scope_id, chunk_hash AS row_id, chunk_hash, raw_hash, vector AS v FROM own UNION ALL SELECT scope_id, image_hash, chunk_hash, raw_hash, v FROM cites JOIN iv USING (image_hash)),
    cached AS (SELECT 'q' || row_number() OVER (ORDER BY vec_rowid) AS query_id, vector AS given FROM usable WHERE target_type = 'query_cache' AND len(vector) = (SELECT max(len(v)) FROM vrows) ORDER BY vec_rowid LIMIT 3),
    best AS (SELECT query_id, arg_min(v, rank) AS best FROM tl JOIN vrows USING (chunk_hash) WHERE row_id = chunk_hash GROUP BY 1),
    qv AS (SELECT query_id, coalesce(given, best) AS q FROM cached FULL JOIN best USING (query_id)),
    near AS (SELECT query_id, scope_id, row_id, chunk_hash, raw_hash, round({_COS.format(a='v', b='q')}, 9) AS similarity FROM vrows, qv WHERE len(v) = len(q)),
    vl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, scope_id, row_id, chunk_hash) AS rank FROM near QUALIFY rank <= 200)"""
_FUSED = """
    u AS (SELECT query_id, scope_id, coalesce(v.row_id, t.chunk_hash) AS row_id, chunk_hash, coalesce(t.raw_hash, v.raw_hash) AS raw_hash, t.rank AS t_rank, v.rank AS v_rank
      FROM tl t FULL JOIN vl v USING (query_id, scope_id, chunk_hash)),
    txt AS (SELECT query_id, scope_id, chunk_hash AS row_id, chunk_hash, raw_hash, rank FROM tl),
    both_ AS (SELECT query_id, scope_id, row_id, coalesce(t.chunk_hash, v.chunk_hash) AS chunk_hash, coalesce(t.raw_hash, v.raw_hash) AS raw_hash, t.rank AS own, v.rank AS v_rank FROM txt t FULL JOIN vl v USING (query_id, scope_id, row_id)),
    r AS (SELECT b.query_id, b.scope_id, b.row_id, b.chunk_hash, b.raw_hash, coalesce(b.own, CASE WHEN b.row_id <> b.chunk_hash THEN h.rank END) AS t_rank, b.v_rank FROM both_ b LEFT JOIN tl h ON h.query_id = b.query_id AND h.scope_id = b.scope_id AND h.chunk_hash = b.chunk_hash),
    s AS (SELECT *, round(coalesce({wt}::DOUBLE / (60 + t_rank), 0) + coalesce(1::DOUBLE / (60 + v_rank), 0), 12) AS score FROM r),
    fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_hash, row_id, scope_id) AS rank FROM s)"""
_LANES = f"WITH tl AS ({_bm25_sql(PHRASES, k=200)}), {_VECTORS}"
_F = f"{_LANES}, {_FUSED.format(wt=1)}"
_E = "e AS (SELECT query_id, row_id FROM (" + " UNION ALL ".join(f"SELECT '{q}' AS query_id, chunk_hash AS row_id FROM (SELECT DISTINCT chunk_hash FROM chunks WHERE contains(lower(text), '{ps[0].lower()}'))" for q, ps in PHRASES.items()) + ") QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY row_id) <= 5)"
_RECALL = f"{_F}, {_E}, rc AS (SELECT e.query_id, count(f.row_id) / count(*) AS recall FROM e LEFT JOIN (SELECT * FROM fused WHERE rank <= 10) f USING (query_id, row_id) GROUP BY 1)"
_MMR = f"""
    {_F.replace('WITH tl', 'WITH RECURSIVE tl', 1)},
    top AS (SELECT f.query_id, f.row_id AS item, f.score, v.v FROM fused f JOIN vrows v USING (scope_id, row_id) WHERE f.rank <= 60),
    pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS r0, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM top),
    sims AS (SELECT a.query_id, a.item, b.item AS other, {_COS.format(a='a.v', b='b.v')} AS sim FROM pool a JOIN pool b USING (query_id)),
    m(query_id, step, item, rel, near, r0) AS (
      SELECT query_id, 1, item, CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END::DOUBLE, 0.0::DOUBLE, r0 FROM pool
      UNION ALL
      SELECT x.query_id, x.step + 1, x.item, x.rel, greatest(x.near, s.sim), x.r0
      FROM (SELECT *, first_value(item) OVER (PARTITION BY query_id ORDER BY round(0.7::DOUBLE * rel - 0.3::DOUBLE * greatest(near, 0.0), 12) DESC, r0) AS best FROM m) x
      JOIN sims s ON s.query_id = x.query_id AND s.item = x.item AND s.other = x.best WHERE x.item <> x.best),
    picks AS (SELECT query_id, step, item FROM m QUALIFY row_number() OVER (PARTITION BY query_id, step ORDER BY round(0.7::DOUBLE * rel - 0.3::DOUBLE * greatest(near, 0.0), 12) DESC, r0) = 1)
    SELECT p.query_id, p.item, t.score, p.step AS rank FROM picks p JOIN pool t USING (query_id, item)"""
SQL = {
    "bm25_single": _bm25_sql({"q1": PHRASES["q1"]}),
    "bm25_or_phrases": _bm25_sql(PHRASES),
    "bm25_scope_narrowed": _bm25_sql(PHRASES, "scope_id = 'relay-runbooks' AND first_seen_commit IS NOT NULL"),
    "since_filter": _bm25_sql({"q1": PHRASES["q1"]}, "created_at >= TIMESTAMP '2025-06-01'"),
    "short_term_lane": """
        WITH b AS (SELECT DISTINCT ON (chunk_hash) scope_id, chunk_hash, lower(text) AS body FROM chunks WHERE text IS NOT NULL),
        s AS (SELECT 's1' AS query_id, scope_id, chunk_hash, instr(body, '計画') AS pos FROM b WHERE contains(body, '計画') AND contains(body, '3')
          UNION ALL SELECT 's2', scope_id, chunk_hash, instr(body, 'no') FROM b WHERE contains(body, 'no') AND (contains(body, '12') OR contains(body, '11')))
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos, scope_id, chunk_hash) AS rank FROM s QUALIFY rank <= 10""",
    "eligible_semi_join": "SELECT DISTINCT chunk_hash, scope_id FROM chunks WHERE first_seen_commit IS NOT NULL AND chunking_config_hash IN (SELECT chunking_config_hash FROM chunking_configs WHERE max_chars <= 2000)",
    "knn_cosine_topk": _KNN,
    "vector_lane": f"{_LANES} SELECT query_id, scope_id, row_id, similarity, rank FROM vl",
    "rrf_fusion": f"{_F} SELECT query_id, row_id, t_rank, v_rank, score, rank FROM fused",
    "rrf_weighted": f"{_LANES}, {_FUSED.format(wt=0)} SELECT query_id, row_id, score, rank FROM fused WHERE rank <= 5",
    "cap_per_raw_hash": f"{_F}, g AS (SELECT query_id, row_id, raw_hash, rank AS r0 FROM fused QUALIFY row_number() OVER (PARTITION BY query_id, raw_hash ORDER BY rank) = 1) SELECT query_id, row_id, raw_hash, row_number() OVER (PARTITION BY query_id ORDER BY r0) AS rank FROM g",
    "hybrid_search": f"{_F}, g AS (SELECT *, rank AS r0 FROM fused QUALIFY row_number() OVER (PARTITION BY query_id, raw_hash ORDER BY rank) <= 3) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY r0) AS rank, scope_id, chunk_hash, row_id, score FROM g QUALIFY rank <= 10",
    "mmr_diversify": _MMR,
    "cursor_page": f"WITH h AS ({_bm25_sql(PHRASES)}), n AS (SELECT *, row_number() OVER (PARTITION BY query_id, scope_id ORDER BY rank) AS nth FROM h) SELECT query_id, chunk_hash, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS page_rank FROM n WHERE nth > CASE scope_id WHEN 'relay-runbooks' THEN 2 WHEN 'orchard-contracts' THEN 1 ELSE 0 END QUALIFY page_rank <= 3",
    "evidence_uris": "SELECT DISTINCT ON (pointer_id) pointer_id, 'ev://' || scope_id || '/' || commit_hash || '/' || raw_hash || '/' || tool_profile_hash || '/' || chunk_hash AS uri, chunk_hash AS chunk, scope_id AS scope, byte_end FROM evidence_pointers WHERE chunk_hash <> '' AND commit_hash <> '' AND raw_hash <> ''",
    "stale_cursor": "WITH g AS (SELECT scope_id, strftime(max(stored_at), '%Y-%m-%d %H:%M:%S') AS g, strftime(max(stored_at) FILTER (stored_at < TIMESTAMP '2025-06-01'), '%Y-%m-%d %H:%M:%S') AS o FROM commits GROUP BY 1), x AS (SELECT sha256(string_agg(scope_id || '=' || o, chr(10) ORDER BY scope_id || '=' || o)) AS old, sha256(string_agg(scope_id || '=' || g, chr(10) ORDER BY scope_id || '=' || g)) AS digest FROM g) SELECT old, digest, old <> digest AS stale FROM x",
    "document_titles": "WITH b AS (SELECT DISTINCT raw_hash, path_at_commit AS path, commit_hash FROM evidence_pointers WHERE commit_hash <> '' AND raw_hash <> '' AND path_at_commit IS NOT NULL), j AS (SELECT b.*, c.created_at FROM b JOIN (SELECT DISTINCT ON (commit_hash) * FROM commits) c USING (commit_hash)), t AS (SELECT raw_hash, arg_max(path, (created_at, commit_hash, path)) AS title, max(created_at) AS changed_at FROM j GROUP BY 1) SELECT r.raw_hash, title, changed_at FROM (SELECT DISTINCT raw_hash FROM raw_objects) r LEFT JOIN t USING (raw_hash)",
    "content_vector_choice": f"WITH ve AS (SELECT DISTINCT ON (vec_rowid) * FROM chunk_embeddings WHERE distance = 'cosine' AND target_type = 'chunk' AND {_USABLE}), {_CHOICE} SELECT chunk_hash, round(vector[1]::DOUBLE, 6) AS first FROM own",
    "image_citations": "SELECT DISTINCT i.scope_id, i.image_hash, i.raw_hash, c.chunk_hash FROM page_images i JOIN (SELECT scope_id, min(chunk_hash) AS chunk_hash FROM chunks GROUP BY 1) c USING (scope_id)",
    "vector_write": "WITH e AS (SELECT DISTINCT ON (embedding_hash) * FROM chunk_embeddings WHERE target_type = 'chunk' AND vector IS NOT NULL), w AS (SELECT DISTINCT target_id, profile_hash FROM e WHERE distance = 'l2'), gone AS (SELECT DISTINCT e.embedding_hash, e.target_id FROM e JOIN w ON w.target_id = e.target_id AND w.profile_hash <> e.profile_hash) SELECT profile_hash, count(*) AS n FROM e WHERE embedding_hash NOT IN (SELECT embedding_hash FROM gone) GROUP BY 1 UNION ALL SELECT 'links', count(DISTINCT target_id) FROM gone",
    "replica_refresh": "WITH c AS (SELECT DISTINCT ON (chunk_hash) scope_id, chunk_hash, gen FROM chunks), need AS (SELECT DISTINCT scope_id, chunk_hash FROM evidence_pointers WHERE chunk_hash <> '' AND schema_version = 1 AND section_id IS NULL), ready AS (SELECT DISTINCT scope_id FROM need EXCEPT SELECT scope_id FROM need WHERE (scope_id, chunk_hash) NOT IN (SELECT (scope_id, chunk_hash) FROM c)) SELECT scope_id, 'old' AS state, count(*) AS n FROM c WHERE gen = 0 AND scope_id NOT IN (FROM ready) GROUP BY 1 UNION ALL SELECT scope_id, 'new', count(*) FROM c WHERE scope_id IN (FROM ready) GROUP BY 1",
    "vector_delta": "WITH c AS (SELECT DISTINCT ON (chunk_hash) scope_id, chunk_hash, gen, unit_key FROM chunks), g AS (SELECT scope_id FROM c GROUP BY 1 HAVING max(gen) = 1), d AS (SELECT scope_id, chunk_hash FROM c WHERE unit_key = 'doc:1' AND gen <> 1 AND scope_id IN (FROM g)), a AS (SELECT scope_id, chunk_hash, 0 AS v FROM c WHERE gen = 0 AND (scope_id, chunk_hash) NOT IN (SELECT (scope_id, chunk_hash) FROM d) UNION ALL SELECT scope_id, chunk_hash, 1 FROM d) SELECT scope_id, count(*) AS n, sum(v)::BIGINT AS changed FROM a GROUP BY 1",
    "same_space": f"WITH e AS (SELECT DISTINCT ON (vec_rowid) * FROM chunk_embeddings WHERE target_type = 'chunk' AND {_USABLE}), p AS (SELECT profile_hash, vector, first_value(vector) OVER w AS first, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY profile_hash, target_id ORDER BY vec_rowid)), k AS (SELECT profile_hash, {_COS.format(a='vector', b='first')} AS c FROM p WHERE n > 1) SELECT profile_hash, count(*) AS pairs, round(min(c), 6) AS least, round(avg(c), 6) AS mean FROM k GROUP BY 1",
    "rerank_comparison": f"{_F}, t AS (SELECT query_id, chunk_hash AS row_id, rank AS b FROM tl WHERE rank <= 10), x AS (SELECT coalesce(t.b, 1000000) AS b, coalesce(f.rank, 1000000) AS a FROM t FULL JOIN (SELECT * FROM fused WHERE rank <= 10) f USING (query_id, row_id)) SELECT count(*) FILTER (a < b) AS improved, count(*) FILTER (a > b) AS worsened, count(*) FILTER (a = b) AS same FROM x",
    "doc_grouping": f"WITH h AS ({_bm25_sql(PHRASES)}), g AS (SELECT query_id, scope_id, raw_hash, min(rank) AS first_rank, count(*) AS hits FROM h GROUP BY 1, 2, 3) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_rank) AS rank FROM g",
    "page_offset": f"SELECT * FROM ({_bm25_sql(PHRASES)}) WHERE rank > 3 AND rank <= 7",
    "recall_at_k": f"{_RECALL} SELECT * FROM rc",
    "scenario_gate": f"{_RECALL} SELECT CASE WHEN query_id = 'q1' THEN 'single' ELSE 'several' END AS scenario, round(avg(recall), 6) AS recall, avg(recall) >= 0.8 AS passed FROM rc GROUP BY 1",
    "worst_expected_rank": f"{_F}, {_E} SELECT e.query_id, CASE WHEN count(f.rank) = count(*) THEN max(f.rank) END AS worst FROM e LEFT JOIN fused f USING (query_id, row_id) GROUP BY 1",
}
QUERIES = {f.__name__: f for f in (hybrid_search, bm25_single, bm25_or_phrases, bm25_scope_narrowed, since_filter, short_term_lane, eligible_semi_join, knn_cosine_topk, vector_lane, rrf_fusion, rrf_weighted, cap_per_raw_hash, mmr_diversify, diversify_strategies, doc_grouping, page_offset, cursor_page, query_plans, evidence_uris, stale_cursor, document_titles, content_vector_choice, image_citations, vector_write, replica_refresh, vector_delta, rerank_mock, recall_at_k, worst_expected_rank, scenario_gate, rerank_comparison, same_space)}
