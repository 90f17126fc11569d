"""Core operators: golden values, small models and edge cases."""

import datetime as dt
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from corvida.functions import ids, text, vectors
from corvida.operators import chunking, history, ledger, lifecycle, orphans, search
from corvida.plans import archive_queries, search_queries
from corvida.sources import files
from corvida.streaming import metrics

RAW = "sha256:74bcb92d8088c950e45e4c43563332da2ca1e04b25d6d4016aa43f830d4cca8a"
TOOL = "sha256:e067e42e6634b8043f46a4b7f55257ab10ca6266be80cc47b6a68a5aacd2c8f0"


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_golden_ids(spark):
    path = F.array(F.lit("認証仕様"), F.lit("API Token"))
    args = lambda gen: (F.lit(RAW), F.lit(TOOL), F.lit(gen), F.lit("page:12"), path, text.section_id(path), F.lit(1200).cast("bigint"), F.lit(1500).cast("bigint"))
    bare = (F.lit(RAW), F.lit(TOOL), F.lit(0), F.lit("doc:1"), F.array().cast("array<string>"), F.lit(None).cast("string"), F.lit(0).cast("bigint"), F.lit(600).cast("bigint"))
    r = one(spark, ids.chunking_config_id(F.lit("heading"), F.lit(6000)), ids.chunk_id(*args(0)), ids.chunk_id(*args(3)), ids.chunk_id(*bare), ids.unit_ref(F.lit("page:12")), text.section_id(path))
    assert r.c0 == "sha256:7810328ffa7f0dd9a558294e166f20d8038d8d779809ee519582e3d6ba1b98ea"
    assert r.c1 == "sha256:dd0fcce91922d28404fc036213d176a6bc8d8a5d5635575a9804bed3ee3b19dc"
    assert r.c2 == "sha256:4c9576771a9dc4d3cd6197feda6510a7ef65381ef74588eacc6fa79f27a23442"
    assert r.c3 == "sha256:2d6d42758c3f7f22e87422a5ca7e9d0a0c8ee18425915d661b3bd21c6664d0ae"
    assert (r.c4, r.c5) == ("3c2fa650872d5484", "認証仕様/api-token")


def test_text_functions(spark):
    r = one(spark, text.duration_seconds(F.lit("15m")), text.duration_seconds(F.lit("0s")), text.filename_context(F.lit("my_reportFinal-v2.pdf")), text.fence_for(F.lit("a ````` b\n ```` c")), text.column_number(F.lit("AA")), text.is_utc_timestamp(F.lit("2024-02-30T00:00:00Z")), text.secret_tier(F.lit("server.PEM")), text.redact_paths(F.lit("at /home/u/x.txt now")), text.nfc(F.lit("e" + chr(0x301))))
    assert list(r) == [900, None, "my report Final v2", "`````", 27, False, "A", "at <path>/x.txt now", "é"]
    assert text.glob_to_regex("a/**/b?.md") == r"^a/(?:.*/)?b[^/]\.md$"


def test_chunking_headings(spark):
    docs = spark.createDataFrame([(1, "# A\n### C\n```\n# no\n```\n## B\n"), (2, None), (3, ""), (4, "plain")], "doc_id bigint, text string")
    rows = sorted((r.byte_start, r.heading_path, r.byte_end) for r in chunking.sections(docs).collect())
    assert rows == [(0, "A", 4), (4, "A > C", 23), (23, "A > B", 28)]


def test_rrf_golden_and_zero_weight(spark):
    t = spark.createDataFrame([("q", "c1", 1), ("q", "c2", 2), ("q", "c3", 3), ("q", "c4", 4)], "query_id string, chunk string, rank int")
    v = spark.createDataFrame([("q", "c2", 1), ("q", "c3", 2), ("q", "c1", 3), ("q", "c5", 4)], "query_id string, chunk string, rank int")
    got = lambda **k: [r.chunk for r in search.reciprocal_rank_fusion(t, v, "chunk", **k).orderBy("rank").collect()]
    assert got() == ["c2", "c1", "c3", "c4", "c5"]
    assert got(w_text=0.0) == ["c2", "c3", "c1", "c5", "c4"]
    assert abs(search.reciprocal_rank_fusion(t, v, "chunk").where("rank = 1").first().score - 123 / 3782) < 1e-9


def test_mmr_prefers_the_different(spark):
    rows = spark.createDataFrame([("q", 1, 1.0, 1, [1.0, 0.0]), ("q", 2, 0.9, 2, [1.0, 0.01]), ("q", 3, 0.8, 3, [0.0, 1.0]), ("q", 4, 0.0, 4, [0.0, 0.0])], "query_id string, item int, score double, rank int, v array<double>")
    assert [r.item for r in search.mmr(rows, 0.7).orderBy("rank").collect()] == [1, 3, 2, 4]


def test_bm25_against_a_model(spark):
    import math

    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "aaaa", "delta"]
    data = [(f"s{i % 2}", f"c{i:02}", f"r{i}", dt.datetime(2025, 1, 1), " ".join(rng.choices(words, k=rng.randint(1, 30))), ["alpha head"] if i % 5 == 0 else []) for i in range(40)]
    c = spark.createDataFrame(data, "scope_id string, chunk_hash string, raw_hash string, created_at timestamp_ntz, text string, heading_path array<string>")
    got = {r.chunk_hash: r.score for r in search.bm25(search.corpus(c), {"q": ["alpha", "aaa"]}, k=100).collect()}
    import json

    occ = lambda s, p: sum(s.startswith(p, i) for i in range(len(s)))
    rows = [(x[1], x[4].lower(), json.dumps(x[5], separators=(",", ":")).lower()) for x in data]
    size = {k: max(len(t) - 2, 0) + max(len(h) - 2, 0) for k, t, h in rows}
    avg, want = sum(size.values()) / len(rows), {}
    for p in ("alpha", "aaa"):
        f = {k: occ(t, p) + 0.3 * occ(h, p) for k, t, h in rows}
        d = sum(x > 0 for x in f.values())
        idf = math.log((len(rows) - d + 0.5) / (d + 0.5))
        idf = idf if idf > 0 else 1e-6
        for k, x in f.items():
            if x:
                want[k] = want.get(k, 0) - idf * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * size[k] / avg))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_eligibility_lies_below_the_top_k(spark):
    c = spark.createDataFrame([("s", f"c{i}", "r", dt.datetime(2025, 1, 1), "word " * (9 - i) + "x" * 60, []) for i in range(8)], "scope_id string, chunk_hash string, raw_hash string, created_at timestamp_ntz, text string, heading_path array<string>")
    got = search.bm25(search.corpus(c), {"q": ["word"]}, c.where("chunk_hash in ('c6', 'c7')"), k=2).collect()
    assert {r.chunk_hash for r in got} == {"c6", "c7"}


def test_hybrid_search_finds_what_only_a_vector_finds(spark, tmp_path):
    at = dt.datetime(2025, 1, 1)
    data = [("s", f"c{i}", f"r{i}", at, t, [], f"t{i}") for i, t in enumerate(["the retention table of the archive", "how long records are kept", "lunch menu", "parking"])]
    spark.createDataFrame(data, "scope_id string, chunk_hash string, raw_hash string, created_at timestamp_ntz, text string, heading_path array<string>, text_hash string").write.parquet(f"{tmp_path}/chunks.parquet")
    v = [("t0", [1.0, 0.0], "p"), ("t1", [0.9, 0.1], "p"), ("t1", [-1.0, 0.0], "p"), ("t2", [0.0, 1.0], "p"), ("t3", [0.0, 0.0], "p"), ("t3", [1.0], "p"), ("t2", [1.0, 0.0], "o")]
    e = spark.createDataFrame([(i, *r) for i, r in enumerate(v)], "vec_rowid bigint, target_id string, vector array<float>, profile_hash string")
    e.select("*", F.lit("chunk").alias("target_type"), F.lit("cosine").alias("distance"), F.lit(2).alias("dimensions")).write.parquet(f"{tmp_path}/chunk_embeddings.parquet")
    got = [r.chunk_hash for r in search_queries.hybrid_search(spark, str(tmp_path)).where("query_id = 'q1'").orderBy("rank").collect()]
    assert got[:3] == ["c0", "c1", "c2"]


def test_history_on_a_merge_graph(spark):
    c = spark.createDataFrame([("a", []), ("b", ["a"]), ("c", ["a"]), ("m", ["b", "c"]), ("x", ["gone"])], "commit_hash string, parents array<string>")
    e = history.edges(c)
    starts = spark.createDataFrame([("m",), ("x",)], "commit_hash string")
    assert {(r.start, r.commit) for r in history.closure(starts, e).collect()} == {("m", "m"), ("m", "b"), ("m", "c"), ("m", "a"), ("x", "x"), ("x", "gone")}
    assert {(r.start, r.commit, r.depth) for r in history.walk(starts, history.first_parents(c)).collect()} == {("m", "m", 0), ("m", "b", 1), ("m", "a", 2), ("x", "x", 0), ("x", "gone", 1)}
    b = spark.createDataFrame([("a", "p", "1"), ("b", "p", "1"), ("c", "p", "2"), ("m", "p", "2"), ("m", "q", "3")], "commit_hash string, path string, raw_hash string")
    assert {(r.commit_hash, r.path) for r in history.introductions(b, e).collect()} == {("a", "p"), ("c", "p"), ("m", "q")}
    old, new = spark.createDataFrame([("p", "1"), ("q", "1"), ("r", "1")], "path string, raw_hash string"), spark.createDataFrame([("p", "1"), ("q", "2"), ("s", "1")], "path string, raw_hash string")
    assert {(r.path, r.state) for r in history.changes(old, new, ["path"]).collect()} == {("p", "unchanged"), ("q", "modified"), ("r", "deleted"), ("s", "added")}


def test_ancestor_most_introductions(spark):
    # a - b - c - d on one line; x is another root, z in a second scope has its parent in the first
    c = spark.createDataFrame([("k", "s", []), ("b", "s", ["k"]), ("a", "s", ["b"]), ("d", "s", ["a", "gone"]), ("x", "s", []), ("0", "t", ["d"])], "commit_hash string, scope_id string, parents array<string>")
    found = spark.createDataFrame([("k", "p", "1"), ("a", "p", "1"), ("0", "p", "1"), ("x", "p", "1"), ("a", "q", "1"), ("far", "p", "1")], "commit_hash string, path string, raw_hash string")
    assert {(r.commit_hash, r.path) for r in history.ancestor_most(found, c).collect()} == {("k", "p"), ("x", "p"), ("a", "q"), ("far", "p")}


def test_introductions_take_the_ancestor_most(spark, tmp_path):
    spark.createDataFrame([("k", "s", []), ("b", "s", ["k"]), ("a", "s", ["b"])], "commit_hash string, scope_id string, parents array<string>").write.parquet(f"{tmp_path}/commits.parquet")
    spark.createDataFrame([("s", "k", "p", "1"), ("s", "b", "p", "2"), ("s", "a", "p", "1")], "scope_id string, commit_hash string, path_at_commit string, raw_hash string").write.parquet(f"{tmp_path}/evidence_pointers.parquet")
    assert {(r.raw_hash, r.n, r.canonical) for r in archive_queries.introductions(spark, str(tmp_path)).collect()} == {("1", 1, "k"), ("2", 1, "b")}


def test_only_the_heads_own_bindings_are_live(spark, tmp_path):
    spark.createDataFrame([("a", "s", []), ("b", "s", ["a"]), ("c", "s", ["b"])], "commit_hash string, scope_id string, parents array<string>").write.parquet(f"{tmp_path}/commits.parquet")
    spark.createDataFrame([("s", "a", "old", "1"), ("s", "b", "gone", "2"), ("s", "b", "kept", "3"), ("s", "c", "kept", "4")], "scope_id string, commit_hash string, path_at_commit string, raw_hash string").write.parquet(f"{tmp_path}/evidence_pointers.parquet")
    assert {r.path for r in archive_queries.final_deleted(spark, str(tmp_path)).collect()} == {"old", "gone"}
    assert {(r.raw_hash, r.kind) for r in archive_queries.include_deleted_union(spark, str(tmp_path)).collect()} == {("4", "live"), ("1", "deleted"), ("2", "deleted")}


def test_upsert_merge_keeps_every_user(spark, tmp_path):
    t = lambda n: dt.datetime(2024, 1, n)
    spark.createDataFrame([(i, t(1 + i % 30), i % 12) for i in range(60)] + [(99, None, 77)], "event_id bigint, ts timestamp_ntz, user_id bigint").write.parquet(f"{tmp_path}/events.parquet")
    assert {(r.user_id, r.seen) for r in archive_queries.upsert_merge(spark, str(tmp_path)).collect()} == {(u, 48 + u) for u in range(12)} | {(77, 99)}


def test_lifecycle_and_ledger(spark):
    t = dt.datetime(2025, 1, 1)
    r = spark.createDataFrame([("s", "1", "purged", t), ("s", "1", "retired", t), ("s", "2", "purged", t), ("s", "2", "retired", t + dt.timedelta(1)), ("s", "3", None, None)], "scope_id string, raw_hash string, lifecycle_kind string, lifecycle_at timestamp_ntz")
    assert {(x.raw_hash, x.state) for x in lifecycle.final_events(r).collect()} == {("1", "purged"), ("2", "retired")}
    v = spark.createDataFrame([("a", float(i)) for i in range(1, 11)] + [("b", None), ("c", 5.0)], "g string, v double")
    got = {x.g: (x.p50, x.p95) for x in ledger.nearest_rank(v, ["g"], "v", [50, 95]).collect()}
    assert got == {"a": (5.0, 10.0), "c": (5.0, 5.0)}


def test_orphans_edge_cases(spark):
    t = lambda n: dt.datetime(2025, 1, n)
    refs = spark.createDataFrame(
        [(1, "s", "ok", t(5)), (1, "s", "ok", t(5)), (2, "s", "late", t(5)), (3, "s", "gone", t(5)), (4, "s", "none", t(5)), (5, "other", "ok", t(5)), (6, "s", None, t(5)), (7, "s", "", t(5)), (8, None, "ok", t(5)), (9, "s", "late", None), (10, "s", "none", None)],
        "id bigint, scope_id string, k string, cited_at timestamp_ntz",
    ).withColumn("ref_key", F.lit("clash"))
    known = spark.createDataFrame([("s", "ok", t(1), None), ("s", "ok", t(9), None), ("s", "late", t(6), None), ("s", "gone", t(1), "purged"), (None, "ok", t(1), None)], "scope_id string, k string, stored_at timestamp_ntz, kind string").withColumn("scope", F.lit("clash"))
    parents = orphans.parents(known, ["f"], "k", "scope_id", "stored_at", F.col("kind").isin("purged", "erased"))
    found = orphans.find_orphans(orphans.references(refs, "t", "f", "id", "scope_id", F.col("k"), "cited_at"), parents)
    assert sorted(r.ref_rowid for r in found.collect()) == [2, 3, 4, 5, 8, 10]
    assert orphans.find_orphans(orphans.references(refs.limit(0), "t", "f", "id", "scope_id", F.col("k"), "cited_at"), parents).count() == 0
    assert sum(r.n_refs for r in orphans.count_orphans(found).collect()) == 6


def test_orphans_do_not_broadcast_or_shuffle_wide_rows(spark):
    refs = orphans.references(spark.range(10).selectExpr("id", "'s' scope_id", "cast(id as string) k", "timestamp_ntz'2025-01-01' at", "repeat('x', 100) wide"), "t", "f", "id", "scope_id", F.col("k"), "at")
    assert "wide" not in refs._jdf.queryExecution().optimizedPlan().toString()


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("hello")
    (tmp_path / "id_rsa").write_text("x")
    got = {r.name: (r.size, r.media_type, r.held) for r in files.scan_folder(spark, str(tmp_path)).collect()}
    assert got == {"a.md": (5, "text/markdown", None), "id_rsa": (1, "application/octet-stream", "secret")}
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2</v></c></row><row><c r="A2"/></row><row><c r="C3"><v>7</v></c></row></sheetData></worksheet>')
    books = spark.createDataFrame([("b.xlsx", bytearray(buf.getvalue())), ("bad.xlsx", bytearray(b"no"))], "path string, content binary")
    rows = {r.path: r for r in files.decode_workbooks(books).collect()}
    assert rows["b.xlsx"].markdown == "| name | 2 |\n| --- | --- |\n\n7" and rows["bad.xlsx"].error == "BadZipFile"
    with pytest.raises(FileExistsError):
        files.restore(spark.createDataFrame([("a.md", bytearray(b"1"))], "name string, content binary"), str(tmp_path))


def test_streaming_matches_batch(spark, tmp_path):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, h, m), "view", 1.5) for h in range(6) for m in (1, 30)], "ts timestamp_ntz, event_type string, value double")
    rows.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))
    got = {(r.hour, r.n, r.cents) for r in metrics.drain(metrics.hourly(stream, "1 hour"), "t").collect()}
    assert {("2024-01-01 00", 2, 300), ("2024-01-01 03", 2, 300)} <= got


def test_vectors(spark):
    a, z = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    r = one(spark, vectors.cosine(a, a), vectors.cosine(a, z), vectors.l2_squared(a, z), vectors.is_usable(z, F.lit(2)), vectors.truncate_renormalise(a, 1)[0])
    assert list(r) == [1.0, 0.0, 25.0, False, 1.0]


def test_contract():
    import __spark_entry__ as entry

    q, sql = entry.queries(), entry.oracle_sql()
    assert sql.keys() <= q.keys() and len(q) > 70
